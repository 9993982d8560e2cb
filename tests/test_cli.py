"""The commands end to end, sharing their files."""

import json

import pytest

from skein import cli
from skein.session import NotFoundError

PAGES = {"58": ("Blood", "== History ==\nThe blood angels text. [[Sanguin]] [[Nowhere]]"), "2": ("Sanguin", "== Life ==\nA primarch with wings and a long story. [[Blood]] [[Baal]]"), "3": ("Baal", "A red planet of sand.")}
XML = "<mediawiki>" + "".join(f"<page><title>{t}</title><ns>0</ns><id>{i}</id><revision><timestamp>2024-01-01T00:00:00Z</timestamp><text>{x}</text></revision></page>" for i, (t, x) in PAGES.items()) + "</mediawiki>"


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli")
    (path / "w.xml").write_text(XML)
    return path


def run(spark, capsys, *arguments):
    assert cli.dispatch([str(a) for a in arguments], spark) == 0
    return capsys.readouterr().out


def test_stepwise_workflow(spark, base, capsys):
    assert run(spark, capsys, "parse-wiki", base / "w.xml", base / "articles", "--files", base / "md").startswith("3 articles")
    assert "3" in run(spark, capsys, "build-test-bed", base / "w.xml", base / "ids", "--count", 10).split("\t")[0]
    assert "3" in run(spark, capsys, "stats-markdown", base / "md")
    assert run(spark, capsys, "chunk", base / "md", base / "chunks").startswith("3 chunks")
    assert run(spark, capsys, "embed", base / "chunks", base / "vectors", "--dimensions", 32).startswith("3\t0")
    assert "add\t3" in run(spark, capsys, "store", base / "vectors", base / "db", "--index", base / "index")
    assert "skip\t3\nnothing to store" in run(spark, capsys, "store", base / "vectors", base / "db")
    assert "nothing" not in run(spark, capsys, "store", base / "vectors", base / "db", "--index", base / "index2")
    assert "update\t3" in run(spark, capsys, "store", base / "vectors", base / "db", "--force")
    assert run(spark, capsys, "build-bm25", base / "db", "--output", base / "index").startswith("3\t")
    assert json.loads(run(spark, capsys, "db-health", base / "db")) == {"status": "healthy", "count": 3}
    assert run(spark, capsys, "stats-db", base / "db").startswith("3\t3")
    assert "wings" in run(spark, capsys, "show-chunk", base / "db", "2_0")
    found = run(spark, capsys, "retrieve", base / "db", base / "index", "red planet sand", "--dimensions", 32, "--top-k", 1)
    assert found.split("\t")[2] == "3_0"
    expanded = run(spark, capsys, "retrieve", base / "db", base / "index", "blood angels", "--dimensions", 32, "--top-k", 1)
    assert [line.split("\t")[2] for line in expanded.strip().split("\n")] == ["58_0", "2_0"]
    assert "deleted" in run(spark, capsys, "delete-chunk", base / "db", "2_0", "--force")
    with pytest.raises(NotFoundError):
        cli.dispatch(["show-chunk", str(base / "db"), "2_0"], spark)
    assert "2 deleted" in run(spark, capsys, "purge-db", base / "db", "--force")
    assert "nothing" in run(spark, capsys, "purge-db", base / "db", "--force")
    with pytest.raises(NotFoundError):
        cli.dispatch(["retrieve", str(base / "db"), str(base / "index"), "x"], spark)


def test_ingest_command(spark, base, capsys):
    cli.dispatch(["parse-wiki", str(base / "w.xml"), str(base / "a2")], spark)
    capsys.readouterr()
    first = json.loads(run(spark, capsys, "ingest", base / "a2", base / "db2", "--index", base / "i2", "--dimensions", 8, "--summary", base / "sum"))
    assert {k: first[k] for k in ("add", "chunks", "failed")} == {"add": 3, "chunks": 3, "failed": 0} and first["tokens"] > 20
    assert json.loads(run(spark, capsys, "ingest", base / "a2", base / "db2", "--dimensions", 8)) == {"skip": 3, "chunks": 0, "failed": 0, "tokens": 0, "cost_usd": 0.0}
    (base / "one").write_text("# only\n58\n")
    assert json.loads(run(spark, capsys, "ingest", base / "a2", base / "db2", "--force", "--dry-run", "--wiki-ids", base / "one")) == {"update": 1, "chunks": 1}


def test_errors_give_exit_code_1_and_a_log_line(spark, base, capsys, monkeypatch):
    monkeypatch.setenv("HYBRID_TOP_K", "x")
    assert cli.main(["show-chunk", str(base / "none"), "1_0"], spark) == 1
    last = [json.loads(line) for line in capsys.readouterr().err.splitlines() if line.startswith("{")][-1]
    assert last["event"] == "command_failed" and last["level"] == "error"


def test_a_failing_index_is_a_warning(spark, base, capsys, monkeypatch):
    from skein.operators import keyword

    run(spark, capsys, "parse-wiki", base / "w.xml", base / "a3")
    run(spark, capsys, "chunk", base / "a3", base / "c3")
    run(spark, capsys, "embed", base / "c3", base / "v3", "--dimensions", 8)
    monkeypatch.setattr(keyword, "build", lambda *a, **k: 1 / 0)
    assert cli.dispatch(["store", str(base / "v3"), str(base / "db3"), "--index", str(base / "i3")], spark) == 0
    out = capsys.readouterr()
    assert "add\t3" in out.out and "warning" in out.err
