"""Validators, statistics, costs, prompts, answers, routing."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import answers as A
from skein.operators import analytics, quality
from skein.session import ConfigurationError, ProviderError


def check(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_chunk_rules(spark):
    schema = "chunk_text string, article_title string, section_path string"
    assert check(spark, ("x" * 400, "t", "p"), schema, quality.check_chunk())["valid"]
    assert check(spark, (" ", None, None), schema, quality.check_chunk())["issues"] == ["no text"]
    assert check(spark, ("x" * 10, "", "p"), schema, quality.check_chunk())["issues"] == ["no title", "too few tokens"]
    assert check(spark, ("x" * 2004, "t", " "), schema, quality.check_chunk())["issues"] == ["no section path", "too many tokens"]


def test_embedding_rules(spark):
    nan, inf = float("nan"), float("inf")
    got = lambda v: check(spark, (v,), "embedding array<float>", quality.check_embedding(dimensions=2))
    assert got([0.6, 0.8])["valid"] and got([0.6, 0.8])["warnings"] == []
    assert got([1.0])["issues"] == ["dimension"] and got([nan, 0.0])["issues"] == ["nan"] and got([inf, 0.0])["issues"] == ["infinite"]
    assert got([3.0, 4.0])["warnings"] == ["norm"] and got(None)["issues"] == ["dimension"]


def test_markdown_rules(spark):
    got = lambda t: check(spark, (t,), "content string", quality.check_markdown())
    assert got("x" * 60)["valid"] and got("short")["warnings"] == ["short"]
    assert got(" \n")["issues"] == ["empty"] and got(None)["issues"] == ["empty"] and got("---\n---x")["issues"] == ["no content"]


def against_sql(spark, folder, name, rows, schema):
    """Rows of a query and of its SQL over a table ``documents``."""
    import duckdb

    import __spark_entry__

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).collect()]
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return got, db.execute(__spark_entry__.oracle_sql()[name]).fetchall()


def test_validation_helpers_on_blank_and_missing_texts(spark, tmp_path):
    rows = [(i, t, None, " ") for i, t in enumerate(("x" * 400, "short", "", " ", "\n \n", "\n" * 60, " " * 300, "x" * 2100, None))]
    got, want = against_sql(spark, tmp_path, "validation_helpers", rows, "doc_id long, text string, source string, lang string")
    assert got == want


def test_embedded_texts_as_in_sql(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate((None, "Der stsch erung erau.", " ", "\n", "", "a b"), 11)][1:]
    got, want = against_sql(spark, tmp_path, "embed_documents", rows, "doc_id long, text string")
    assert sorted(got) == sorted(want) and len(got) == 5


def test_rates_are_rounded_as_in_sql(spark):
    import duckdb

    want = duckdb.connect().execute("select round(100.0e0 * 402 / 640000, 6)").fetchone()[0]
    got = spark.range(1).select(quality.rounded(quality.rate(F.lit(402), F.lit(640000 - 402))).alias("r")).first()["r"]
    assert got == want == 0.062812


def test_metadata_rules(spark):
    got = lambda t: check(spark, (t,), "metadata string", quality.check_metadata())
    assert got('{"content_type": "lore", "spoiler_flag": false}')["valid"]
    assert got("{}")["issues"] == ["content_type", "spoiler_flag"]


def test_xml_rules(spark):
    from skein.sources.wiki import PAGE

    assert quality.check_xml(spark.createDataFrame([], PAGE)).first()["issues"] == ["no pages"]


def test_rates(spark):
    rows = spark.createDataFrame([(1, 3), (0, 0)], "b long, g long").select(quality.rate(F.col("b"), F.col("g")).alias("r")).collect()
    assert [r["r"] for r in rows] == [25.0, 0.0]


def test_extremes(spark):
    rows = spark.createDataFrame([(i, i % 5) for i in range(30)], "k long, v long")
    got = analytics.extremes(rows, "v", "k", 3).collect()
    assert [(r["k"], r["side"]) for r in sorted(got, key=lambda r: (r["side"], r["place"]))] == [(29, "largest"), (24, "largest"), (19, "largest"), (0, "smallest"), (5, "smallest"), (10, "smallest")]
    assert analytics.latest(spark.createDataFrame([("",), ("a",), ("b",)], "t string"), "t").first()[0] == "b"


def test_costs(spark):
    assert analytics.cost("gpt-4.1", 1000, 500) == pytest.approx(0.006)
    with pytest.raises(ValueError):
        analytics.cost("other", 1)
    used = spark.createDataFrame([("gpt-4.1", 1000, 500)], "model string, prompt_tokens long, completion_tokens long")
    assert analytics.costs(used).first()["cost_usd"] == pytest.approx(0.006)


def test_retrieval_quality(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "b", 1), (1, "z", 1), (2, "q", 1)], "query_id long, chunk_id string, grade long")
    got = {r["query_id"]: r for r in analytics.retrieval_quality(hits, relevant, 3).collect()}
    assert got[1]["precision"] == pytest.approx(1 / 3, abs=1e-6) and got[1]["recall"] == 0.5 and got[1]["reciprocal_rank"] == 0.5
    assert got[2]["recall"] == 0.0 and got[2]["ndcg"] == 0.0


LORE = {"answer": "A", "personality_reply": "P", "sources": [f"http://x.org/{i}" for i in range(7)], "smalltalk": False}


def test_display(spark):
    got = lambda a, lang="en": spark.createDataFrame([(json.dumps(a),)], "a string").select(A.display(F.col("a"), lang)).first()[0]
    assert got(LORE) == "A\n\nP\n\n📚 Sources:\n" + "\n".join(f"- http://x.org/{i}" for i in range(5))
    assert got(LORE, "hu").count("Források") == 1 and got(LORE, "xx").count("Sources") == 1
    assert got({"personality_reply": "Hi", "smalltalk": True}) == "Hi"


def test_structured_answers(spark):
    assert A.structured(json.dumps(LORE))["answer"] == "A"
    for bad in ({}, LORE | {"sources": []}, LORE | {"answer": None}, LORE | {"sources": ["ftp://x"]}):
        with pytest.raises(ValueError):
            A.structured(json.dumps(bad))
        assert not check(spark, (json.dumps(bad),), "answer string", quality.check_answer())["valid"]
    assert check(spark, (json.dumps(LORE),), "answer string", quality.check_answer())["valid"]
    assert "smalltalk" in A.json_schema()["required"]


def test_router():
    waits, tries = [], []

    def flaky(system, user, model):
        tries.append(model)
        if len(tries) < 3:
            raise ProviderError("busy", retryable=True)
        return json.dumps(LORE), 10, 5

    router = A.Router({"openai": flaky}, "gpt-4.1", wait=waits.append)
    assert router.generate_structured("s", "u")["answer"]["answer"] == "A" and waits == [2.0, 4.0]
    with pytest.raises(ProviderError):
        router.name("gemini")
    with pytest.raises(ConfigurationError):
        router.generate("s", "u", "claude-opus-4-5")


def test_prompts(tmp_path, spark):
    assert "Hungarian" in A.system_prompt(" p ", "hu") and A.system_prompt("p", "de").count("de") >= 1
    assert spark.range(1).select(A.user_prompt(F.lit("{chunks} c"), F.lit("q"))).first()[0] == "## Context\n{chunks} c\n\n## Question\nq\n"
    (tmp_path / "a.md").write_text("x")
    t = A.Templates(str(tmp_path))
    assert t.load("a.md") == "x"
    (tmp_path / "a.md").write_text("y")
    assert t.load("a.md") == "x"
    t.clear()
    assert t.load("a.md") == "y"
    with pytest.raises(ConfigurationError):
        t.load("none.md")
    with pytest.raises(ConfigurationError):
        A.Templates(str(tmp_path / "none"))
