"""Sources, store, ingest state, embedding, streams."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import wikitext
from skein.operators import embed, ingest, metadata
from skein.operators.store import ChunkStore, decode_metadata, encode_metadata
from skein.session import ConfigurationError, NotFoundError, ProviderError, ValidationError
from skein.sources import archive, wiki
from skein.streaming import ingest as stream

XML = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">
<page><title>Alpha</title><ns>0</ns><id>1</id><revision><timestamp>2024-01-01T00:00:00Z</timestamp><text bytes="9" xml:space="preserve">== H ==
'''Bold''' [[Old Name|x]] [[Beta]] [[Nowhere]]</text></revision></page>
<page><id>2</id><ns>0</ns><title>Beta</title><revision><text>[[Alpha]] text</text></revision></page>
<page><title>Old Name</title><ns>0</ns><id>3</id><redirect title="Beta &amp;amp; Co" /><revision><text>#REDIRECT</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>4</id><revision><text>no</text></revision></page>
<page><title>Empty</title><ns>0</ns><id>5</id><revision></revision></page>
</mediawiki>"""


@pytest.fixture(scope="module")
def xml(tmp_path_factory):
    path = tmp_path_factory.mktemp("xml") / "w.xml"
    path.write_text(XML)
    return str(path)


def test_articles_of_an_export(spark, xml):
    got = {r["wiki_id"]: r for r in wiki.articles(spark, xml).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"]["content"] == "## H\n**Bold** [x](Beta & Co) [Beta](Beta) [Nowhere](Nowhere)"
    assert got["1"]["last_updated"].startswith("2024-01-01") and got["2"]["last_updated"] == ""
    assert [r["wiki_id"] for r in wiki.articles(spark, xml, ["2"]).collect()] == ["2"]


def test_redirects_resolve_alike_everywhere(spark, tmp_path):
    text = "{{Infobox town|name=[[A]]|near=[[B]] and [[C]]|by=[[Foo (x)|f]]}}\n[[A]] [[B|b]] [[Foo (x)]] [[A {{t}}]] [w](A) [[[A]]] [[None such]]"
    pages = [("P", text, None), ("Q", "no links", None), ("A", "#", "B"), ("B", "#", "C"), ("Foo (x)", "#", "Bar (y)"), ("A  z", "#", "D")]
    xml = "".join(f"<page><title>{t}</title><ns>0</ns><id>{i}</id>{f'<redirect title=\"{r}\" />' if r else ''}<revision><text>{x}</text></revision></page>\n" for i, (t, x, r) in enumerate(pages))
    (tmp_path / "w.xml").write_text(f"<mediawiki>\n{xml}</mediawiki>")
    got = {r["wiki_id"]: r.asDict() for r in wiki.articles(spark, str(tmp_path / "w.xml")).collect()}
    table = {t: r for t, _, r in pages if r}
    assert set(got) == {"0", "1"}
    assert got["0"]["content"] == wikitext.to_markdown(text, table) and (got["0"]["infobox"], got["0"]["infobox_links"]) == wikitext.infobox(text, table)
    assert got["0"]["infobox_links"] == ["B", "C", "Bar (y)"] and "[B](B) [b](C) [Bar (y)](Bar (y)) [B](B)" in got["0"]["content"] and "[w](A)" in got["0"]["content"]


def test_redirects_titles_edges(spark, xml):
    raw = wiki.pages(spark, xml)
    assert [tuple(r) for r in wiki.redirects(raw).collect()] == [("Old Name", "Beta & Co")]
    assert {r["title"]: r["id"] for r in wiki.titles(raw).collect()} == {"Alpha": "1", "Beta": "2", "Old Name": "3", "Old_Name": "3", "Empty": "5"}
    assert [r["dst_title"] for r in wiki.edges(raw).where("src_id = '1'").orderBy("pos").collect()] == ["Old Name", "Beta", "Nowhere"]


def test_archive_round_trip(spark, tmp_path):
    rows = [("1", "It's: a/b", "2024", "## H\n\nText", 3), ("2", "Beta", "2023", "More", 1)]
    articles = spark.createDataFrame(rows, "wiki_id string, title string, last_updated string, content string, word_count int")
    archive.write(articles, str(tmp_path / "a"))
    assert sorted(os.listdir(tmp_path / "a")) == ["Beta.md", "Its-_a-b.md"]
    (tmp_path / "a" / "bad.md").write_text("no front matter")
    (tmp_path / "a" / "blank.md").write_text("---\ntitle: x\nwiki_id: ''\nlast_updated: y\n---\nbody")
    (tmp_path / "a" / "free.md").write_text("---\r\ntitle: Free\r\nwiki_id: 7\r\nlast_updated: z\r\n---\r\n\r\none two three\r\n")
    for load in (archive.load, archive.load_yaml):
        got = {r["wiki_id"]: (r["title"], r["content"], r["word_count"]) for r in load(spark, str(tmp_path / "a")).collect()}
        assert got == {"1": ("It's: a/b", "## H\n\nText", 3), "2": ("Beta", "More", 1), "7": ("Free", "one two three", 3)}
    assert [r["wiki_id"] for r in archive.load(spark, str(tmp_path / "a"), ["2"]).collect()] == ["2"]
    assert tuple(archive.counts(spark, str(tmp_path / "a")).first()) == (5, 3, 2)
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in archive.rejected(archive.files(spark, str(tmp_path / "a"))).collect()} == {"bad.md": "no front matter", "blank.md": "no wiki_id"}
    assert [r["wiki_id"] for r in archive.load(spark, str(tmp_path / "a"), in_order=True).collect()] == ["2", "1", "7"]
    assert [r["title"] for r in archive.load(spark, str(tmp_path / "a"), spark.createDataFrame([(7,)], "id int")).collect()] == ["Free"]


def test_archive_is_read_by_few_tasks(spark, tmp_path):
    """Files of a plain folder are dealt out by their number; what Spark's reader alone can read gives the same rows."""
    for i in range(300):
        (tmp_path / f"It's #{i} é.md").write_text(f"---\ntitle: T{i}\nwiki_id: {i}\nlast_updated: z\n---\nbody {i}\n")
    (tmp_path / "_hidden.md").write_text("no")
    (tmp_path / "other.txt").write_text("no")
    read = archive.files(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(read) == plain(archive.files(spark, str(tmp_path) + "/*.md")) and read.count() == 300
    assert plain(archive.files(spark, tmp_path.as_uri())) == plain(read)
    assert archive.load(spark, str(tmp_path)).count() == 300 and tuple(archive.counts(spark, str(tmp_path)).first()) == (300, 300, 0)


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids").write_text("# c\n 1 \n\n2\n")
    assert archive.id_list(spark, str(tmp_path / "ids")) == ["1", "2"]
    (tmp_path / "none").write_text("# c\n")
    with pytest.raises(ConfigurationError):
        archive.id_list(spark, str(tmp_path / "none"))


def test_json_files(spark, tmp_path):
    rows = spark.createDataFrame([("t", "a", "p", 0)], "chunk_text string, article_title string, section_path string, chunk_index int")
    archive.write_wrapped(rows, str(tmp_path / "c"), "chunks", version="1")
    assert archive.read_chunks(spark, str(tmp_path / "c")).count() == 1
    (tmp_path / "bad.json").write_text('{"chunks": [{"chunk_text": "x"}]}')
    with pytest.raises(ValidationError):
        archive.read_chunks(spark, str(tmp_path / "bad.json"))


def test_wrapped_json_is_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "WRAPPED", 1000)
    rows = spark.range(100).select(F.concat(F.lit("text \"\n "), F.col("id").cast("string")).alias("chunk_text"), F.lit("a").alias("article_title"), F.lit("s").alias("section_path"), F.col("id").cast("int").alias("chunk_index"))
    for name, given, least in (("many", rows, 5), ("none", rows.limit(0), 1)):
        path = tmp_path / name
        archive.write_wrapped(given, str(path), "chunks", version="1")
        files = [f for f in path.iterdir() if f.name.startswith("part-") and f.stat().st_size]
        documents = [json.loads(f.read_text()) for f in files]
        assert len(files) >= least and all(d["version"] == "1" for d in documents) and max(f.stat().st_size for f in files) < 1300
        assert sorted(r["chunk_index"] for d in documents for r in d["chunks"]) == sorted(r["chunk_index"] for r in given.collect())
    read = archive.read_chunks(spark, str(tmp_path / "many"))
    assert sorted(r["chunk_text"] for r in read.collect()) == sorted(r["chunk_text"] for r in rows.collect())


CHUNK = "id string, wiki_page_id string, article_title string, section_path string, chunk_text string, chunk_index int, article_last_updated string, links array<string>, embedding array<float>"


def rows_of(spark, *pages):
    return spark.createDataFrame([(f"{p}_{i}", p, f"T{p}", "S", f"text {i}", i, v, ["L"], [1.0, 0.0]) for p, n, v in pages for i in range(n)], CHUNK)


def test_store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    assert store.count() == 0 and store.health() == {"status": "healthy", "count": 0}
    store.add(rows_of(spark, ("1", 3, "v1"), ("2", 2, "v1"), ("3", 1, "v1")))
    assert store.count() == 6 and store.get("1_2").first()["chunk_text"] == "text 2"
    assert store.find({"article_title": "T2", "chunk_index": 1}).count() == 1 and store.find(limit=2).count() == 2
    with pytest.raises(NotFoundError):
        store.get("9_9")
    assert store.delete_articles(spark.createDataFrame([("2",), ("x",)], "wiki_page_id string")) == 2
    store.delete_chunk("1_0")
    store.replace_articles(rows_of(spark, ("1", 1, "v2"), ("4", 1, "v1")))
    assert {(r["wiki_page_id"], r["stored"]) for r in store.versions().collect()} == {("1", "v2"), ("3", "v1"), ("4", "v1")}
    with pytest.raises(ValidationError):
        store.add(rows_of(spark, ("5", 1, "v")).withColumn("embedding", F.lit(None).cast("array<float>")))
    assert store.purge() == 3 and store.count() == 0


def test_metadata_round_trip(spark):
    rows = spark.createDataFrame([("1", ["a"], ["n"]), ("2", [], [])], "wiki_page_id string, links array<string>, character_names array<string>")
    flat = encode_metadata(rows)
    assert {r["wiki_page_id"]: r["links"] for r in flat.collect()} == {"1": '["a"]', "2": None} and "character_names" not in flat.columns
    assert {r["wiki_page_id"]: r["links"] for r in decode_metadata(flat).collect()} == {"1": ["a"], "2": []}
    assert decode_metadata(flat.withColumn("links", F.lit("{bad"))).first()["links"] == []


@pytest.mark.parametrize(("mode", "stored", "new", "action"), [
    ("differs", None, "a", "add"), ("differs", "a", "a", "skip"), ("differs", "b", "a", "update"), ("newer", "a", "b", "update"), ("newer", "b", "a", "skip"), ("newer", "a", "", "skip"), ("newer", None, "", "add"),
])
def test_change_detection(spark, mode, stored, new, action):
    known = spark.createDataFrame([("1", stored)] if stored else [], "wiki_id string, stored string")
    assert ingest.changes(spark.createDataFrame([("1", new)], "wiki_id string, last_updated string"), known, mode).first()["action"] == action


def test_progress(spark):
    rows = spark.createDataFrame([("i1", "a", "v1", "completed", 3), ("i2", "b", "v1", "processing", 4)], "id string, article_id string, article_last_updated string, status string, batch_number int")
    rows = rows.withColumns({"processed_at": F.lit(None).cast("timestamp"), "created_at": F.current_timestamp(), "error_message": F.lit(None).cast("string")})
    new = spark.createDataFrame([("b", "v2", "completed", 5), ("c", "v1", "pending", 5)], "article_id string, article_last_updated string, status string, batch_number int")
    got = {r["article_id"]: r for r in ingest.upsert_progress(rows, new).collect()}
    assert got["b"]["id"] == "i2" and got["b"]["status"] == "completed" and got["b"]["processed_at"] is not None
    assert got["c"]["status"] == "pending" and got["c"]["id"] and got["a"]["article_last_updated"] == "v1"
    assert ingest.last_batch(rows).first()[0] == 3 and ingest.in_work(rows).count() == 1
    assert {r["status"] for r in ingest.roll_back(rows).collect()} == {"completed", "pending"}
    todo = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("d", "v1")], "wiki_id string, last_updated string")
    assert sorted(r["wiki_id"] for r in ingest.to_process(todo, rows).collect()) == ["b", "d"]
    with pytest.raises(ValueError):
        ingest.move(rows, todo, "unknown")


def test_batches(spark):
    got = ingest.batches(spark.range(250), "id", 100).orderBy("id").collect()
    assert [r["batch"] for r in got] == [i // 100 + 1 for i in range(250)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_batches_of_a_large_table(spark, adaptive):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 3_000_000
        rows = spark.range(n).select((F.col("id") * 7_919 % n).alias("id"))  # each number once, out of order
        wrong = ingest.batches(rows, "id", 100).where(F.col("batch") != F.floor(F.col("id") / 100) + 1).count()
        assert wrong == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_embedding_keeps_rows_and_skips_blanks(spark):
    got = embed.embed(spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "i int, chunk_text string"), embed.hashing(8)).orderBy("i").collect()
    assert len(got[0]["embedding"]) == 8 and got[1]["embedding"] is None and got[2]["embedding"] is None
    assert abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-5


def test_embedding_and_chunking_hold_few_rows_at_once(spark, monkeypatch):
    """A batch of many rows goes on in parts: ten at a time here, in order and without a loss."""
    from skein.operators import chunking

    seen = []
    fake = type("Rows", (), {"schema": spark.range(0).select(F.lit("").alias("chunk_text")).schema, "mapInPandas": lambda self, run, schema: run})()
    monkeypatch.setattr(embed, "HELD", 10)
    for part in embed.embed(fake, embed.hashing(4))(iter([pd.DataFrame({"chunk_text": [f"w{i}" for i in range(95)]})])):
        seen += [len(part)]
    assert seen == [10] * 9 + [5]
    monkeypatch.setattr(chunking, "HELD", 10)
    articles = spark.createDataFrame([(str(i), f"T{i}", "body") for i in range(95)], "wiki_id string, title string, content string").coalesce(1)
    assert sorted(int(r["wiki_page_id"]) for r in chunking.chunk(articles).collect()) == list(range(95))


def test_a_text_whose_words_cancel_out_has_a_vector_of_norm_1():
    (vector,) = embed.hashing(16)()(["Der stsch erung erau."])
    assert abs(float((vector**2).sum()) - 1) < 1e-5 and not embed.hashing(16)()([" "])[0].any()


def test_retries():
    waits, calls = [], []

    def fails(texts):
        calls.append(texts)
        raise ProviderError("busy", retryable=True)

    assert embed.with_retries(fails, ["a"], wait=waits.append) == [None] and waits == [1.0, 2.0] and len(calls) == 3
    with pytest.raises(ProviderError):
        embed.with_retries(lambda t: (_ for _ in ()).throw(ProviderError("key")), ["a"])


def test_ingest_and_again(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    articles = spark.createDataFrame([("1", "A", "v1", "## H\nText [x](B)"), ("2", "B", "v1", "Other text")], "wiki_id string, title string, last_updated string, content string")
    run = lambda a: ingest.ingest(a, store, lambda c: embed.embed(c, embed.hashing(16)), metadata.extract, str(tmp_path / "i"))
    assert run(articles) == {"add": 2, "chunks": 2, "failed": 0, "tokens": 6, "cost_usd": 0.0}
    assert store.count() == 2 and store.get("1_0").first()["links"] == ["B"]
    assert run(articles) == {"skip": 2, "chunks": 0, "failed": 0, "tokens": 0, "cost_usd": 0.0}
    changed = articles.withColumn("last_updated", F.when(F.col("wiki_id") == "2", "v2").otherwise(F.col("last_updated")))
    assert run(changed)["update"] == 1 and store.count() == 2
    assert ingest.ingest(articles.limit(1), store, None, metadata.extract, force=True, dry_run=True)["chunks"] == 1


def test_ids_seen_again_in_a_run_are_passed_over(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    articles = spark.createDataFrame([("1", "A", "v1", "first text"), ("1", "A", "v2", "second text"), ("2", "B", "v1", "x y")], "wiki_id string, title string, last_updated string, content string").coalesce(1)
    out = ingest.ingest(articles, store, lambda c: embed.embed(c, embed.hashing(4)), metadata.extract)
    assert out == {"add": 2, "chunks": 2, "failed": 0, "tokens": 2, "cost_usd": 0.0}
    assert sorted((r["id"], r["article_last_updated"], r["chunk_text"]) for r in store.rows().collect()) == [("1_0", "v1", "first text"), ("2_0", "v1", "x y")]


def test_all_embeddings_failing_is_an_error(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    articles = spark.createDataFrame([("1", "A", "v1", "first text")], "wiki_id string, title string, last_updated string, content string")
    with pytest.raises(ValidationError):
        ingest.ingest(articles, store, lambda c: c.withColumn("embedding", F.lit(None).cast("array<float>")), metadata.extract)
    assert store.count() == 0


def test_store_changes_are_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    store = ChunkStore(spark, path, buckets=4)
    for v in range(5):
        store.replace_articles(rows_of(spark, *((str(p), 2, f"v{v}") for p in range(6))))
    assert ChunkStore(spark, path).state()[1]["buckets"] == 4 and store.count() == 12
    assert len([f for f in os.listdir(path) if f.startswith("v=")]) == 2  # the present state and the one before
    before = store.rows().collect()
    number, manifest = store.state()
    store._write(store._prepared(rows_of(spark, ("0", 9, "v9")), 4))  # a writer that dies before its manifest
    assert sorted(map(str, ChunkStore(spark, path).rows().collect())) == sorted(map(str, before))
    store._publish(manifest, number + 1)
    with pytest.raises(ValidationError):  # a second writer that started from the same state
        store._publish(manifest, number + 1)


def test_shared_folder_is_needed_on_clusters():
    from types import SimpleNamespace

    from skein import shared

    session = lambda master, held=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: held), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    with pytest.raises(ConfigurationError):
        shared.folder(session("spark://host:7077"))
    assert shared.folder(session("spark://host:7077", "/shared")) == "/shared" and shared.folder(session("local[2]"))


def test_stream_ingest_is_incremental(spark, tmp_path):
    source, store = tmp_path / "in", ChunkStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(r, "wiki_id string, title string, last_updated string, content string")
    rows(("1", "A", "v1", "text one")).write.parquet(str(source))
    run = lambda: stream.ingest_stream(stream.read(spark, str(source)), store, lambda c: embed.embed(c, embed.hashing(4)), metadata.extract, str(tmp_path / "cp"))
    run()
    rows(("2", "B", "v1", "text two"), ("1", "A", "v1", "text one")).write.mode("append").parquet(str(source))
    run()
    assert sorted(r["id"] for r in store.rows().collect()) == ["1_0", "2_0"]


def test_stream_windows_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", "click" if i % 2 else "view", float(i), i % 4) for i in range(60)]
    rows.append(("2024-02-01 00:00:00", "view", 0.0, 0))  # moves the watermark on, so that all earlier windows close
    table = spark.createDataFrame(rows, "ts string, event_type string, value double, user_id long").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "e"))
    events = stream.read(spark, str(tmp_path / "e"))
    query = stream.window_counts(events).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    want = stream.window_counts(table).where("start < '2024-02-01'")
    assert sorted(map(tuple, spark.table("w").where("start < '2024-02-01'").collect())) == sorted(map(tuple, want.collect()))
    assert stream.session_counts(table).agg(F.sum("n")).first()[0] == 61


def test_schema_changes(spark):
    old = spark.createDataFrame([("1", "a", 5)], "id string, article_id string, gone int")
    new = ingest.conform(old)
    assert [f.split()[0] for f in ingest.PROGRESS.split(", ")] == new.columns and new.first()["status"] is None
    down = ingest.migrate(new, 1)
    assert "batch_number" not in down.columns and ingest.migrate(down).columns == new.columns
    with pytest.raises(ValueError):
        ingest.migrate(new, 9)


def test_store_drop(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.drop()
    assert store.health()["status"] == "unhealthy" and ChunkStore(spark, str(tmp_path / "s")).count() == 0


def test_sql_functions(spark):
    from skein.functions import text
    from skein.operators import chunking

    text.register(spark)
    chunking.register(spark)
    assert spark.sql("select skein_title_case('a-b') t").first()["t"] == "A-B"
    rows = spark.sql("select * from values ('T', '## A\nx') as v(title, body), lateral skein_chunks(title, body)").collect()
    assert [(r["section_path"], r["chunk_text"]) for r in rows] == [("A", "## A\nx")]


def test_json_log():
    import io
    import json

    from skein import log

    out = io.StringIO()
    log.setup(stream=out).info("done", extra={"fields": {"n": 3}})
    assert json.loads(out.getvalue()) | {"time": 0} == {"time": 0, "level": "info", "logger": "skein", "event": "done", "n": 3}
