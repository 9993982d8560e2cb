"""Steps of the commands: what they compute, and what they don't compute twice."""

import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.functions import text, wikitext
from skein.operators import embed, vector
from skein.operators.store import ChunkStore


def test_a_long_infobox_is_split_in_one_pass_over_its_links():
    """every bar was compared with every link before."""
    markup = "{{Infobox x" + "".join(f"|k{i}=[[A{i}|a]] {{{{t|{i}}}}}" for i in range(20_000)) + "}}"
    began = time.perf_counter()
    box, links = wikitext.infobox(markup)
    assert box.count("\n") == 20_001 and box.endswith("- **K19999**: a") and links == [f"A{i}" for i in range(20_000)]
    assert wikitext.looked_up(markup) == links and time.perf_counter() - began < 10


def test_articles_are_made_without_what_they_do_not_keep(spark):
    """markup and links went to Python and back, and links were read, only to be dropped."""
    pages = spark.createDataFrame([("1", "[[A]] {{Infobox b|n=[[A|x]]}}", ["A"], ["B"]), ("2", None, None, None)], "wiki_id string, text string, _sources array<string>, _targets array<string>")
    lean = wikitext.convert_pages(pages, raw=False)
    assert lean.columns == ["wiki_id", "content", "word_count", "infobox", "infobox_links"]
    assert lean.orderBy("wiki_id").collect() == wikitext.convert_pages(pages).select(lean.columns).orderBy("wiki_id").collect()
    assert lean.orderBy("wiki_id").first()["content"] == "[B](B)"


def test_pages_with_the_same_id_look_up_a_redirect_once(spark):
    pages = spark.createDataFrame([("1", "[[A]] [[C]]")] * 3 + [(None, "[[A]]")], "wiki_id string, text string")
    got = wikitext.with_redirects(pages, spark.createDataFrame([("A", "B")], "source string, target string")).collect()
    assert sorted((r["wiki_id"] or "", r["_sources"]) for r in got) == [("", None)] + [("1", ["A"])] * 3


def test_one_search_computes_a_distance_once(spark):
    """a filter on the distance computed it a second time for every row, and the query's norm with each."""
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 1.0]), ("e", [1.0]), ("f", [-1.0, 0.0])], "chunk_id string, embedding array<float>")
    found = vector.search(rows, [2.0, 0.0], 5)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [("a", 0.0, 1), ("d", 0.292893, 2), ("f", 2.0, 3)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 2


def test_an_empty_store_is_no_job_of_python(spark, tmp_path):
    """an empty store's rows came from Python workers, one a core."""
    rows = ChunkStore(spark, str(tmp_path / "s")).rows()
    assert rows.count() == 0 and rows.dtypes[7:] == [("links", "array<string>"), ("embedding", "array<float>")]
    assert "RDD" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_tried_where_their_marks_are(spark):
    texts = ["Codex: A", "Index: B", "Horus Heresy: Book 3: C", "White Dwarf  9", "Campaign Book: D", "Imperial Armour: E", "Codex Supplement: F", "codex: g", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.source_books(F.col("t")).alias("b"), text.character_names(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["b"] for r in got] == [["A"], ["B"], ["3 C", "Book 3: C"], ["9"], ["D"], ["E"], ["F"], [], [], None]
    assert [r["n"] for r in got] == [[]] * 9 + [None]


def test_hashing_of_a_batch_is_that_of_its_words():
    texts = ["a b a", "", " ", "x", "Der stsch erung erau."]
    got = embed.hashing(16)()(texts)
    for t, v in zip(texts, got):
        want = np.zeros(16, np.float32)
        for w in t.lower().split():
            want[zlib.crc32(w.encode()) % 16] += 1 if zlib.crc32(w.encode()) >> 31 else -1
        if not want.any() and t.strip(" "):
            want[zlib.crc32(t.encode()) % 16] = 1
        assert np.allclose(v, want / max(np.linalg.norm(want), 1e-9)) and v.dtype == np.float32
