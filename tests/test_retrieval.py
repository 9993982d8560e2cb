"""Keyword, vector and hybrid search, expansion, links and graphs."""

import math

import pytest
from pyspark.sql import functions as F

from skein.operators import expand, hybrid, keyword, links, vector
from skein.session import ConfigurationError, ExpansionConfig, HybridConfig, ValidationError, from_env

DOCS = [("1_0", "the red fox"), ("2_0", "the blue whale sings"), ("3_0", "red red rose"), ("4_0", ""), ("5_0", "grey wolf")]


@pytest.fixture(scope="module")
def index(spark):
    return keyword.build(spark.createDataFrame(DOCS, "chunk_id string, chunk_text string"))


def brute(query, k):
    docs = {i: t.split() for i, t in DOCS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    terms = {t for d in docs.values() for t in d}
    raw = {t: math.log(n - (df := sum(t in d for d in docs.values())) + 0.5) - math.log(df + 0.5) for t in terms}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    score = {i: round(sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split() if t in idf), 6) for i, d in docs.items()}
    return sorted(((i, s) for i, s in score.items()), key=lambda p: (-p[1], p[0]))[:k]


@pytest.mark.parametrize("text", ["red", "red red rose", "the fox unknown", "unknown"])
def test_keyword_search_equals_brute_force(spark, index, text):
    q = spark.createDataFrame([(0, text)], "query_id long, text string")
    got = [(r["chunk_id"], r["score"]) for r in keyword.search(index, q, 5).orderBy("rank").collect()]
    assert got == brute(text, 5)


def test_empty_query_is_an_error(spark, index):
    with pytest.raises(ValidationError):
        keyword.search(index, spark.createDataFrame([(0, " ")], "query_id long, text string"))


def test_index_round_trip(spark, index, tmp_path):
    index.save(str(tmp_path / "i"))
    back = keyword.load(spark, str(tmp_path / "i"))
    assert keyword.stats(back).first() == keyword.stats(index).first()
    q = spark.createDataFrame([(0, "red")], "query_id long, text string")
    assert keyword.search(back, q, 3).orderBy("rank").collect() == keyword.search(index, q, 3).orderBy("rank").collect()


def test_lowercase_is_an_option(spark):
    made = keyword.build(spark.createDataFrame([("a", "Red"), ("b", "blue")], "chunk_id string, chunk_text string"), lowercase=True)
    q = spark.createDataFrame([(0, "RED")], "query_id long, text string")
    assert keyword.search(made, q, 1).first()["chunk_id"] == "a"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.6, 0.8], "y"), ("c", [0.0, 2.0], "x"), ("d", [1.0, 0.0], "y")], "chunk_id string, embedding array<float>, kind string")


def test_vector_search(vectors):
    got = vector.search(vectors, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [(r["chunk_id"], r["distance"]) for r in got] == [("a", 0.0), ("d", 0.0), ("b", 0.4)]
    assert [r["chunk_id"] for r in vector.search(vectors, [1.0, 0.0], 3, {"kind": "x"}).orderBy("rank").collect()] == ["a", "c"]
    with pytest.raises(ValidationError):
        vector.search(vectors, [])


def test_zero_vectors_have_no_distance(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 1.0])], "chunk_id string, embedding array<float>")
    assert [r["chunk_id"] for r in vector.search(rows, [1.0, 0.0], 5).collect()] == ["b"]
    assert [r["chunk_id"] for r in vector.search_batch(rows, {1: [1.0, 0.0]}, 5).collect()] == ["b"]


def test_batch_equals_single(vectors):
    got = vector.search_batch(vectors, {"q": [0.0, 1.0]}, 4).orderBy("rank").collect()
    assert [(r["chunk_id"], r["distance"], r["rank"]) for r in got] == [(r["chunk_id"], r["distance"], r["rank"]) for r in vector.search(vectors, [0.0, 1.0], 4).orderBy("rank").collect()]


def test_fusion(spark):
    hits = lambda *ids: spark.createDataFrame([(0, i, r + 1) for r, i in enumerate(ids)], "query_id long, chunk_id string, rank int")
    got = hybrid.fuse(hits("a", "b"), hits("a", "c")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("a", round(1 / 61, 9)), ("b", round(0.5 / 62, 9)), ("c", round(0.5 / 62, 9))]
    swapped = hybrid.fuse(hits("a", "c"), hits("a", "b")).collect()
    assert {r["chunk_id"]: r["score"] for r in swapped} == {r["chunk_id"]: r["score"] for r in got}
    weighted = hybrid.fuse(hits("a"), hits("a"), HybridConfig(vector_weight=0.7, keyword_weight=0.3), 1).first()
    assert weighted["score"] == round(1 / 61, 9)
    stored = spark.createDataFrame([("a", "text")], "chunk_id string, text string")
    assert hybrid.with_rows(hybrid.fuse(hits("a"), hits("z")), stored).count() == 1


def test_configuration(monkeypatch):
    with pytest.raises(ConfigurationError):
        HybridConfig(vector_weight=0.9, keyword_weight=0.9)
    with pytest.raises(ConfigurationError):
        HybridConfig(vector_weight=-0.1, keyword_weight=1.1)
    with pytest.raises(ConfigurationError):
        ExpansionConfig(depth=3)
    monkeypatch.setenv("X_TOP_K", "7")
    assert from_env(HybridConfig, "X_").top_k == 7
    monkeypatch.setenv("X_TOP_K", "seven")
    with pytest.raises(ConfigurationError):
        from_env(HybridConfig, "X_")


CHUNKS = [("a0", "A", 0, ["B", "C"]), ("a1", "A", 1, []), ("b0", "B", 0, ["D"]), ("b1", "B", 1, ["A"]), ("b2", "B", 2, []), ("c0", "C", 0, ["D"]), ("d0", "D", 0, []), ("d1", "D", 1, [])]


@pytest.mark.parametrize(("config", "ids"), [
    (ExpansionConfig(0, 30), ["a0"]), (ExpansionConfig(1, 30), ["a0", "b0", "b1", "c0"]), (ExpansionConfig(2, 30), ["a0", "b0", "b1", "c0", "d0"]),
    (ExpansionConfig(1, 2), ["a0", "b0"]), (ExpansionConfig(1, 0), []),
])
def test_expansion(spark, config, ids):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, article_title string, chunk_index int, links array<string>")
    hits = spark.createDataFrame([(0, "a0", 0.5, 1)], "query_id long, chunk_id string, score double, rank int")
    got = expand.expand(hits, chunks, config).orderBy("place").collect()
    assert [r["chunk_id"] for r in got] == ids
    assert all(r["score"] == (0.5 if r["depth"] == 0 else 0.0) for r in got)


def test_redirects_resolve_one_step(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    got = links.resolve(spark.createDataFrame([("a",), ("x",)], "link string"), r).collect()
    assert sorted(x["link"] for x in got) == ["b", "x"]
    md = spark.createDataFrame([("1", "[t](a) [u](x)")], "wiki_id string, content string")
    assert links.resolve_markdown(md, r).first()["content"] == "[t](b) [u](x)"


def test_redirects_in_markdown_resolve_at_once(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    md = spark.createDataFrame([("1", "x [t](a) [u](b) (a) [v](x)"), ("2", "[s](b)[r](a)"), ("3", None)], "wiki_id string, content string")
    got = {x["wiki_id"]: x["content"] for x in links.resolve_markdown(md, r).collect()}
    assert got == {"1": "x [t](b) [u](a) (a) [v](x)", "2": "[s](a)[r](b)", "3": None}


def test_breadth_first_follows_a_long_chain(spark):
    edges = spark.createDataFrame([(str(i), f"T{i + 1}", 0) for i in range(53)], "src_id string, dst_title string, pos int").coalesce(1).cache()
    titles = spark.createDataFrame([(f"T{i}", str(i)) for i in range(54)], "title string, id string").coalesce(1).cache()
    assert [r["id"] for r in links.breadth_first(edges, titles, "0", 100).orderBy("place").collect()] == [str(i) for i in range(54)]
    assert links.breadth_first(edges, titles, "0", 100, most_depth=2).count() == 3


def test_breadth_first_order_equals_a_queue(spark):
    graph = {"1": ["3", "2", "9"], "2": ["4"], "3": ["4", "5", "1"], "4": ["6"], "5": [], "6": []}
    edges = spark.createDataFrame([(s, f"T{d}", p) for s, ds in graph.items() for p, d in enumerate(ds)], "src_id string, dst_title string, pos int")
    titles = spark.createDataFrame([(f"T{i}", i) for i in graph], "title string, id string")
    queue, order = ["1"], []
    while queue:
        node = queue.pop(0)
        if node not in order and node in graph:
            order.append(node)
            queue += graph[node]
    got = [r["id"] for r in links.breadth_first(edges, titles, "1", 100).orderBy("place").collect()]
    assert got == order
    assert [r["id"] for r in links.breadth_first(edges, titles, "1", 3).orderBy("place").collect()] == order[:3]
    named = links.titled(links.breadth_first(edges, titles, "1", 2), titles).orderBy("place").collect()
    assert named[0]["title"] == "T1"


def test_levels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert {(r["node"], r["depth"]) for r in links.levels(edges, 1, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_quantiles_are_exact_over_many_partitions(spark):
    import numpy as np

    from skein.operators import analytics

    q = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(q.choice([1, 1, 1, 1, 2, 3], 4000), np.round(q.gamma(2, 30, 4000), 1))] + [(4, 5.0), (5, None)]
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in analytics.quantiles(spark.createDataFrame(rows, "g int, v double").repartition(7), "v", {"a": 0.5, "b": 0.95, "c": 0.0}, ["g"]).collect()}
    for g in (1, 2, 3, 4):
        own = [v for k, v in rows if k == g]
        assert np.allclose(got[g], [np.quantile(own, s) for s in (0.5, 0.95, 0.0)])
    assert 5 not in got and analytics.sizes(spark.createDataFrame([], "w int"), "w").first().asDict() == {"n": 0, "total": 0, "median": None}


def test_containment_equals_a_scan(spark):
    from skein.operators import analytics

    docs = [(1, "the quick brown fox jumps"), (2, "xthe quick brown foxes"), (3, "quick  brown"), (4, "a b"), (5, "the\nquick brown fox")]
    items = [(1, "the quick brown fox"), (2, "a b"), (3, "quick  brown"), (4, "k brown f"), (5, "")]
    for some in (items, items[:1] + items[3:4]):
        got = analytics.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(some, "item_id int, text string"), "text", "text")
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted((d, i) for d, t in docs for i, p in some if p in t)


def test_stored_index_is_built_once_and_again_for_new_files(spark, tmp_path, monkeypatch):
    spark.createDataFrame(DOCS, "chunk_id string, chunk_text string").write.parquet(str(tmp_path / "d"))
    built, real = [], keyword.build
    monkeypatch.setattr(keyword, "build", lambda *a, **k: (built.append(1), real(*a, **k))[1])
    first, again = (keyword.stored(spark.read.parquet(str(tmp_path / "d")), "t") for _ in range(2))
    assert len(built) == 1 and first.facts == again.facts and first.facts["n_docs"] == 5
    plan = keyword.search(again, spark.createDataFrame([(0, "red fox")], "query_id long, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "bucket" in plan
    spark.createDataFrame([("9_0", "new red text")], "chunk_id string, chunk_text string").write.mode("append").parquet(str(tmp_path / "d"))
    assert keyword.stored(spark.read.parquet(str(tmp_path / "d")), "t").facts["n_docs"] == 6 and len(built) == 2
    with pytest.raises(ValidationError):
        keyword.build(spark.createDataFrame([], "chunk_id string, chunk_text string"))


def test_vector_tables_equal_batches(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 2)
    monkeypatch.setattr(vector, "SHARD", 2)
    asked = {"p": [0.0, 1.0], "q": [1.0, 0.0], "r": [0.6, 0.8]}
    queries = spark.createDataFrame([*asked.items(), ("none", None), ("zero", [0.0, 0.0])], "query_id string, vector array<double>")
    key = lambda rows: sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in rows.collect())
    assert key(vector.search_table(vectors, queries, 3)) == key(vector.search_batch(vectors, asked, 3))


def test_search_plans_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("chunk_id"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit("x").alias("kind"), F.lit("unused").alias("wide")).write.parquet(str(tmp_path / "v"))
    plan = vector.search(spark.read.parquet(str(tmp_path / "v")), [1.0], 3, {"kind": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(kind,x)" in plan and "wide" not in plan


def test_index_blocks_hold_their_chunks_and_bounded_text(spark, tmp_path, monkeypatch):
    """Chunks are dealt into blocks by the size of the text, none is cut, and a search sums up in blocks with the results of one block."""
    rows = spark.createDataFrame([(i, " ".join(["red", f"w{i % 7}", *[f"x{i}"] * (i % 3)]) + " pad" * 20) for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, f"red w{q} x{q + 5}") for q in range(7)], "query_id long, text string")
    found = lambda i: sorted(map(tuple, keyword.search(i, queries, 5).collect()))
    one = keyword.build(rows, "doc_id", "text", path=str(tmp_path / "one"))
    monkeypatch.setattr(keyword, "BLOCK", 2000)
    monkeypatch.setattr(keyword, "SUMMED", 50)
    many = keyword.build(rows, "doc_id", "text", path=str(tmp_path / "many"))
    many.save(str(tmp_path / "saved"))
    n = many.facts["blocks"]
    assert one.facts["blocks"] == 1 and n >= 9
    for index in (many, keyword.load(spark, str(tmp_path / "saved"))):
        # the file's number is the writing task's: a chunk's postings lie in one block
        where = index.postings.select("chunk_id", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).alias("block")).distinct()
        assert where.count() == 200 and where.select("block").distinct().count() > n // 2
        assert found(index) == found(one)
    plan = keyword.search(many, queries, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [query_id") < plan.index("Join") < plan.index("RepartitionByExpression [chunk_id")  # dealt by chunk before the join with the queries
