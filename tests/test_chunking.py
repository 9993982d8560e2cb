"""Sections, packing, merging and the whole chunker."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import chunking as C


def folded(spark, markdown, title="T"):
    row = spark.createDataFrame([(markdown, title)], "m string, t string").select(C.sections(F.col("m"), F.col("t")).alias("s")).first()
    return [(s["text"], s["path"]) for s in row["s"]]


NESTED = "intro\n## A\na\n### B\nb\n#### C\nc\n### D\nd\n## E\ne\n##### deep\n##\nx"


def test_sections_and_paths():
    got = C.sections_of(NESTED, "T")
    assert [p for _, p in got] == ["Root", "A", "A > B", "A > B > C", "A > D", "E"]
    assert got[-1][0] == "## E\ne\n##### deep\n##\nx"


def test_skipped_level_pops_more():
    assert [p for _, p in C.sections_of("## A\nx\n#### B\ny\n### C\nz", "T")] == ["A", "A > B", "C"]


def test_no_heading_is_one_section():
    assert C.sections_of("just text", "Title") == [("just text", "Title")]


def test_fold_equals_python(spark):
    for text in (NESTED, "just text", "## A\nx\n#### B\ny\n### C\nz", "\n\n## Only", "#### X\n## Y\n### Z"):
        assert folded(spark, text) == C.sections_of(text, "T"), text


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["## A", "### B", "#### C", "text", "", "##", "##### x"]), max_size=12))
def test_fold_equals_python_on_any_lines(spark, lines):
    text = "\n".join(lines)
    assert folded(spark, text) == C.sections_of(text, "T")


def test_small_section_is_whole():
    assert C.split_section("## H\ntext") == ["## H\ntext"]


def test_paragraphs_pack_below_the_budget_with_the_heading():
    text = "## H\n" + "\n\n".join("word " * 80 for _ in range(20))
    got = C.split_section(text)
    assert len(got) > 1 and all(t.startswith("## H\n\n") for t in got)
    body = "".join(t.removeprefix("## H\n\n") for t in got).replace("\n", "").replace(" ", "")
    assert body == ("word" * 80) * 20


def test_large_paragraph_splits_by_sentences():
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(200))
    got = C.split_section(text)
    assert len(got) > 2 and all(sum(map(C.estimate, C.sentences_in(t))) <= C.MAX_TOKENS for t in got)
    assert " ".join(" ".join(got).split()) == text


def test_huge_sentence_stays_whole():
    assert C.split_section("x" * 5000) == ["x" * 5000]


def test_small_chunks_join_the_next_one():
    assert C.merged([("a", 1), ("b" * 400, 2), ("c", 3)], 50) == [("a\n\n" + "b" * 400, 2), ("c", 3)]
    assert C.merged([("a", 1), ("b", 2)], 50) == [("a\n\nb", 2)]
    assert C.merged([], 50) == []


def test_merge_fold_equals_python(spark):
    cases = [[("a", "1"), ("b" * 400, "2"), ("c", "3")], [("a", "1"), ("b", "2")], [("a" * 300, "1")]]
    for case in cases:
        row = spark.createDataFrame([(case,)], "c array<struct<text:string,path:string>>").select(C.merge_small(F.col("c"), 50).alias("r")).first()
        assert [(r["text"], r["path"]) for r in row["r"]] == C.merged(case, 50)


def test_pack(spark):
    assert spark.range(1).select(C.pack(F.array(*map(F.lit, (60, 50, 40, 200, 1))), 100).alias("g")).first()["g"] == [0, 1, 1, 2, 3]


def test_chunks_of_articles(spark):
    rows = [("1", "A", "## H\n" + "text [x](Y) " * 30, "## Infobox", ["L"]), ("2", "B", "  ", None, None), ("3", None, "x", None, None)]
    got = C.chunk(spark.createDataFrame(rows, "wiki_id string, title string, content string, infobox string, infobox_links array<string>")).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["section_path"], r["chunk_index"], r["links"]) for r in got] == [("1_0", "Infobox", 0, ["L"]), ("1_1", "H", 1, ["Y"])]


def test_ids_are_unique_and_indices_contiguous(spark):
    md = "\n".join(f"## S{i}\n" + "Some words here. " * (i * 40) for i in range(8))
    got = C.chunk(spark.createDataFrame([("9", "T", md)], "wiki_id string, title string, content string")).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and len({r["chunk_id"] for r in got}) == len(got)
