"""Text functions, wiki markup, file names, metadata."""

import time

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import wikitext as W


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("r")).first()["r"]


def test_tokens_drop_empty_ones_and_keep_punctuation(spark):
    assert one(spark, "  A b,\tc\n", T.tokens) == ["A", "b,", "c"]
    assert one(spark, "A B", lambda c: T.tokens(c, True)) == ["a", "b"]
    assert one(spark, "", T.word_count) == 0


def test_sentences(spark):
    assert len(one(spark, "First one. Second one! Third?", T.sentences)) == 3
    assert one(spark, "Dr. Smith met Mr. Brown. They left.", T.sentences) == ["Dr. Smith met Mr. Brown.", "They left."]
    assert one(spark, "Pi is 3.14. Next", T.sentences) == ["Pi is 3.14.", "Next"]
    assert one(spark, "Wait... What", T.sentences) == ["Wait... What"]
    assert one(spark, "J. Smith left", T.sentences) == ["J. Smith left"]


def test_paragraphs(spark):
    assert one(spark, "a\n\n\n b \n\n \n\nc", T.paragraphs) == ["a", "b", "c"]


def test_links(spark):
    text = "[A](B) [c](D (E)) [x](http://e.org) [y](#z) [again](B)"
    assert one(spark, text, T.links) == ["B", "D (E)"]


def test_character_names_by_count_then_first_mention(spark):
    assert one(spark, "[[A]] [[B|b]] [[B]] [[C]] [[D]] [[E]] [[F]]", T.character_names) == ["B", "A", "C", "D", "E"]


def test_source_books(spark):
    assert one(spark, "Codex: Space, Horus Heresy: Book 1: Betrayal.", T.source_books) == ["1 Betrayal", "Book 1: Betrayal", "Space"]
    assert one(spark, "nothing", T.source_books) == []


@pytest.mark.parametrize(("title", "name"), [("A B/C: D", "A_B-C-_D"), ("Émile Zola", "Emile_Zola"), ("__a--b__", "a-b"), ("日本", None), ("x" * 300, "x" * 255)])
def test_file_names(spark, title, name):
    assert one(spark, title, T.sanitize_filename) == name


def test_chunk_ids(spark):
    page, index = T.chunk_id_parts(F.lit("a_b_3"))
    assert tuple(spark.range(1).select(page, index).first()) == ("a_b", "3")
    assert one(spark, "x" * 201, T.preview) == "x" * 200 + "..."


def test_title_case_after_any_other_character(spark):
    assert one(spark, "first-founding emperor's", T.title_case) == "First-Founding Emperor'S"


MARKUP = """{{Infobox Chapter
| name = Black {{small|Templars}}
| primarch_name = [[Rogal Dorn|Dorn]]<br/>[[Sigismund]]
| image = [[File:x.png]]
}}
== History ==
'''Bold''' and ''italic'' with [[Old|shown]] and [[Plain]].
* item
# first
[https://e.org Site] [[Category:X]] {{cite|{{nested}}}}
=== History ===
[[File:a.jpg|thumb|[[Inner]] caption]]end"""


def test_markup_to_markdown():
    text = W.to_markdown(MARKUP, {"Old": "New"})
    assert text.startswith("## History\n**Bold** and *italic* with [shown](New) and [Plain](Plain).")
    assert "\n- item\n1. first\n[Site](https://e.org)" in text
    assert "### History\nend" in text and "{{" not in text and "Category" not in text


def test_level_one_headings_stay_headings():
    assert W.to_markdown("= Top =\n# one") == "# Top\n1. one"


def test_unbalanced_markup_is_kept():
    assert W.to_markdown("a {{b [[c]] d") == "a {{b [c](c) d"
    assert W.to_markdown("") == "" and W.to_markdown(None) == ""


def test_infobox():
    box, links = W.infobox(MARKUP, {"Sigismund": "First Captain"})
    assert box == "## Infobox: Chapter\n\n- **Name**: Black\n- **Primarch Name**: Dorn, Sigismund"
    assert links == ["Rogal Dorn", "First Captain"]
    assert W.infobox("{{Other}}") == (None, [])


def test_wiki_links():
    assert W.wiki_links("[[A|x]] [[B]] [[A]] [[File:c]]") == ["A", "B"]


def test_html(spark):
    assert one(spark, "<head>x</head><h1>T</h1><p>a &amp; <a href=\"/b\">b</a></p>", W.html_to_markdown) == "# T\n\na & [b](/b)"


def test_names_of_a_text_with_many_mentions(spark):
    """Counted in one pass over sorted mentions: every mention against every name would take minutes here."""
    names = [f"n{i * 7919 % 30000}" for i in range(60000)] + ["late"] * 5 + ["n7"] * 3
    text = "".join(f"[[{n}]]" for n in names) + "[[n5|x]][[n5]]"
    began = time.perf_counter()
    got = spark.createDataFrame([(text,), ("",), (None,), ("[[b]] [[a]] [[b]]",)], "t string").select(T.character_names(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [["n7", "late", "n5", "n0", "n7919"], [], None, ["b", "a"]] and time.perf_counter() - began < 60
