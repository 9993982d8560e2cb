"""Quality rules: fixed counts of a document, then gradient-boosted trees over its statistics.

Method: a forest is trained on document statistics with monotonic constraints (more
repetition, more symbols, more capitals never raise a score), flattened into numpy node
arrays, and applied to batches of rows at once.

Training reads at most ``SAMPLE`` labelled rows (never held-out ones); all other rows are
scored from their whole texts, without a shuffle.

Defined cases: a null or empty text has no words and fails the base rule (fewer than 20
words); without labels the forest is the constant 0.5 and only the base rule decides;
repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructType

from skein.llm import boosting
from skein.llm.common import filter_arrow, labelled_sample, map_arrow, one_text

SAMPLE = 8192
WINDOW = 8
#: Symbols that the base rules count, and characters that end a sentence.
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: Statistics of the forest, and whether more of it may only lower (-1) or raise (1) the score.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "unique_share": 0, "upper_share": -1, "bang_share": -1, "digit_share": 0, "pipe_share": -1,
    "stop_share": 0, "words_per_line": 0, "top_word_share": 0, "alpha_share": 0,
}
#: Common short words of the corpus's languages.
STOP_WORDS = frozenset(w.encode() for w in "the of and to in is a that for it with as was on be by de la le et les des un une que en el los y se del las der die und den von zu das mit".split())


def _windows(ids: np.ndarray) -> np.ndarray:
    """For each word, whether it is in a window of ``WINDOW`` words that is in the text twice or more."""
    n = len(ids) - WINDOW + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    rank, span = ids.astype(np.int64), 1
    while span < WINDOW:  # exact: a window's rank is that of its two halves
        m = len(rank) - span
        _, rank = np.unique(rank[:m] * (int(rank.max()) + 1) + rank[span : span + m], return_inverse=True)
        span *= 2
    again = np.bincount(rank)[rank] > 1
    marks = np.zeros(len(ids) + 1, np.int64)
    marks[:n][again] += 1
    marks[WINDOW : n + WINDOW][again] -= 1
    return np.cumsum(marks)[:-1] > 0


def counts(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """Words, their code points, symbols, repeated lines, repeated words and ``FEATURES`` of one text."""
    words = text.split()
    n = len(words)
    chars = b"".join(words)
    word_chars = len(chars.decode())
    symbols = len(_SYMBOLS.findall(text))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    duplicates = real = 0
    for line in lines:
        if line and not line.isspace():
            real += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = int(_windows(ids).sum()) if len(number) < n else 0
    some, letters = max(1, n), max(1, len(chars))
    upper = letters - len(chars.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = letters - len(chars.translate(None, b"0123456789"))
    most = int(np.bincount(ids).max()) if n else 0
    odd = len(re.findall(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]", chars))
    features = [
        float(np.log1p(n)), word_chars / some, symbols / some, duplicates / max(1, real), repeated / some,
        len(number) / some, upper / letters, chars.count(b"!") / some, digits / letters, chars.count(b"|") / some,
        sum(map(STOP_WORDS.__contains__, words)) / some, n / max(1, real), most / some, 1 - odd / letters,
    ]
    return n, word_chars, symbols, duplicates, repeated, features


def _fail(n: int, repeated: int) -> bool:
    return n < 20 or 100 * repeated > 30 * n


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> boosting.Forest:
    """A forest for ``labels.quality`` from at most ``sample`` labelled rows of ``docs``, one for an id."""
    chosen = one_text(docs.selectExpr("doc_id", "cast(text as string) text").join(F.broadcast(labelled_sample(labels, "quality", sample)), "doc_id"), "label")

    def stats(rows: dict) -> dict:
        got = [counts((t or "").encode()) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "label": rows["label"], "failed": [_fail(c[0], c[4]) for c in got], "features": [c[5] for c in got]}

    rows = map_arrow(chosen, stats, "doc_id long, label int, failed boolean, features array<float>").where("not failed").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["features"].tolist(), np.float64).reshape(len(rows), len(FEATURES))
    return boosting.train(x, rows["label"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, forest: boosting.Forest, threshold: float = 0.5, id_column: str = "doc_id") -> DataFrame:
    """Each row's id, the base counts, ``base_failed``, the forest's ``quality_score`` and ``kept``."""

    def run(rows: dict) -> dict:
        got = [counts((t or "").encode()) for t in rows["text"]]
        x = np.array([c[5] for c in got], np.float32).astype(float).reshape(len(got), len(FEATURES))
        score = forest.score(x)
        failed = [_fail(c[0], c[4]) for c in got]
        return {id_column: rows[id_column]} | {n: [c[i] for c in got] for i, n in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))} | {
            "base_failed": failed, "quality_score": score, "kept": [not f and s >= threshold for f, s in zip(failed, score)]}

    docs = docs.select(id_column, "text")
    schema = StructType([docs.schema[0]])
    for name, kind in [*((n, LongType()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()), ("base_failed", BooleanType()), ("quality_score", DoubleType()), ("kept", BooleanType())]:
        schema = schema.add(name, kind)
    return map_arrow(docs, run, schema)


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all the columns of ``docs``."""
    forest = fit(docs, labels)

    def keep(texts: list[bytes]) -> list[bool]:
        got = [counts(t) for t in texts]
        score = forest.score(np.array([c[5] for c in got], np.float32).astype(float).reshape(len(got), len(FEATURES)))
        return [not _fail(c[0], c[4]) and s >= threshold for c, s in zip(got, score)]

    return filter_arrow(docs, keep)
