"""Toxicity: non-negative positive-unlabelled learning on text.

Method: a linear classifier in numpy is trained from confirmed toxic examples and from
unlabelled text.  With class prior p its risk is p * R+(positive as 1) + max(0, R(unlabelled
as 0) - p * R(positive as 0)): the unlabelled risk is corrected by the share of positives in
it, and where the correction would turn it negative, the step goes the other way.

A text's features are its distinct words and the character 4-grams of those words, hashed;
ids, languages, sources and labels are never features.  A word's weight depends on the word
alone, so a worker keeps a table of word weights and scoring is one lookup per word.

Training takes at most ``POSITIVES`` toxic rows and ``UNLABELLED`` other rows, chosen by a
hash of the id and never held out (crc32 of the id modulo 5 is 0); the prior is that of the
labelled training rows, by a count over all of them.  Buckets are counted and chosen by
Spark; only the samples' chosen buckets come to the driver.  All other rows are scored from their whole texts without a shuffle.

Defined cases: a null or empty text has no words and gets the score of the bias alone;
without toxic labels every score is below 0.5; repeated rows are scored alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from skein.llm.common import cut, few_ids, filter_arrow, held_out_column, labelled_sample, map_arrow, one_text

POSITIVES, UNLABELLED, BUCKETS, CHOSEN = 2048, 6144, 1 << 18, 2048
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words of a worker's weight table.
CACHE_WORDS = 500_000


def word_features(word: bytes) -> list[int]:
    """Buckets of a lower-cased, stripped word: the word itself and its character 4-grams with its ends marked."""
    text = b"^" + word + b"$"
    out = [zlib.crc32(b"w" + word) % BUCKETS]
    out += {zlib.crc32(text[i : i + 5]) % BUCKETS for i in range(max(1, len(text) - 4))}
    return out


def words(text: bytes) -> set[bytes]:
    """Distinct words of a text, ASCII lower-cased, without ASCII punctuation around them."""
    return {w.strip(_PUNCTUATION) for w in set(text.lower().split())}


@dataclass
class Model:
    """Weights of the chosen buckets, and a bias; a text's margin is the bias and the weights of the buckets its words have."""

    weight: dict[int, float]
    bias: float


def choose(sample: DataFrame, n_positive: int, n_unlabelled: int) -> list[int]:
    """Buckets that are clearly more frequent in positive texts than in unlabelled ones: at most ``CHOSEN``, best first.

    ``sample`` holds (label, buckets); copies of a text count once.
    """
    each = sample.select("label", F.explode("buckets").alias("bucket"))
    df = each.groupBy("bucket").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("u"))
    expected = n_positive * (F.col("u") + 0.5) / (n_unlabelled + 1)
    z = (F.col("p") - expected) / F.sqrt(expected + 0.5)
    least = max(5, n_positive // 100)
    rows = df.withColumn("z", z).where((F.col("z") > 5) & (F.col("p") + 0.5 > 2.5 * (expected + 0.5)) & (F.col("p") >= least))
    return [r["bucket"] for r in rows.orderBy(F.desc("z"), "bucket").limit(CHOSEN).collect()]


def risks(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Of margins: the positives' risk ``prior * R+(p)`` and the corrected negative risk ``R-(u) - prior * R-(p)`` (logistic loss)."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of what a step lowers by each margin: the sum of both risks; where the corrected one is below zero, its negative."""
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    if risks(zp, zu, prior)[1] >= 0:
        return np.full(len(zp), -prior / len(zp)), sigmoid(zu) / len(zu)
    return prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)  # step back


def train(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.1, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Non-negative PU training on positive rows ``xp`` and unlabelled rows ``xu``: weights and bias.

    Full-batch Adam minimises the corrected logistic risk.
    """
    w, b = np.zeros(xp.shape[1]), -2.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        narrow = w.astype(np.float32)  # the rows' own type, so that products copy no row
        cp, cu = slopes((xp @ narrow).astype(float) + b, (xu @ narrow).astype(float) + b, prior)
        grad = np.append(xp.T @ cp.astype(np.float32) + xu.T @ cu.astype(np.float32) + l2 * w, cp.sum() + cu.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _buckets(rows: dict) -> dict:
    return {"label": rows["label"], "buckets": [sorted({b for w in words(t or b"") for b in word_features(w)}) for t in rows["text"]]}


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on bounded samples of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Held-out rows are in neither sample, and the prior counts none of their labels.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out_column())
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    none = Model({}, -4.0)
    if not toxic:
        return none
    prior = min(0.9, max(1e-3, toxic / n))
    text = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).where(~held_out_column())
    samples = labelled_sample(labels.where("toxic = 1"), "toxic", positives).unionByName(few_ids(docs, unlabelled, 23).withColumn("label", F.lit(0)))
    rows = one_text(text.join(F.broadcast(samples), "doc_id"), "label").select("text", "label")
    sample = cut(map_arrow(rows, _buckets, "label int, buckets array<int>").distinct())
    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not (size.get(0) and size.get(1)):
        return none
    chosen = choose(sample, size[1], size[0])
    place = {b: i for i, b in enumerate(chosen)}
    own = sample.select("label", F.array_intersect("buckets", F.array(*map(F.lit, chosen)) if chosen else F.array().cast("array<int>")).alias("own")).toPandas()
    x = np.zeros((len(own), len(chosen)), np.float32)
    for i, buckets in enumerate(own["own"]):
        x[i, [place[b] for b in buckets]] = 1
    y = own["label"].to_numpy() == 1
    w, b = train(x[y], x[~y], prior)
    return Model(dict(zip(chosen, w.tolist())), b)


class WordWeights(dict):
    """Word to its chosen buckets, for the few words that have any; emptied when it holds ``CACHE_WORDS`` words."""

    def __init__(self, model: Model):
        self.weight = model.weight

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        clean = word.strip(_PUNCTUATION)
        found = self[word] = tuple(b for b in word_features(clean) if b in self.weight)
        return found


def _scores(model: Model, tables: dict, texts: list[bytes]) -> list[float]:
    table = tables.setdefault(0, WordWeights(model))
    out = []
    for t in texts:
        own: set[int] = set()
        for found in filter(None, map(table.__getitem__, set(t.lower().split()))):
            own.update(found)
        z = model.bias + sum(model.weight[b] for b in sorted(own))
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_column: str = "doc_id") -> DataFrame:
    """``(id, score, predicted)`` for every whole text: a score of 0 to 1, and 1 where it is at least ``threshold``."""
    tables: dict[int, WordWeights] = {}

    def run(rows: dict) -> dict:
        out = _scores(model, tables, [t or b"" for t in rows["text"]])
        return {id_column: rows[id_column], "score": out, "predicted": [int(s >= threshold) for s in out]}

    docs = docs.select(id_column, F.col("text").cast("string").cast("binary").alias("text"))
    return map_arrow(docs, run, StructType([docs.schema[0]]).add("score", DoubleType()).add("predicted", IntegerType()))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all the columns of ``docs``."""
    model = fit(docs, labels)
    tables: dict[int, WordWeights] = {}
    return filter_arrow(docs, lambda texts: [s < threshold for s in _scores(model, tables, texts)])
