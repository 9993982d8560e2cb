"""The pipeline against a brute-force version of each stage, and operators on tables with clashing columns, ties and no rows."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import boosting, html, packing, pii, quality, secrets, sentencepiece, simhash, topk, toxicity, urls
from tests.llm.test_operators import HEX, LABEL, SECRET_PATTERNS, TOKENIZER, VOCABULARY, docs, prose, slow_components, slow_fingerprint, words_of

cp = pytest.importorskip("corpus_pipeline")


def walk(forest, x):
    """A score by walking each tree."""
    z = forest.base
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
        z += forest.value[node]
    return 1 / (1 + np.exp(-z))


def slow_quality(rows, forest):
    kept = []
    for row in rows:
        n, _, _, _, repeated, features = quality.counts((row["text"] or "").encode())
        if n >= 20 and 100 * repeated <= 30 * n and walk(forest, np.array(features, np.float32).astype(float)) >= 0.5:
            kept.append(row)
    return kept


def slow_toxicity(rows, model):
    kept = []
    for row in rows:
        buckets = {b for w in words_of(row["text"] or "") for b in toxicity.word_features(w.encode().lower().strip(toxicity._PUNCTUATION))}
        if model.bias + sum(model.weight.get(b, 0) for b in buckets) < 0:
            kept.append(row)
    return kept


def slow_dedup(rows):
    fps = [slow_fingerprint(r["text"] or "") for r in rows]
    group = slow_components(fps, list(range(len(rows))))
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, fps[i] - (1 << 64) * (fps[i] >> 63)))
    first = {}
    for i in order:
        first.setdefault(group[i], i)
    return [rows[i] for i in first.values()]


def slow_redact(rows):
    found, owners, repositories = [], {}, {}
    patterns = SECRET_PATTERNS | {"token": (secrets.TOKEN, 0, 0, 0)}
    for row in rows:
        spans = []
        for pattern, group, least, flags in patterns.values():
            for m in re.finditer(pattern, row["text"] or "", flags | re.A):
                if len(m.group(group)) >= least:
                    spans.append((m.end() - len(m.group(group)), m.end(), m.group(group)))
                    owners.setdefault(m.group(group), set()).add(row["source"])
                    repositories.setdefault(m.group(group), set()).add((row["source"], row["lang"]))
        found.append(spans)
    out = []
    for row, spans in zip(rows, found):
        text, mask = row["text"], [False] * len(row["text"] or "")
        for a, b, value in spans:
            if len(owners[value]) <= secrets.MOST_OWNERS and len(repositories[value]) <= secrets.MOST_REPOSITORIES:
                mask[a:b] = [True] * (b - a)
        if any(mask):
            # spans that touch are masked each by itself, so marks are set by the merged live spans
            live = sorted((a, b) for a, b, _ in spans if all(mask[a:b]))
            merged = []
            for a, b in live:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in reversed(merged):
                text = text[:a] + "<secret>" + text[b:]
        out.append((row["doc_id"], text))
    return out


def test_every_stage_equals_brute_force(spark, tmp_path):
    q = random.Random(21)
    foul = "scumbag vile rotten filth"
    texts = [prose(i, 60) for i in range(90)] + [prose(i, 50) + " " + foul for i in range(100, 140)] + [" ".join(f"{w}###" for w in prose(i, 60).split()) for i in range(200, 240)]
    texts += [prose(3, 60), prose(5, 60) + " tail", prose(7, 60).upper(), None, "", "short", f"{prose(901, 50)} token = \"{HEX}\" end", f"{prose(902, 50)} password=example123456 x", f"{prose(903, 50)} password=example123456 y"]
    order = list(range(len(texts)))
    q.shuffle(order)
    table = docs(spark, [texts[i] for i in order], order)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 130 <= i < 170), int(90 <= i < 130)) for i in range(170)], LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    labels, base = spark.read.parquet(str(tmp_path / "labels.parquet")), str(tmp_path)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(cp.STAGES)
    key = lambda rows: sorted(map(str, rows))

    kept = steps["quality"](spark, table, base).collect()
    assert key(kept) == key(slow_quality(table.collect(), quality.fit(table, labels))) and {r["doc_id"] for r in kept} & set(range(130, 170)) == set()
    table = spark.createDataFrame(kept, table.schema).cache()
    kept = steps["toxicity"](spark, table, base).collect()
    assert key(kept) == key(slow_toxicity(table.collect(), toxicity.fit(table, labels))) and not any(foul in r["text"] for r in kept)
    table = spark.createDataFrame(kept, table.schema).cache()
    kept = steps["near_dedup"](spark, table, base).collect()
    assert key(kept) == key(slow_dedup(table.collect())) and 0 < table.count() - len(kept) <= 3
    table = spark.createDataFrame(kept, table.schema).cache()
    kept = steps["secrets"](spark, table, base).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted(slow_redact(table.collect())) and all(r["n_chars"] == len(r["text"]) for r in kept)
    table = spark.createDataFrame(kept, table.schema).cache()
    pieces = steps["packing"](spark, table, base).toPandas()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in table.collect():
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces.doc_id == r["doc_id"]].sort_values("start")
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist() and own.length.sum() == len(ids)


#: Names that operators use for their own columns, here as columns of the input.
CLASHES = "id fp row n sums group label score predicted held_out found base spans kind start end value hash live repository owner component_id fingerprint least root __fp_ kept features failed shard block rank host path rule verdict pattern url_ bucket"


def test_extra_columns_with_clashing_names(spark):
    texts = [prose(i, 40) for i in range(6)] + [prose(1, 40), None, f"token={HEX} sk_Live9a8b7c6d5e4f3g2h1i0jZZ a@b.org"]
    plain = docs(spark, texts)
    wide = plain.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES.split())))
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)], LABEL)
    wide_labels = labels.withColumns({"label": F.lit(1), "text": F.lit("t"), "id": F.lit(0)})
    key = lambda df: sorted(map(str, df.collect()))
    forest = quality.fit(wide, wide_labels)
    assert key(quality.judge(plain, forest)) == key(quality.judge(wide, forest))
    model = toxicity.fit(wide, wide_labels)
    assert key(toxicity.score(plain, model)) == key(toxicity.score(wide, model))
    for run in (simhash.near_duplicates, secrets.find, pii.find, lambda d: packing.pack(d.coalesce(1), TOKENIZER), lambda d: sentencepiece.round_trip(d, TOKENIZER.replace("word_bpe_49k.json", "piece_bpe_32k.model"))):
        assert key(run(plain)) == key(run(wide))
    for run in (simhash.deduplicate, secrets.redact, lambda d: quality.filter_quality(d, wide_labels), lambda d: toxicity.filter_toxic(d, wide_labels)):
        out = run(wide)
        assert out.columns == wide.columns and key(out.select(*plain.columns)) == key(run(plain))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(25)], "vec_id long, embedding array<float>")
    assert key(topk.search(vectors)) == key(topk.search(vectors.select("*", *(F.lit("x").alias(c) for c in CLASHES.split()), F.lit(1).alias("query_id"))))
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>some text that is read</p>")], "page_id long, url string, html string")
    wide_pages = pages.select("*", *(F.lit("x").alias(c) for c in CLASHES.split()), F.lit("y").alias("text"))
    assert key(urls.judge(pages)) == key(urls.judge(wide_pages)) and key(html.main_text(pages)) == key(html.main_text(wide_pages))


def test_nothing_to_learn_from_and_nothing_to_judge(spark, tmp_path):
    none, no_labels = docs(spark, []), spark.createDataFrame([], LABEL)
    some = docs(spark, [prose(1, 40), None])
    for rows, labels in ((none, no_labels), (some, no_labels), (none, spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABEL))):
        assert quality.judge(rows, quality.fit(rows, labels)).count() == toxicity.score(rows, toxicity.fit(rows, labels)).count() == rows.count()
    none.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_ties_score_alike_and_the_threshold_is_kept(spark):
    forest = boosting.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0), list(quality.FEATURES.values()))
    rows = quality.judge(docs(spark, [prose(1, 40)] * 3), forest).collect()
    assert len({r["quality_score"] for r in rows}) == 1 and all(r["quality_score"] == 0.5 and r["kept"] for r in rows)  # at the threshold: kept
    model = toxicity.Model({b: 0.5 for b in toxicity.word_features(VOCABULARY[0].encode())[:1]}, -0.5)
    got = toxicity.score(docs(spark, [VOCABULARY[0], f"{VOCABULARY[0]} {VOCABULARY[0]}", "other"]), model).collect()
    assert got[0]["score"] == got[1]["score"] == 0.5 and [r["predicted"] for r in got] == [1, 1, 0]
