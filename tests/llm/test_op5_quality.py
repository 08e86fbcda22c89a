import math
import random
import zlib

import numpy as np
import zstandard

from sheetloom.llm import quality, queries


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op5_compression_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[i].score, q) for i, q in labels.items() if rows[i].held_out]
    s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.97 and ((s >= 0.7) == y).mean() > 0.97 and ((s - y) ** 2).mean() < 0.03


def test_labels_of_the_held_out_fold_teach_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == quality.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_scores_against_brute_force(spark, sf_dir, odd_docs, odd_rows):
    """Every score anew: cut into blocks, compressed by one-shot calls with the model's dictionaries, and mapped by the curve."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.slope > 0 and len(model.good) == len(model.bad) > 0

    def size(data, dictionary):
        known = zstandard.ZstdCompressionDict(dictionary)
        n = max(1, math.ceil(len(data) / quality.BLOCK))
        cuts = [len(data) * i // n for i in range(n + 1)]
        return sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(data[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def score(text):
        data = (text or "").encode()
        difference = np.mean([(size(data, b) - size(data, g)) / (len(data) + 32) for g, b in zip(model.good, model.bad, strict=True)])
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * difference + model.height))))

    for frame, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd_docs, [(r[0], r[1]) for r in odd_rows])):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in quality.score(frame, model).collect())
        want = sorted((i is not None, i or 0, score(t)) for i, t in rows)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)


def test_the_curve_has_the_greatest_likelihood():
    dice = np.random.default_rng(4)
    x = dice.normal(0, 0.02, 4000)
    y = (dice.random(4000) < 1 / (1 + np.exp(-(60 * x + 0.7)))).astype(float)
    slope, height = quality.curve(y, x, ((y == 0).sum(), (y == 1).sum()))
    loss = lambda a, b: np.log1p(np.exp(-np.where(y == 1, 1, -1) * (a * x + b))).mean()
    best = loss(slope, height)
    assert all(best <= loss(slope + a, height + b) + 1e-6 for a in (-3, 0, 3) for b in (-0.1, 0, 0.1))
    assert abs(slope - 60) < 8 and abs(height - 0.7) < 0.1


def test_repeated_and_contradicting_labels(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    assert quality.fit(docs.unionByName(docs), labels.unionByName(labels)) == model  # repeated rows teach once
    first = labels.where("quality IN (0, 1)").orderBy("doc_id").first().doc_id
    without = quality.fit(docs, labels.where(f"doc_id <> {first}"))
    assert quality.fit(docs, labels.unionByName(labels.where(f"doc_id = {first}").selectExpr("doc_id", "1 - quality AS quality", "toxic"))) == without


def test_odd_rows(spark, odd_docs, no_docs, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.fit(no_docs, labels).good == []


def late(n, seed):
    """Texts of 40 KB: all begin alike for 17 KB, and bad ones differ after that."""
    dice = random.Random(seed)
    text = lambda letters, size: "".join(" " + "".join(dice.choice(letters) for _ in range(5)) for _ in range(size // 6))
    labels = [(i, i % 2, 0) for i in range(n)]
    return [(i, text("abcd", 17_000) + text("abcd" if q else "uvwx", 23_000)) for i, q, _ in labels], labels


def test_texts_teach_whole(spark):
    rows, labels = late(80, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert max(map(len, model.good)) > 39_000
    scores = {r.doc_id: r.score for r in quality.score(docs, model).where("held_out").collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.7 > max(s for i, s in scores.items() if not i % 2)


def test_fewer_rows_rather_than_prefixes(spark, monkeypatch):
    rows, labels = late(40, 6)
    monkeypatch.setattr(quality, "TEACH_BYTES", 90_000)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for (learnt,), k in ((model.bad, 0), (model.good, 1)):
        whole = [t.encode() for i, t in rows if i % 2 == k and t.encode() in learnt]
        assert len(whole) == 2 and len(learnt) == sum(map(len, whole))
