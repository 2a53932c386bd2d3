"""The quality classifier: its counts against brute force, its network against numeric gradients, and held-out accuracy."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
import xxhash
from oracle import DATA
from pyspark.sql import functions as F
from test_llm import CLASH, COLUMNS, corpus, ordered

from quarrion.llm import quality as Q
from quarrion.llm import queries


def auc(score: np.ndarray, y: np.ndarray) -> float:
    good, bad = score[y == 1], score[y == 0]
    return float(((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad)))


def test_held_out_accuracy(spark):
    """On rows that it never learned from, it tells the qualities apart and its probabilities are calibrated."""
    folder = DATA.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op11_quality_classifier"](spark, folder)
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s, p = (np.array([r[c] for r in rows], float) for c in ("quality", "score", "predicted"))
    assert len(rows) > 50 and 0 < y.mean() < 1
    assert auc(s, y) > 0.97
    assert (p == y).mean() > 0.95
    s = np.clip(s, 1e-6, 1 - 1e-6)
    assert Q.loss(np.log(s / (1 - s)), y) < 0.5 * Q.loss(np.log(np.full(len(y), y.mean()) / (1 - y.mean())), y)
    assert got.count() == 1000 and got.filter("score < 0 or score > 1 or predicted != int(score >= 0.3)").count() == 0


def test_context_sums_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "TOKENS", 50)
    monkeypatch.setattr(Q, "PIECE", 20)
    texts = [r[1] for r in corpus()[:40] if r[1]] + ["One two!! TWO, été 日本 x", "lone", ""]
    places, signs = Q.index_vectors()
    want = brute.contexts(texts, places, signs, lambda w: xxhash.xxh3_64_intdigest(w.encode().lower()) & (Q.CLASSES - 1), Q.CLASSES, Q.DIMS, Q.REACH)
    import pyarrow as pa

    (found,) = Q._context(iter([pa.record_batch([pa.array([*texts, None])], ["text"])]))
    got = np.zeros(Q.CLASSES * Q.DIMS, int)
    got[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    assert (got.reshape(Q.CLASSES, Q.DIMS) == np.array(want)).all()


def test_pooled_vectors_equal_brute_force():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(Q.CLASSES + 2, Q.DIMS)).astype(np.float32)
    tokens = ["STOP", "the", "the", "end", "!!!", "A", "É"]
    own = [vectors[xxhash.xxh3_64_intdigest(t.encode().lower()) & (Q.CLASSES - 1)] for t in tokens]
    want = (np.sum(own, 0) + vectors[Q.SHOUTED] + vectors[Q.REPEATED]) / len(tokens)
    assert Q.pooled("STOP the the end!!! A É".encode(), vectors, Q.Codes()) == pytest.approx(want, abs=1e-5)
    assert not Q.pooled(b"", vectors, Q.Codes()).any()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, Q.DIMS))
    chance = Q.logistic(3 * x[:, 0] * x[:, 1] + x[:, 2])
    y = (rng.random(4000) < chance).astype(float)
    net = Q.trained(x[:3000], y[:3000])
    assert Q.loss(net.logits(x[:3000]), y[:3000]) < 0.6 * np.log(2)
    z = net.logits(x[3000:])
    t = Q.fitted_temperature(z, y[3000:])
    assert t > 1 and all(Q.loss(z / t, y[3000:]) <= Q.loss(z / u, y[3000:]) + 1e-3 for u in (t * 1.1, t / 1.1, 1.0))
    apart = Q.fitted_temperature(np.array([9.0, -9.0] * 50), np.array([1.0, 0.0] * 50))
    assert 1 < apart < 8
    again = Q.trained(x[:3000], y[:3000])
    assert (again.logits(x) == net.logits(x)).all()


def held_out(doc) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


def test_awkward_rows(spark):
    """Nulls, repeated rows and labels, clashing names: one result a row; held-out labels and ids change nothing."""
    rows = corpus()
    rng = random.Random(1)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    docs = docs.select("*", *(F.lit(f"clash {c}").alias(c) for c in (*CLASH, "quality", "part", "id", "x") if c not in docs.columns))
    marks = [(i, int("token" not in (rows[i][1] or ""))) for i in range(120)] + [(5, 1), (None, 0), (7, None), (999, 1)]
    labels = spark.createDataFrame([(d, q, "clash") for d, q in marks], "doc_id long, quality int, text string")
    got = Q.quality_scores(docs, labels).collect()
    assert ordered((r.doc_id, r.held_out) for r in got) == ordered((r[0], held_out(r[0])) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(rng.randint(0, 1))).otherwise(F.col("quality")))
    again = Q.quality_scores(docs.repartition(3), other).collect()
    assert ordered((r.doc_id, round(r.score, 6)) for r in again) == ordered((r.doc_id, round(r.score, 6)) for r in got)
    text_ids = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert Q.quality_scores(text_ids, named).count() == len(rows)


def test_without_two_qualities(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in Q.quality_scores(docs, none).collect()} == {(0.5, 1)}
    good = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in Q.quality_scores(docs, good).collect())
    assert Q.quality_scores(docs.limit(0), good).count() == 0
    mixed = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert Q.quality_scores(docs.limit(0), mixed).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 1_000_000 + "x" * 1_000_000), (2, "word")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in Q.quality_scores(docs, labels).collect())
