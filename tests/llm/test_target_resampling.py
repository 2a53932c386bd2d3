"""Importance resampling against brute force, whole and in pieces, and its edge cases."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import CLASH, COLUMNS, corpus, ordered

from quarrion.llm import target_resampling as T
from quarrion.llm.arrow import ALNUM_LOWER

FIELDS = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("piece", [1, 2, 7, 60, 1 << 18])
@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a b c", "!x! Y--zé 日本 12", "w" * 90 + " v", " ".join(random.Random(1).choices(["ab", "c", "éé"], k=400))])
def test_ring_equals_whole_runs(text, piece):
    words = text.encode().translate(ALNUM_LOWER).split()
    want = sorted(zlib.crc32(b" ".join(words[i : i + k])) % 97 for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = list(T.feature_buckets(text.encode(), buckets=97, piece=piece))
    assert sorted(x for _, f in found for x in f.tolist()) == want and sum(n for n, _ in found) == len(words)


def test_equals_brute_force(spark):
    rows = corpus()
    rng = random.Random(5)
    rows += [(1000 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=30)), None, None, 1) for i in range(60)] + [(2000, "tie " * 25, None, None, 1)] * 3
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    docs = docs.select("*", *(F.lit(f"clash {c}").alias(c) for c in (*CLASH, "weight", "eligible", "place", "bucket", "rank") if c not in docs.columns))
    items = ["alpha beta gamma", "Delta, alpha!", None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for share in (5, 40, 100):
        got = T.importance_resample(docs, target, share=share).select(*FIELDS).collect()
        want = brute.op13([(r[0], r[1]) for r in rows], items, share=share)
        assert ordered(r[:4] for r in got) == ordered(w[:4] for w in want)
        assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((w[4], w[3]) for w in want if w[4])
        assert {(r.doc_id, r.rank) for r in got if r.rank and r.doc_id != 2000} == {(w[0], w[4]) for w in want if w[4] and w[0] != 2000}


def test_draw_leans_to_the_target(spark):
    """Documents that share the target's words are drawn far more often than others; the same rows give the same draw."""
    rng = random.Random(6)
    near, far = ["sun", "moon", "star", "sky"], ["tax", "form", "fee", "due"]
    data = [(i, " ".join(rng.choices(near if i % 4 == 0 else far, k=25))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(near * 5),)], "text string")
    drawn = {r.doc_id: r.rank for r in T.importance_resample(docs, target, share=10).filter("rank is not null").collect()}
    assert sorted(drawn.values()) == list(range(1, 41)) and all(i % 4 == 0 for i in drawn)
    again = T.importance_resample(docs.repartition(3), target, share=10).filter("rank is not null").collect()
    assert {r.doc_id: r.rank for r in again} == drawn


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a b c",)], "text string")
    assert T.importance_resample(empty, target).count() == 0
    text_ids = spark.createDataFrame([("x", "w " * 30), (None, None), ("y", "v " * 30)], "doc_id string, text string")
    got = {r.doc_id: r for r in T.importance_resample(text_ids, target.limit(0), share=50).collect()}
    assert got[None].n_features == 0 and got[None].weight == 0 and got[None].rank is None
    assert {got["x"].rank, got["y"].rank} == {1, None}
    assert (T.bucket_gains(np.zeros(4, np.int64), np.zeros(4, np.int64)) == 0).all()


def test_very_long_text(spark):
    """A text of millions of characters, and a word of a million, are read in pieces."""
    text = "ab cd ef " * 300_000 + "g" * 1_000_000
    docs = spark.createDataFrame([(1, text), (2, "ab cd")], "doc_id long, text string")
    got = {r.doc_id: r for r in T.importance_resample(docs, docs).collect()}
    assert got[1].n_words == 900_001 and got[1].n_features == 3 * 900_001 - 3 and got[2].n_features == 3
