"""Importance resampling of documents towards a target, over hashed n-grams.

Features are runs of 1 to RUNS consecutive words. One scan of a text feeds zlib's running checksum: a ring holds the states
of the last starts, and each further word extends every state by a blank and the word, so a run's checksum never reads a
byte twice and no run is ever spelled out. A state modulo BUCKETS is the feature's bucket.

The first pass counts buckets over all documents and over the target. A bucket's gain is the logarithm, in thousandths,
of its smoothed frequency in the target over that in the documents. The second pass adds up the gains of each document; with
Gumbel noise from the document's id, the highest scores are a draw without replacement in proportion to the exponential
of the weights. Their ranks come from a range-partitioned numbering of all documents.

Only BUCKETS counts and gains pass through the driver, however many documents there are. Texts are read in pieces.

Defined results: a null or empty text has no features and weight 0. Documents of fewer than `least_words` words are scored,
but neither counted for the share nor drawn. A null id counts as the empty text in the noise and comes last among ties.
Repeated rows are documents of their own, each with its own rank. Without documents there are no rows; an empty target
gives gains for it all the same. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import ALNUM_LOWER, slices, texts
from quarrion.llm.shared import written
from quarrion.operators.numbering import numbered
from quarrion.shipping import shipped

RUNS, BUCKETS, SEED, SHARE, LEAST_WORDS = 3, 10_000, 42, 5, 20
#: Bytes of a text whose words are held at once (a longer word is taken whole).
PIECE = 1 << 18
#: What no word has: the ASCII characters but digits and letters.
_GAP = re.compile(rb"[\x00-/:-@\[-`{-\x7f]")


def word_pieces(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + piece)
        end = gap.start() if gap else len(text)
        if words := text[at:end].translate(ALNUM_LOWER).split():
            yield words
        at = end


def ring_states(words: list[bytes], ring: list[int], runs: int = RUNS) -> tuple[list[list[int]], list[int]]:
    """Checksums of all runs that end in these words, by their length, and the ring to go on with.

    ring[k] is the state of the last k + 1 words before these, as far as there are so many.
    """
    spaced = [b" " + w for w in words]
    states, after = [list(map(crc32, words))], []
    for k in range(runs):
        after.append(states[k][-1] if states[k] else None)
        if k + 1 < runs:
            before = [*ring[k : k + 1], *states[k][:-1]]
            states.append(list(map(crc32, spaced[len(spaced) - len(before) :], before)))
    return states, [x for x in after[: runs - 1] if x is not None]


def feature_buckets(text: bytes, runs: int = RUNS, buckets: int = BUCKETS, piece: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of a text, the number of its words and the bucket of each feature that ends in it."""
    ring: list[int] = []
    for words in word_pieces(text, piece):
        states, ring = ring_states(words, ring, runs)
        yield len(words), np.concatenate([np.frombuffer(array("I", x), np.uint32) for x in states]) % np.uint32(buckets)


def _counted(batches: Iterator[pa.RecordBatch], runs: int, buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in slices(batches):
        for text in texts(batch.column("text")):
            for _, found in feature_buckets(text, runs, buckets):
                total += np.bincount(found, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(rows: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket."""
    own = shipped(rows).select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    found = own.mapInArrow(partial(_counted, runs=runs, buckets=buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of target over source frequency, one added to each count, rounded down."""
    most_s, most_t = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * most_s / ((s + 1.0) * most_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(batches: Iterator[pa.RecordBatch], sent, runs: int) -> Iterator[pa.RecordBatch]:
    gains = sent.value
    for batch in slices(batches):
        words, features, weights = [], [], []
        for text in texts(batch.column("text")):
            sums = np.zeros(3, np.int64)
            for n, found in feature_buckets(text, runs, len(gains)):
                sums += (n, len(found), gains[found].sum())
            for held, x in zip((words, features, weights), sums.tolist(), strict=True):
                held.append(x)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, features, weights))], ["doc_id", "n_words", "n_features", "weight"])


def importance_resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score, and rank among the drawn share (a percentage), else null."""
    gains = bucket_gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_text_col, runs, buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gains)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    weighed = own.mapInArrow(partial(_weighed, sent=sent, runs=runs), f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    even = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(even)))
    scored = written(weighed.withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= least_words))
    drawn = scored.filter("eligible").count() * share // 100
    placed = numbered(scored, [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
