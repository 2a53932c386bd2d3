"""Benchmark decontamination by a prefix-filtered set join.

An item gives its windows of ten words (a shorter one gives one window). The tokens of a window are ordered by
rarity in the corpus. Full containment is asked for, so the necessary prefix of a window is its single rarest token:
documents and windows are joined on that. The token's place in the window bounds where the window can start and,
with the window's length, which starts lie inside the document; the words there are then compared one by one.

The items go to the executors in blocks of bounded size (block_bytes of item text), one pass over the documents per
block, so nothing grows with the benchmark but the number of passes. Counts of the prefix words cover all documents.

Defined results: a null or empty text has no words, no hits and the digest of the empty text. Items without words
match nothing; items with equal ids count once. Items with a null id are one item: it gives hits and counts in n_items,
and the digest, of the ids found, leaves it out. Repeated rows give repeated results. The id keeps its type.
Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import ALNUM_LOWER, slices, texts
from quarrion.llm.shared import kind_of, written
from quarrion.shipping import shipped

WINDOW = 10
BLOCK_BYTES = 2 << 20

PAIR = "array<int>"
HITS = f"doc_id {{kind}}, h long, n_words long, starts {PAIR}, ends {PAIR}, items array<string>"
RESULT = "doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_LOWER).split()


def item_windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _counted(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known, counts = vocabulary.value, Counter()
    for batch in slices(batches):
        for text in texts(batch.column("text")):
            counts.update(filter(known.__contains__, words_of(text)))
    yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def prefix_index(items: list[tuple[str | None, bytes]], counts: dict[bytes, int], size: int = WINDOW) -> dict:
    """Rarest token -> (its place, window length) -> window -> ids of the items that have it."""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, text in items:
        for window in item_windows(words_of(text), size):
            if all(counts.get(w) for w in window):
                at = min(range(len(window)), key=lambda i: (counts[window[i]], window[i], i))
                index[window[at]][at, len(window)][window].add(item)
    return index


#: The index of the block that this worker last used.
_built: dict[str, dict] = {}


def _hits(batches: Iterator[pa.RecordBatch], sent, name: str) -> Iterator[pa.RecordBatch]:
    if name not in _built:
        _built.clear()
        _built[name] = prefix_index(*sent.value)
    index = _built[name]
    for batch in slices(batches):
        n_words, starts, ends, items = [], [], [], []
        for text in texts(batch.column("text")):
            words = words_of(text)
            n, found, which = len(words), set(), set()
            for i in [i for i, w in enumerate(words) if w in index]:
                for (at, length), windows in index[words[i]].items():
                    begin = i - at
                    if 0 <= begin <= n - length and (ids := windows.get(tuple(words[begin : begin + length]))):
                        found.add((begin, begin + length))
                        which |= ids
            runs: list[list[int]] = []
            for a, b in sorted(found):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            n_words.append(n)
            starts.append([a for a, _ in runs])
            ends.append([b for _, b in runs])
            items.append(list(which))
        lists = (pa.array(x, pa.list_(t)) for x, t in ((starts, pa.int32()), (ends, pa.int32()), (items, pa.string())))
        yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(n_words, pa.int64()), *lists], ["doc_id", "h", "n_words", "starts", "ends", "items"])


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_hit, n_items, digests = [], [], []
        for n, starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends", "items")), strict=True):
            change = np.zeros(n + 1, np.int32)
            np.add.at(change, starts, 1)
            np.add.at(change, ends, -1)
            n_hit.append(int((np.cumsum(change)[:n] > 0).sum()) if starts else 0)
            ids = set(items)
            n_items.append(len(ids))
            digests.append(hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest())
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _item_blocks(rows: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list:
    """Broadcast blocks of items, with the corpus counts of their words."""
    spark = shipped(rows).sparkSession
    wanted = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()[0]
    blocks, sent = max(1, -(-total // block_bytes)), []
    for block in range(blocks):
        own = [(r.item, r.text.encode()) for r in wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()]
        vocabulary = spark.sparkContext.broadcast(frozenset(w for _, t in own for w in words_of(t)))
        counts = rows.select("text").mapInArrow(partial(_counted, vocabulary=vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        sent.append(spark.sparkContext.broadcast((own, {bytes(r.word): r.n for r in counts})))
    return sent


def contamination_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, h (a hash of its text), n_words, runs of hit words as starts and ends, and the ids of the items found."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    passes = [rows.mapInArrow(partial(_hits, sent=sent, name=uuid.uuid4().hex), HITS.format(kind=kind_of(docs, id_col))) for sent in _item_blocks(rows, items, **options)]
    if len(passes) == 1:
        return passes[0]
    first = passes[0]
    rest = passes[1].filter("size(starts) > 0").withColumn("block", F.lit(1))
    for k, found in enumerate(passes[2:], 2):
        rest = rest.unionByName(found.filter("size(starts) > 0").withColumn("block", F.lit(k)))
    rest = written(rest).dropDuplicates(["doc_id", "h", "block"]).groupBy(F.col("doc_id").alias("r_id"), F.col("h").alias("r_h"))
    rest = rest.agg(*(F.flatten(F.collect_list(c)).alias(f"r_{c}") for c in ("starts", "ends", "items")))
    both = first.join(rest, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_h")), "left")
    return both.select("doc_id", "h", "n_words", *(F.when(F.col("r_h").isNull(), F.col(c)).otherwise(F.concat(c, f"r_{c}")).alias(c) for c in ("starts", "ends", "items")))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spans = contamination_spans(docs, items, **options)
    return spans.mapInArrow(_results, RESULT.format(kind=kind_of(spans, "doc_id")))


def _clean(batches: Iterator[pa.RecordBatch], sent, name: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = pa.record_batch([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col)], ["doc_id", "h", "text"])
        (found,) = _hits(iter([rows]), sent, name)
        yield batch.filter(pc.equal(pc.list_value_length(found.column("starts")), 0))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the rows in which a window occurs, columns unchanged."""
    blocks = _item_blocks(docs.select(F.col(text_col).cast("string").alias("text")), items, **options)
    for k, sent in enumerate(blocks):
        docs = (written(docs) if k else docs).mapInArrow(partial(_clean, sent=sent, name=uuid.uuid4().hex, text_col=text_col), docs.schema)
    return docs
