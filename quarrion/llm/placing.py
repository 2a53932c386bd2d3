"""Finding equal keys across a corpus whose chunks send theirs as arrays, not as rows.

A chunk holds the texts of some documents. Its distinct keys (one or two characters: 64 bits, and 32 more) are sorted and
dealt to the buckets of sampled or even ranges, in slices of bounded volume, one shuffle each. A bucket is one task: it
sorts its keys by multikey quicksort, compares neighbours, and returns one bit per key to the chunk that sent it: whether
the key occurs in another chunk. Keys are told apart by their chunk where a splitter falls on one, so a common key can be
split over buckets; the first and the last key of each bucket are compared with those of the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices, texts
from quarrion.llm.shared import written
from quarrion.shipping import shipped

#: Bytes of text of a chunk, keys of a bucket, and bytes that a slice may shuffle for each byte of text.
CHUNK_BYTES, BUCKET, MOVED = 2 << 20, 1 << 20, 1.2

Splitters = list[tuple[int, int, int]]


def order_of(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Order by the first character, then the second, then the place: multikey quicksort.

    The first character is sorted as one number with the place in its lowest bits. Of the parts that are equal in the
    bits that this leaves, those that hold different keys are sorted by the whole characters.
    """
    n = len(first)
    if n < 2:
        return np.arange(n)
    low = first.min()
    shift = 64 - max(1, int(first.max() - low).bit_length())
    bits = (n - 1).bit_length()
    mask = np.uint64((1 << bits) - 1)
    key = (first - low) << np.uint64(shift)
    key &= ~mask
    key |= np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & mask).view(np.int64)
    key >>= np.uint64(bits)
    joined = key[1:] == key[:-1]
    if not joined.any():
        return order
    differs = first[order[1:]] != first[order[:-1]]
    if second is not None:
        differs |= second[order[1:]] != second[order[:-1]]
    part = np.cumsum(np.append(True, ~joined))
    mixed = np.zeros(part[-1] + 1, bool)
    mixed[part[1:][joined & differs]] = True
    places = np.flatnonzero(mixed[part])
    if len(places):
        own = order[places]
        keys = (own, first[own], part[places]) if second is None else (own, second[own], first[own], part[places])
        order[places] = own[np.lexsort(keys)]
    return order


def _new(first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    new = np.ones(len(first), bool)
    new[1:] = first[1:] != first[:-1]
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    return new


@dataclass
class Sorted:
    """The distinct keys of a chunk in their order; places and group: of all keys, and to which of these they belong."""

    first: np.ndarray
    second: np.ndarray | None
    places: np.ndarray
    group: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, first: np.ndarray, second: np.ndarray | None) -> Sorted:
        order = order_of(first, second)
        first, second = first[order], None if second is None else second[order]
        new = _new(first, second)
        return cls(first[new], None if second is None else second[new], places[order], np.cumsum(new) - 1)

    def repeated(self, bits: np.ndarray) -> np.ndarray:
        """Places of the keys that occur twice here, or elsewhere as bits say."""
        here = np.bincount(self.group, minlength=len(self.first)) > 1
        return self.places[(here | bits[: len(self.first)])[self.group]]

    def cuts(self, splitters: Splitters, chunk: int) -> np.ndarray:
        """How many of the distinct keys come before each splitter."""
        by = np.array([s[0] for s in splitters], np.uint64)
        low, high = np.searchsorted(self.first, by, "left"), np.searchsorted(self.first, by, "right")
        for k in np.flatnonzero(low < high).tolist():
            a, b = low[k], high[k]
            if self.second is None:
                low[k] += int(chunk < splitters[k][2])
            else:
                at = a + np.searchsorted(self.second[a:b], np.uint32(splitters[k][1]), "left")
                low[k] = at + int(at < b and int(self.second[at]) == splitters[k][1] and chunk < splitters[k][2])
        return low


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Chunk by chunk, with its text."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        yield row, zstandard.decompress(row.pop("z"))


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    own: list[bytes] = []
    docs, size = [], 0

    def chunk() -> pa.RecordBatch:
        columns = (pa.concat_arrays(docs), pa.array(list(map(len, own)), pa.int64()))
        lists = (pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), c) for c in columns)
        return pa.record_batch([*lists, pa.array([pack(b"".join(own))], pa.binary())], ["docs", "lengths", "z"])

    for batch in slices(batches, 64):
        for k, text in enumerate(texts(batch.column("text"))):
            own.append(text)
            docs.append(batch.column("doc_id").slice(k, 1))
            size += len(text) + 64
            if size >= chunk_bytes:
                yield chunk()
                own, docs, size = [], [], 0
    if own:
        yield chunk()


#: The keys of a chunk, at least those whose first character is between the two.
Keys = Callable[[dict, bytes, tuple[int, int]], Sorted]


@dataclass(frozen=True)
class Plan:
    """How a chunk's keys are found, the splitters of all buckets, and the buckets of one slice."""

    keys: Keys
    splitters: Splitters
    low: int
    high: int

    def dealt(self, row: dict, text: bytes) -> tuple[Sorted, np.ndarray]:
        """A chunk's keys, and where those of each bucket of the slice begin and end."""
        ahead = self.splitters[self.low - 1] if self.low else (0, 0, 0)
        after = self.splitters[self.high - 1] if self.high <= len(self.splitters) else ((1 << 64) - 1, 0, 0)
        own = self.keys(row, text, (ahead[0], after[0]))
        inner = self.splitters[max(0, self.low - 1) : self.high]
        cuts = own.cuts(inner, row["chunk"]).tolist()
        return own, np.array(([0] if not self.low else []) + cuts + ([len(own.first)] if self.high > len(self.splitters) else []))


DEALT = "chunk long, bucket int, n int, first binary, second binary"
BITS = "chunk long, bucket int, bits binary, end_first long, end_second long, at int"


def _dealt(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    plan = sent.value
    for row, text in rows_of(batches):
        own, cuts = plan.dealt(row, text)
        out = []
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if a < b:
                out.append((row["chunk"], k, b - a, own.first[a:b].tobytes(), None if own.second is None else own.second[a:b].tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bucket", "n", "first", "second"])


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task has one bucket. Bits of the keys that have an equal neighbour, for each array; first and last key."""
    columns: dict[str, list] = {"chunk": [], "bucket": [], "n": [], "first": [], "second": []}
    for batch in batches:
        for name, values in columns.items():
            values += batch.column(name).to_pylist()
    if not columns["n"]:
        return
    first = np.frombuffer(b"".join(columns.pop("first")), np.uint64)
    parts = columns.pop("second")
    second = None if parts[0] is None else np.frombuffer(b"".join(parts), np.uint32)
    order = order_of(first, second)
    new = _new(first[order], None if second is None else second[order])
    again = np.zeros(len(first), bool)
    again[order] = ~(new & np.append(new[1:], True))
    ends = np.cumsum([0, *columns["n"]])
    found: list[tuple] = [(c, b, np.packbits(again[i:j]).tobytes(), None, None, None) for c, b, i, j in zip(columns["chunk"], columns["bucket"], ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for k in {int(order[0]), int(order[-1])}:
        of = int(np.searchsorted(ends, k, "right")) - 1
        found.append((columns["chunk"][of], columns["bucket"][of], None, int(first[k].view(np.int64)), None if second is None else int(second[k]), k - int(ends[of])))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["chunk", "bucket", "bits", "end_first", "end_second", "at"])


def placed(chunks: DataFrame, keys: Keys, splitters: Splitters, moved: int, bound: float) -> list[DataFrame]:
    """Written tables of BITS, one for each slice. moved: bytes of all keys; bound: of a slice."""
    n = len(splitters) + 1
    n_slices = min(n, max(1, int(np.ceil(moved / max(1.0, bound)))))
    out = []
    for k in range(n_slices):
        low, high = k * n // n_slices, (k + 1) * n // n_slices
        sent = chunks.sparkSession.sparkContext.broadcast(Plan(keys, splitters, low, high))
        dealt = chunks.mapInArrow(partial(_dealt, sent=sent), DEALT).repartitionById(high - low, F.col("bucket"))
        bits = written(dealt.mapInArrow(_bucket, BITS))
        out.append(bits.withColumn("bucket", F.col("bucket") + low))
        sent.unpersist()
    return out


def gathered(tables: list[DataFrame]) -> DataFrame:
    """Per chunk: bits of its distinct keys by bucket, and places in a bucket of those that another bucket has too."""
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    ends = every.filter("bits is null")
    parted = ends.groupBy("end_first", "end_second").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo < hi")
    same = (ends.end_first == parted.end_first) & ends.end_second.eqNullSafe(parted.end_second)
    fixes = ends.join(parted, same, "left_semi").select("chunk", "bucket", F.lit(None).cast("binary").alias("bits"), "at")
    rows = every.filter("bits is not null").select("chunk", "bucket", "bits", "at").unionByName(fixes)
    return rows.groupBy(F.col("chunk").alias("b_chunk")).agg(F.collect_list(F.struct("bucket", "bits", "at")).alias("found"))


def bits_of(found: list[dict] | None, splitters: Splitters, own: Sorted, chunk: int) -> np.ndarray:
    """The bits of a chunk's distinct keys, in their order."""
    cuts = np.array([0, *own.cuts(splitters, chunk).tolist(), len(own.first)])
    out = np.zeros(len(own.first), bool)
    for x in found or ():
        a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
        if x["bits"] is None:
            out[a + x["at"]] = True
        else:
            out[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return out


def cut_into_chunks(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """The texts in chunks (chunk, docs, lengths, z), written, and their bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = shipped(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.mapInArrow(partial(_chunks, chunk_bytes=chunk_bytes), f"docs array<{kind}>, lengths array<long>, z binary")
    chunks = written(cut.withColumn("chunk", F.monotonically_increasing_id()))
    size = chunks.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    return chunks, size


def even_splitters(keys: int, bucket: int) -> Splitters:
    """Of first characters that are hashes, and so spread evenly."""
    n = max(1, -(-keys // bucket))
    return [((1 << 64) * k // n, 0, 0) for k in range(1, n)]
