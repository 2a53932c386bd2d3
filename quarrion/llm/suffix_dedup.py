"""Suffix-array deduplication of byte strings.

Every byte at which a string of LENGTH bytes can start is a suffix. Its order is that of two characters: the hash of its
first LEAD bytes (64 bits) and the hash of the rest up to LENGTH (32 bits); any order that puts equal strings side by
side serves. The suffixes of a chunk of documents travel as arrays, not as rows, so a suffix costs 12 bytes.

1. Leads: the suffixes that start at a token (a byte above 0x20 after one that isn't) are placed by their first
   character alone. A string of LENGTH bytes can't occur twice if the lead of a token start in it is found once only, so
   the suffixes before such a token are finished at depth one. Texts without tokens lose none here.
2. Splitters, sampled from the suffixes that are left, range-partition them by both characters and their chunk, so that
   the occurrences of one string can be split over buckets. The ranges are taken in slices of bounded volume
   (MOVED x the text), one shuffle each; its files go before the next begins.
3. Every bucket is sorted by multikey quicksort: by the first character at once, and only parts that hold several
   different suffixes by the next. Neighbours are compared to full depth. The first and the last suffix of each bucket
   are compared with those of the other buckets, so a string that a splitter parts is found as well.
4. One bit per distinct suffix of a chunk goes back to the chunk, where the runs of covered bytes are cut out.

A chunk sends equal suffixes once. At the defaults a task holds one chunk of 2 MB or a bucket of a million suffixes;
chunks times buckets arrays are shuffled, so both should grow with the corpus (64 MB and 64 million for 100 TB).

Every byte covered by a string of LENGTH bytes that also starts anywhere else in the corpus, the same document
included, is removed. Defined results: a null text counts as empty; texts shorter than the length lose nothing; rows
that repeat, with or without the same id, are copies of each other, so all their strings repeat; an empty table gives
an empty result. The id keeps its type. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices
from quarrion.llm.placing import BUCKET, CHUNK_BYTES, MOVED, Sorted, bits_of, cut_into_chunks, even_splitters, gathered, placed, rows_of
from quarrion.llm.shared import discard, written

LENGTH, LEAD = 200, 64
#: Sampled suffixes for each bucket.
SAMPLED = 16
#: Positions that are hashed at once.
PIECE = 1 << 15
_FACTOR = 0x9E3779B97F4A7C15
_MIX, _SHIFT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def _powers(of: int) -> np.ndarray:
    """Its powers modulo 2**64, one for each place of a piece."""
    factors = np.full(PIECE + LENGTH, of, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWER, _INVERSE = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> _SHIFT
    return x


def characters(text: bytes, ends: tuple[int, ...]) -> list[np.ndarray]:
    """Of each place, the hash of the bytes up to ends[0] after it, of those from there to ends[1], and so on.

    Places are those with ends[-1] bytes of the text after them. The hash is a polynomial in the mixed eight-byte words
    that start in a stretch, from differences of running sums.
    """
    n = len(text) - ends[-1] + 1
    out = [np.empty(max(0, n), np.uint64) for _ in ends]
    if n <= 0:
        return out
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    sums = np.zeros(PIECE + ends[-1] - 6, np.uint64)
    for at in range(0, n, PIECE):
        m = min(PIECE, n - at)
        part = _mixed(words[at : at + m + ends[-1] - 8])
        part *= _POWER[: len(part)]
        np.cumsum(part, out=sums[1 : len(part) + 1])
        begin = 0
        for hashes, end in zip(out, ends, strict=True):
            stop = end - 7
            hashes[at : at + m] = _mixed((sums[stop : stop + m] - sums[begin : begin + m]) * _INVERSE[:m])
            begin = stop
    return out


def _boundaries(lengths: list[int]) -> np.ndarray:
    return np.cumsum([0, *lengths])


def _fitting(ends: np.ndarray, depth: int) -> np.ndarray:
    """Of each byte of a chunk, whether depth bytes of its text start there."""
    fits = np.zeros(ends[-1], bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        fits[a : max(a, b - depth + 1)] = True
    return fits


def _token_starts(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Bytes above 0x20 after one that isn't, in the same text, with LEAD bytes of it to come."""
    blank = np.frombuffer(text, np.uint8) <= 32
    starts = np.zeros(len(text), bool)
    starts[1:] = blank[:-1] & ~blank[1:]
    starts[ends[:-1][ends[:-1] < len(text)]] = False
    return np.flatnonzero(starts & _fitting(ends, LEAD))


def _leads(row: dict, text: bytes, between: tuple[int, int] | None = None) -> Sorted:
    places = _token_starts(text, _boundaries(row["lengths"]))
    (first,) = characters(text, (LEAD,))
    return Sorted.of(places, first[places], None)


def _unpacked_bits(z: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(z), np.uint8), count=n).astype(bool)


def _whole(row: dict, text: bytes, between: tuple[int, int] | None = None) -> Sorted:
    """The open suffixes, of those whose first character is between the two, if that is given."""
    first, second = characters(text, (LEAD, LENGTH))
    left = _unpacked_bits(row["open"], len(text))[: len(first)]
    if between:
        left &= (first >= np.uint64(between[0])) & (first <= np.uint64(between[1]))
    places = np.flatnonzero(left)
    return Sorted.of(places, first[places], (second[places] >> np.uint64(32)).astype(np.uint32))


SAMPLE = "array<struct<first:long,second:long>>"


def _opened(batches: Iterator[pa.RecordBatch], sent, stride: int) -> Iterator[pa.RecordBatch]:
    """Which suffixes are left after the leads, and a sample of them."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for row, text in rows_of(batches):
        ends = _boundaries(row["lengths"])
        own = _leads(row, text)
        starts = np.zeros(len(text) + 1, bool)
        starts[own.places] = True
        again = own.repeated(bits_of(row["found"], sent.value, own, row["chunk"]))
        starts[again] = False  # what remains starts a token of which the lead is found once
        count = np.cumsum(np.append(0, starts))
        reach = LENGTH - LEAD
        left = _fitting(ends, LENGTH)
        m = len(text) - LENGTH + 1
        if m > 0:
            left[:m] &= count[reach + 1 : reach + 1 + m] == count[1 : 1 + m]
        places = np.flatnonzero(left)
        picked = places[(row["chunk"] * 7919) % stride :: stride].tolist()
        sample = [tuple(int(x[0]) for x in characters(text[p : p + LENGTH], (LEAD, LENGTH))) for p in picked]
        sample = [{"first": int(np.uint64(a).view(np.int64)), "second": b >> 32} for a, b in sample]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("second", pa.int64())]))
        yield pa.record_batch([pa.array([row["chunk"]]), pa.array([pack(np.packbits(left).tobytes())], pa.binary()), pa.array([len(places)], pa.int64()), pa.array([sample], kind)], ["o_chunk", "open", "n_open", "sample"])


def _covered(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        ((row, text),) = rows_of(iter([batch]))
        ends = _boundaries(row["lengths"])
        change = np.zeros(len(text) + 1, np.int32)
        if row["found"]:
            own = _whole(row, text)
            again = own.repeated(bits_of(row["found"], sent.value, own, row["chunk"]))
            change[again] += 1
            change[again + LENGTH] -= 1
        gone = np.cumsum(change)[:-1] > 0
        edges = gone.copy()
        edges[1:] &= ~gone[:-1]
        edges[ends[:-1][ends[:-1] < len(text)]] = gone[ends[:-1][ends[:-1] < len(text)]]
        removed, spans = (np.diff(np.append(0, np.cumsum(x))[ends]) for x in (gone, edges))
        stay = np.frombuffer(text, np.uint8)[~gone].tobytes()
        at = np.cumsum(np.append(0, np.array(row["lengths"], np.int64) - removed)).tolist()
        kept = [stay[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        docs = batch.column("docs").flatten()
        yield pa.record_batch([docs, pa.array(row["lengths"], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET, moved: float = MOVED) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and kept, the bytes that remain."""
    spark = docs.sparkSession
    raw, size = cut_into_chunks(docs, id_col, text_col, chunk_bytes)
    even = even_splitters(size // 8, bucket)
    leads = placed(raw, _leads, even, size, moved * size)
    sent = spark.sparkContext.broadcast(even)
    both = raw.join(gathered(leads), raw.chunk == F.col("b_chunk"), "left").drop("b_chunk")
    opened = written(both.mapInArrow(partial(_opened, sent=sent, stride=max(1, bucket // SAMPLED)), f"o_chunk long, open binary, n_open long, sample {SAMPLE}"))
    chunks = written(raw.join(opened.select("o_chunk", "open"), raw.chunk == F.col("o_chunk")).drop("o_chunk"))
    discard(raw, *leads)

    n_open = opened.agg(F.coalesce(F.sum("n_open"), F.lit(0))).first()[0]
    sample = opened.select("o_chunk", F.explode("sample").alias("s")).select("o_chunk", "s.first", "s.second").toArrow().to_pylist()
    ranked = sorted((x["first"] % (1 << 64), x["second"], x["o_chunk"]) for x in sample)
    n = min(len(ranked) + 1, max(1, -(-n_open // bucket)))
    splitters = [ranked[k * len(ranked) // n] for k in range(1, n)]
    bits = placed(chunks, _whole, splitters, 12 * n_open, moved * size)
    sent = spark.sparkContext.broadcast(splitters)
    whole = chunks.join(gathered(bits), chunks.chunk == F.col("b_chunk"), "left").drop("b_chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(partial(_covered, sent=sent), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
