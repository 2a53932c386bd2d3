"""Substring deduplication of word sequences by seed and extend.

1. Seeds: the anchor of a window of LENGTH words is its GRAM-word gram of least hash, the leftmost of equals. Equal
   windows have equal anchors at equal offsets, and the windows of one anchor start one after the other. The hashes of
   all anchors are placed over the whole corpus (see placing); a window can only repeat if its anchor does.
2. Contexts: each anchor that repeats gives the stretch that holds all its windows. A chunk sends equal stretches once.
3. Join and extend: the contexts are range-partitioned by anchor, then by their own hash and chunk, so that a common
   anchor is split. The contexts of one anchor are put in the order of what follows it and extended to both sides
   against their neighbours, word by word, not against each other; offsets that this leaves open are settled by the
   windows themselves. A group that may go on in another task, or that is large, is left open: its windows are compared
   over all tasks by counting 128-bit fingerprints, summed before the shuffle.
4. The verdicts go back to the chunks as spans of words, and overlapping ones are merged into maximal repeats.

A task holds one chunk, or GROUP_BYTES of the contexts of one anchor. Every word covered by a window of LENGTH words
whose sequence also starts anywhere else, the same document included, is removed. Defined results: a null text has no
words; texts of fewer words lose nothing; rows that repeat, with or without the same id, are copies of each other; an
empty table gives an empty result. The id keeps its type. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.arrow import slices
from quarrion.llm.placing import BUCKET, CHUNK_BYTES, MOVED, Sorted, bits_of, cut_into_chunks, even_splitters, gathered, placed, rows_of
from quarrion.llm.shared import discard, written
from quarrion.llm.words import WordHashes, doubled

LENGTH, GRAM = 35, 8
#: Words that are hashed at once.
PIECE = 1 << 16
#: Bytes of contexts of one anchor that are compared at once, of a batch, and of the contexts of a task.
GROUP_BYTES, BATCH_BYTES, PART_BYTES = 2 << 20, 2 << 20, 8 << 20

_words = WordHashes()


@dataclass(frozen=True)
class Anchors:
    """Of each anchor of a text: hash, place, and the first and last start of its windows."""

    hash: np.ndarray
    place: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(words: Sequence[bytes], length: int = LENGTH, gram: int = GRAM) -> Anchors:
    found: list[list[np.ndarray]] = [[], [], [], []]
    w = length - gram + 1
    for at in range(0, max(0, len(words) - length + 1), PIECE):
        own = words[at : at + PIECE + length - 1]
        grams = doubled(np.fromiter(map(_words.__getitem__, own), np.uint64, len(own)), 1, gram.bit_length() - 1)
        n = len(grams) - w + 1
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        for out, x in zip(found, (grams[place[first]], place[first] + at, first + at, last + at), strict=True):
            out.append(x)
    return Anchors(*(np.concatenate(x) if x else np.empty(0, kind) for x, kind in zip(found, (np.uint64, *[np.int64] * 3), strict=True)))


def _split(row: dict, text: bytes) -> list[list[bytes]]:
    """Words of each text of a chunk."""
    ends = np.cumsum([0, *row["lengths"]]).tolist()
    return [text[a:b].split() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _seeds(row: dict, text: bytes, between: tuple[int, int] | None = None) -> Sorted:
    hashes = np.concatenate([np.empty(0, np.uint64), *(anchors(words).hash for words in _split(row, text))])
    return Sorted.of(np.arange(len(hashes)), hashes, None)


CONTEXTS = "chunk long, seed long, hash binary, context binary, most int, least int, n int, places array<int>"


def _contexts(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """most and least: how far before the anchor the first and last of its windows start. places: of the anchor, in the words of the chunk."""
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    for row, text in rows_of(batches):
        each = _split(row, text)
        found = [anchors(words) for words in each]
        hashes = np.concatenate([np.empty(0, np.uint64), *(f.hash for f in found)])
        own = Sorted.of(np.arange(len(hashes)), hashes, None)
        again = np.zeros(len(hashes), bool)
        again[own.repeated(bits_of(row["found"], sent.value, own, row["chunk"]))] = True
        distinct: dict[bytes, tuple] = {}
        at = begin = size = 0

        def batch() -> pa.RecordBatch:
            rows = [(row["chunk"], seed, h, context, most, least, len(places), places) for h, (seed, context, most, least, places) in distinct.items()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for words, f in zip(each, found, strict=True):
            keep = again[at : at + len(f.hash)]
            for seed, s, lo, hi in zip(*(x[keep].tolist() for x in (f.hash.view(np.int64), f.place, f.first, f.last)), strict=True):
                context = b" ".join(words[lo : hi + LENGTH])
                h = xxhash.xxh3_128_digest(b"%d %d " % (s - lo, s - hi) + context)
                if h not in distinct:
                    distinct[h] = (seed, context, s - lo, s - hi, [])
                    size += len(context) + 100
                distinct[h][-1].append(begin + s)
            at, begin = at + len(f.hash), begin + len(words)
            if size > BATCH_BYTES:
                yield batch()
                distinct, size = {}, 0
        if distinct:
            yield batch()


@dataclass(slots=True)
class Member:
    """A distinct context: its words, the offsets of its windows before the anchor, and how often it occurs."""

    hash: bytes
    words: tuple[bytes, ...]
    most: int
    least: int
    count: int


def _same(a: Sequence, b: Sequence) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def repeated_offsets(group: list[Member], length: int = LENGTH) -> Iterator[tuple[Member, int, int]]:
    """Of contexts with the same anchor: (member, lowest, highest) offsets of windows that occur more than once."""
    tails = sorted(((m.words[m.most :], i) for i, m in enumerate(group)))
    order = [group[i] for _, i in tails]
    ahead = [_same(a, b) for (a, _), (b, _) in zip(tails, tails[1:], strict=False)]
    done: list[set[int]] = [set(range(m.least, m.most + 1)) if m.count > 1 else set() for m in order]
    for i, right in enumerate(ahead):
        a, b = order[i], order[i + 1]
        left = _same(a.words[: a.most][::-1], b.words[: b.most][::-1])
        for k, m in ((i, a), (i + 1, b)):
            done[k].update(range(max(m.least, length - right), min(m.most, left) + 1))
    if len(order) > 2:
        open_ = set()
        for i, m in enumerate(order):
            reach = max(ahead[i - 1] if i else 0, ahead[i] if i < len(ahead) else 0)
            open_.update(o for o in range(max(m.least, length - reach), m.most + 1) if o not in done[i])
        for o in open_:
            seen = defaultdict(list)
            for i, m in enumerate(order):
                if m.least <= o <= m.most:
                    seen[m.words[m.most - o : m.most - o + length]].append(i)
            for same in seen.values():
                if len(same) > 1:
                    for i in same:
                        done[i].add(o)
    for m, offsets in zip(order, done, strict=True):
        run = sorted(offsets)
        for k, o in enumerate(run):
            if not k or run[k - 1] + 1 < o:
                low = o
            if k + 1 == len(run) or run[k + 1] > o + 1:
                yield m, low, o


def _groups(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[tuple[bool, list[Member]]]:
    """Members of each anchor, in parts of bounded size, and whether others may follow or have gone before.

    The rows come sorted by anchor and hash. The first and the last anchor of a task may be in other tasks too.
    """

    def rows() -> Iterator[tuple]:
        for batch in slices(batches):
            yield from zip(*(batch.column(c).to_pylist() for c in ("seed", "hash", "context", "most", "least", "n")), strict=True)

    held: tuple[bool, list[Member]] | None = None
    ended = 0
    for _, own in groupby(rows(), lambda x: x[0]):
        if held:
            yield held[0] or not ended, held[1]
            ended += 1
        parts, members, size = 0, [], 0
        for _, h, context, most, least, n in own:
            if members and members[-1].hash == h:
                members[-1].count += n
                continue
            if size > group_bytes:
                yield True, members
                parts, members, size = parts + 1, [], 0
            members.append(Member(h, tuple(context.split()), most, least, n))
            size += len(context) + 100
        held = (parts > 0, members)
    if held:
        yield True, held[1]


VERDICT = "hash binary, low int, high int, print binary"


def _decided(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Offsets that repeat, and, of open groups, fingerprints.

    A window of an open group that repeats in its task is settled; its fingerprint goes on once, without a context, to
    meet the windows of other tasks that aren't.
    """
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["hash", "low", "high", "print"])

    for is_open, group in _groups(batches, group_bytes):
        settled = [(m.hash, low, high, None) for m, low, high in repeated_offsets(group)]
        out += settled
        if is_open:
            done = {(h, o) for h, low, high, _ in settled for o in range(low, high + 1)}
            once = set()
            for m in group:
                for o in range(m.least, m.most + 1):
                    print_ = xxhash.xxh3_128_digest(b" ".join(m.words[m.most - o : m.most - o + LENGTH]))
                    if (m.hash, o) in done:
                        once.add(print_)
                    else:
                        out.append((m.hash, o, o, print_))
            out += [(None, None, None, x) for x in once]
        if len(out) > 20_000:
            yield batch()
            out.clear()
    yield batch()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        spans = batch.column("spans")
        batch = batch.drop_columns(["spans"])
        ((row, text),) = rows_of(iter([batch]))
        each = _split(row, text)
        ends = np.cumsum([0, *map(len, each)])
        change = np.zeros(ends[-1] + 1, np.int32)
        if spans[0].is_valid:
            flat = spans.flatten()
            np.add.at(change, flat.field("a").to_numpy(zero_copy_only=False), 1)
            np.add.at(change, flat.field("b").to_numpy(zero_copy_only=False), -1)
        stay = np.cumsum(change)[:-1] <= 0
        kept = [[w for w, s in zip(words, stay[a:b].tolist(), strict=True) if s] for words, a, b in zip(each, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        n = np.diff(ends)
        yield pa.record_batch([batch.column("docs").flatten(), pa.array(n, pa.int64()), pa.array(n - np.array(list(map(len, kept)), np.int64), pa.int64()), pa.array([b" ".join(k) for k in kept], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def drop_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket: int = BUCKET, moved: float = MOVED, part_bytes: int = PART_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, and kept, the words that remain, joined by one space."""
    spark = docs.sparkSession
    chunks, size = cut_into_chunks(docs, id_col, text_col, chunk_bytes)
    even = even_splitters(size // 64, bucket)
    seeds = placed(chunks, _seeds, even, size // 8, moved * size)
    sent = spark.sparkContext.broadcast(even)
    marked = chunks.join(gathered(seeds), chunks.chunk == F.col("b_chunk")).drop("b_chunk")
    contexts = written(marked.mapInArrow(partial(_contexts, sent=sent), CONTEXTS))
    discard(*seeds)

    total = contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0]
    dealt = contexts.select("seed", "hash", "context", "most", "least", "n", "chunk").repartitionByRange(max(1, -(-total // part_bytes)), "seed", "hash", "chunk")
    verdicts = written(dealt.sortWithinPartitions("seed", "hash").drop("chunk").mapInArrow(partial(_decided, group_bytes=group_bytes), VERDICT))
    prints = verdicts.filter("print is not null")
    again = written(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"))
    sure = verdicts.filter("print is null").select("hash", "low", "high").unionByName(prints.filter("hash is not null").join(again, "print").select("hash", "low", "high"))
    spans = contexts.select("chunk", "hash", "places").join(sure, "hash").select(F.col("chunk").alias("w_chunk"), F.explode("places").alias("place"), "low", "high")
    span = F.struct((F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + LENGTH).alias("b"))
    spans = spans.groupBy("w_chunk").agg(F.collect_list(span).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    whole = chunks.join(spans, chunks.chunk == F.col("w_chunk"), "left").drop("w_chunk")
    return whole.mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept binary")
