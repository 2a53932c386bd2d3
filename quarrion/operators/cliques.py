"""Triangles of the graph that links every two nodes of a group.

Pairs are no rows. A task takes the pairs of its groups as places of two bytes in blocks of SIDE x SIDE nodes, each once, so many
repeated pairs leave as few bytes and pairs that don't repeat as little more. Blocks are merged to distinct links. Where links are
many for the nodes, three strips of nodes meet in one task, as bits: what the ends of a link have in common are the bits that two
rows share. Each link is met with each strip once. Where links are few, lists meet as `graph.triangles` has it; counted figures choose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.operators.graph import triangles
from quarrion.operators.numbering import numbered
from quarrion.shipping import shipped
from quarrion.storage import discard, partitions, written

#: Nodes along a block, and blocks along a strip.
SIDE, STRIP = 256, 64
#: Pairs that a task gathers before it sends them, about; members of a group whose pairs are made in one go; rows of bits at once.
PAIRS, LONG, ROWS = 4_000_000, 1024, 512
#: Squared nodes to a link up to which bits meet.
SPARSE = 512


def _pairs(ends: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (low, high) of each sorted list."""
    sizes = np.diff(ends)
    for k in np.unique(sizes[sizes > 1]):
        starts = ends[:-1][sizes == k]
        if k > LONG:
            for at in starts:
                for i in range(at, at + k - 1):
                    yield np.broadcast_to(members[i], at + k - 1 - i), members[i + 1 : at + k]
            continue
        i, j = np.triu_indices(k, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(starts), step):
            own = members[starts[at : at + step, None] + np.arange(k)]
            yield own[:, i].ravel(), own[:, j].ravel()


def _packed(codes: np.ndarray) -> pa.RecordBatch:
    """Sorted codes as a row (block, places) for each block."""
    block = codes >> 16
    cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(codes)]])
    places = (codes & 0xFFFF).astype("<u2")
    rows = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 2).astype(np.int32)), pa.py_buffer(places)])
    return pa.record_batch([pa.array(block[cuts[:-1]]), rows], ["block", "places"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, places) of the pairs in rows (members); a pair comes again only if much is sent between."""
    held, room = [], 0
    for batch in batches:
        lists = batch.column("members")
        for low, high in _pairs(lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)):
            down, across = low // SIDE, high // SIDE
            held.append((across * (across + 1) // 2 + down) << 16 | (low % SIDE) << 8 | high % SIDE)
            room += len(low)
            if room >= PAIRS:
                whole = np.unique(np.concatenate(held))
                held, room = [whole], len(whole)
                if room > PAIRS // 2:
                    yield _packed(whole)
                    held, room = [], 0
    if room:
        yield _packed(np.unique(np.concatenate(held)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, places, n) for each block, whose rows come one after the other: distinct places, or a bit for each place if that is shorter."""
    block, held = None, np.zeros(SIDE * SIDE, bool)

    def row() -> pa.RecordBatch:
        places = np.flatnonzero(held)
        own = places.astype("<u2").tobytes() if 16 * len(places) < held.size else np.packbits(held).tobytes()
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([own], pa.binary()), pa.array([len(places)], pa.int64())], ["block", "places", "n"])

    for batch in batches:
        for k, places in zip(batch.column("block").to_pylist(), batch.column("places"), strict=True):
            if k != block and block is not None:
                yield row()
                held[:] = False
            block = k
            held[np.frombuffer(places.as_buffer(), "<u2")] = True
    if block is not None:
        yield row()


def _places(own: bytes, n: int) -> np.ndarray:
    """Places of a merged block."""
    return np.frombuffer(own, "<u2").astype(np.int64) if len(own) == 2 * n < SIDE * SIDE // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8)))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of merged blocks."""
    for batch in batches:
        for down, across, own, n in zip(*(batch.column(c).to_pylist() for c in ("down", "across", "places", "n")), strict=True):
            at = _places(own, n)
            yield pa.record_batch([pa.array(down * SIDE + at // SIDE), pa.array(across * SIDE + at % SIDE)], ["a", "b"])


class _Strips:
    """Three strips i <= j <= k of nodes, and the blocks between each two of them."""

    def __init__(self, of: tuple[int, int, int]) -> None:
        self.of = of
        self.cells: dict[tuple[int, int], list[tuple[int, int, bytes, int]]] = {}

    def add(self, down: int, across: int, own: bytes, n: int) -> None:
        cell = down // STRIP, across // STRIP
        self.cells.setdefault(cell, []).append((down - cell[0] * STRIP, across - cell[1] * STRIP, own, n))

    def bits(self, x: int, y: int) -> np.ndarray:
        """A row for each node of x, with a bit for each of y."""
        out = np.zeros((STRIP * SIDE, STRIP * SIDE // 8), np.uint8)
        for down, across, own, n in self.cells.get((min(x, y), max(x, y)), []):
            block = np.zeros(SIDE * SIDE, bool)
            block[_places(own, n)] = True
            block = block.reshape(SIDE, SIDE)
            for r, c, links, used in ((down, across, block, x <= y), (across, down, block.T, x >= y)):
                if used:
                    out[r * SIDE : (r + 1) * SIDE, c * SIDE // 8 : (c + 1) * SIDE // 8] |= np.packbits(links, axis=1)
        return out.view(np.uint64)

    def counts(self) -> Iterator[pa.RecordBatch]:
        """(id, n): for each two of the strips, what the ends of the links between them share in the third. A triangle counts twice at each of its nodes."""
        i, j, k = self.of
        n = {x: np.zeros(STRIP * SIDE, np.int64) for x in self.of}
        for x, y, z in sorted({(i, j, k), (i, k, j), (j, k, i)}):
            if (x, y) not in self.cells:
                continue
            left = self.bits(x, z)
            right = left if x == y else self.bits(y, z)
            for down, across, own, links in self.cells[x, y]:
                places = _places(own, links)
                a, b = places // SIDE + down * SIDE, places % SIDE + across * SIDE
                shared = [np.bitwise_count(left[a[at : at + ROWS]] & right[b[at : at + ROWS]]).sum(axis=1, dtype=np.int64) for at in range(0, len(a), ROWS)]
                shared = np.concatenate(shared)
                for strip, ends, first in ((x, a, down), (y, b, across)):
                    n[strip][first * SIDE : (first + 1) * SIDE] += np.bincount(ends - first * SIDE, shared, SIDE).astype(np.int64)
        for x, per in n.items():
            at = np.flatnonzero(per)
            yield pa.record_batch([pa.array(at + x * STRIP * SIDE), pa.array(per[at])], ["id", "n"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) from rows (i, j, k, down, across, places, n) in the order of i, j and k: three strips at a time."""
    held = None
    for batch in batches:
        for i, j, k, down, across, own, n in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "k", "down", "across", "places", "n")), strict=True):
            if held is None or held.of != (i, j, k):
                if held is not None:
                    yield from held.counts()
                held = _Strips((i, j, k))
            held.add(down, across, own, n)
    if held is not None:
        yield from held.counts()


def _strips_met(blocks: DataFrame) -> DataFrame:
    """(id, n) of merged blocks: each goes to the threes of strips that have it between two of them, if there are links between each two."""
    blocks = blocks.withColumns({"i": F.floor(F.col("down") / STRIP), "j": F.floor(F.col("across") / STRIP)})
    cells = written(blocks.select("i", "j").distinct())
    threes = cells.join(cells.select(F.col("i").alias("j"), F.col("j").alias("k")), "j").join(cells.select("i", F.col("j").alias("k")), ["i", "k"])
    asked = written(threes.select(F.explode(F.array_distinct(F.array(F.struct("i", "j"), F.struct("i", F.col("k").alias("j")), F.struct(F.col("j").alias("i"), F.col("k").alias("j"))))).alias("cell"), F.struct("i", "j", "k").alias("three")))
    n = asked.select("three").distinct().count()
    rows = blocks.join(asked.select("cell.i", "cell.j", "three"), ["i", "j"]).select("three.*", "down", "across", "places", "n")
    dealt = shipped(rows).repartition(max(n, 1), "i", "j", "k").sortWithinPartitions("i", "j", "k")
    return dealt.mapInArrow(_met, "id long, n long")


def group_triangles(rows: DataFrame, node: str, group: str) -> DataFrame:
    """(node, triangles) for every node of a triangle, where two nodes are linked that share a group. Null nodes and groups count for nothing."""
    rows = rows.select(F.col(node).alias("node"), F.col(group).alias("group")).filter("node is not null and group is not null")
    nodes = written(numbered(rows.select("node").distinct(), ["node"], "id").withColumn("id", F.col("id") - 1))
    n, tasks = nodes.count(), max(partitions(rows), 4)
    held = written(rows.join(nodes, "node").select(F.col("id").cast("int").alias("id"), "group"))
    # Ranges of groups, as groups next to each other share nodes: most repeated pairs meet before the shuffle.
    of = held.repartitionByRange(tasks, "group").groupBy("group").agg(F.array_sort(F.collect_set("id")).alias("members"))
    found = shipped(of.select("members")).mapInArrow(_blocked, "block long, places binary")
    merged = found.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_merged, "block long, places binary, n long")
    across = F.floor((F.sqrt(8 * F.col("block") + 1) - 1) / 2)
    blocks = written(merged.withColumn("across", across).withColumn("down", F.col("block") - F.col("across") * (F.col("across") + 1) / 2).select(F.col("down").cast("long"), "across", "places", "n"))
    discard(held)
    links = blocks.agg(F.sum("n")).first()[0] or 0
    if n * n > SPARSE * links:
        per = triangles(shipped(blocks).mapInArrow(_links, "a long, b long")).select(F.col("node").alias("id"), "triangles")
    else:
        per = _strips_met(blocks).groupBy("id").agg((F.sum("n") / 2).cast("long").alias("triangles"))
    return per.join(nodes, "id").select("node", "triangles")
