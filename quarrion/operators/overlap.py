"""Pairs of sets that share at least so many keys, by a prefix-filtered join.

Keys are ordered by rarity. Two sets that share `least` keys share one among all but the last least - 1 of each, so only these
prefixes are joined: a key that a large part of the sets holds is in the prefix of few. A pair is verified at the first key
that its sets share, on the whole sets, so it comes once and no list of candidates is gathered; before that, the places of the
key bound how many can still be shared. Keys of a single set are left out before the order is made.

The list of a key that is still long is dealt to a triangle of cells, at most `cell` sets meeting as many, each pair of sets in
one cell. A set's keys travel as one array of their ranks, so a single set should fit into a task's memory.

Where few keys are each in many sets, most pairs share a key and no prefix helps. Then sets are dealt to blocks, each two of which
meet in one task, and the product of their 0/1 matrices counts what is shared, with no candidate made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion import storage
from quarrion.operators import subsets
from quarrion.operators.numbering import numbered
from quarrion.shipping import shipped
from quarrion.storage import discard, written

#: Sets of one key that one join cell compares with each other.
CELL = 1000
#: Entries of a product of matrices that cost no more than one candidate of the join.
ENTRIES = 5000
#: Sets of a block, about, and the rows and columns of it that are multiplied at once.
BLOCK, STRIP, COLUMNS = 8192, 512, 1024


def ranked_sets(postings: DataFrame, item: str, key: str, least: int) -> DataFrame:
    """(item, keys): the ranks of each item's keys, rarest first, for items that have enough keys in common with any other."""
    rows = written(postings.select(F.col(item).alias("item"), F.col(key).alias("key")).filter("item is not null and key is not null").distinct())
    ranks = numbered(rows.groupBy("key").agg(F.count("*").alias("items")).filter("items > 1"), ["items", "key"], "rank").select("key", "rank")
    return rows.join(ranks, "key").groupBy("item").agg(F.array_sort(F.collect_list("rank")).alias("keys")).filter(F.size("keys") >= least)


def _cells(prefixes: DataFrame, cell: int) -> DataFrame:
    """Each row in the cells of its key's triangle, (0, 0) for short lists."""
    long = prefixes.groupBy("rank").agg(F.count("*").alias("sets")).filter(F.col("sets") > cell)
    rows = prefixes.join(long, "rank", "left").withColumn("parts", F.coalesce(F.ceil(F.col("sets") / cell), F.lit(1)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.withColumn("other", other)
    return rows.select("rank", "item", "keys", "at", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def _dense(ends: np.ndarray, ranks: np.ndarray, low: int) -> np.ndarray:
    """The 0/1 matrix of some sets by COLUMNS ranks from low; ends: where each set's ranks start, and the end of the last."""
    out = np.zeros((len(ends) - 1, COLUMNS), np.float32)
    own = ranks[ends[0] : ends[-1]] - low
    rows = np.repeat(np.arange(len(out)), np.diff(ends))
    held = (own >= 0) & (own < COLUMNS)
    out[rows[held], own[held]] = 1
    return out


def _met(parts: dict[bool, list[pa.RecordBatch]], keys: int, least: int) -> Iterator[pa.RecordBatch]:
    """(x, y, weight) of the pairs of a cell's two blocks, or of its one block."""
    sides = []
    for own in parts.values():
        rows = pa.Table.from_batches(own).combine_chunks()
        lists = rows["keys"].combine_chunks()
        sides.append((rows["item"].combine_chunks(), lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)))
    (xs, x_ends, x_ranks), (ys, y_ends, y_ranks) = sides[0], sides[-1]
    across = None
    for at in range(0, len(xs), STRIP):
        ends = x_ends[at : at + STRIP + 1]
        shared = np.zeros((len(ends) - 1, len(ys)), np.float32)
        for low in range(1, keys + 1, COLUMNS):
            if across is None or keys > COLUMNS:
                across = _dense(y_ends, y_ranks, low)
            shared += _dense(ends, x_ranks, low) @ across.T
        i, j = np.nonzero(shared >= least)
        if len(sides) == 1:
            i, j = i[i + at < j], j[i + at < j]
        yield pa.record_batch([xs.take(pa.array(i + at)), ys.take(pa.array(j)), pa.array(shared[i, j].astype(np.int64))], ["x", "y", "weight"])


def _products(batches: Iterator[pa.RecordBatch], keys: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, both, second, item, keys) are sorted by cell: one cell at a time. A cell of two blocks has pairs across them only."""
    held, parts = None, {}

    def pairs() -> Iterator[pa.RecordBatch]:
        if parts and (not both or len(parts) == 2):
            yield from _met(parts, keys, least)

    both = False
    for batch in batches:
        cell, second = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "second"))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (second[1:] != second[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
            if a == b:
                continue
            if held != cell[a]:
                yield from pairs()
                held, parts, both = cell[a], {}, batch.column("both")[int(a)].as_py()
            parts.setdefault(bool(second[a]), []).append(batch.slice(a, b - a).select(["item", "keys"]))
    yield from pairs()


def _multiplied(sets: DataFrame, n: int, keys: int, least: int) -> DataFrame:
    """The pairs of n sets by products of matrices: every two blocks of about BLOCK sets meet in a cell."""
    blocks = -(-n // BLOCK)
    cells = blocks * (blocks + 1) // 2
    own = sets.select("item", F.col("keys").cast("array<int>").alias("keys"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("part"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    rows = own.select((high * (high + 1) / 2 + low).cast("long").alias("cell"), (F.col("part") != F.col("other")).alias("both"), (F.col("part") > F.col("other")).alias("second"), "item", "keys")
    dealt = shipped(rows).repartition(cells, "cell").sortWithinPartitions("cell", "second")
    kind = sets.schema["item"].dataType.simpleString()
    found = dealt.mapInArrow(partial(_products, keys=keys, least=least), f"x {kind}, y {kind}, weight long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


def _looked_at(sets: DataFrame, n: int, least: int) -> float:
    """Subsets of so many keys, up to three, and pairs of sets that share one: as many as if keys were held independently."""
    size = F.size("keys").cast("double")
    per = sets.select(F.explode("keys").alias("rank")).groupBy("rank").agg((F.count("*") / n).alias("p"))
    p1, p2, p3 = per.agg(*(F.sum(F.pow("p", F.lit(2.0 * k))) for k in (1, 2, 3))).first()
    three = least > 2
    own = sets.agg(F.sum(size * (size - 1) * (size - 2) / 6 if three else size * (size - 1) / 2)).first()[0]
    return own + n * n / 2 * ((p1**3 - 3 * p1 * p2 + 2 * p3) / 6 if three else (p1 * p1 - p2) / 2)


def _by_subsets(sets: DataFrame, first: Column, keys: int, least: int) -> DataFrame:
    """The pairs of sets that meet at each first key, in cells of at most subsets.SETS sets by as many."""
    rows = written(_cells(sets.select("item", F.col("keys").cast("array<int>").alias("keys"), F.posexplode(first).alias("at", "rank")), subsets.SETS).drop("at"))
    n, cells = rows.count(), rows.select("rank", "low", "high").distinct().count()
    dealt = storage.dealt(shipped(rows), min(cells, -(-n // 20_000)), "rank", "low", "high").sortWithinPartitions("rank", "low", "high")
    kind = sets.schema["item"].dataType.simpleString()
    found = dealt.select("rank", "low", "high", "part", "item", "keys").mapInArrow(partial(subsets.met, keys=keys, least=least), f"x {kind}, y {kind}, weight long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")


def overlapping(postings: DataFrame, item: str, key: str, least: int = 2, cell: int = CELL) -> DataFrame:
    """(a, b, weight) with a < b for each two items that share at least `least` keys. Null items and keys count for nothing."""
    if least < 1:
        raise ValueError("pairs that share nothing aren't listed")
    sets = written(ranked_sets(postings, item, key, least))
    first = F.slice("keys", F.lit(1), F.size("keys") - (least - 1))
    lists = sets.select(F.explode(first).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))
    met = lists.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    n, keys = sets.agg(F.count("*"), F.max(F.element_at("keys", -1))).first()
    if keys and n * (n - 1) / 2 * keys <= ENTRIES * met:
        if 2 <= least and keys <= subsets.KEYS and subsets.WORTH * _looked_at(sets, n, least) < n * (n - 1) / 2 * keys:
            return _by_subsets(sets, first, keys, least)
        return _multiplied(sets, n, keys, least)
    dealt = written(_cells(sets.select("item", "keys", F.posexplode(first).alias("at", "rank")), cell))
    discard(sets)
    side = lambda x: dealt.select("rank", "low", "high", F.col("item").alias(x), F.col("keys").alias(f"k{x}"), F.col("at").alias(f"at_{x}"), F.col("part").alias(f"part_{x}"))
    both = side("a").join(side("b"), ["rank", "low", "high"]).filter("a < b and (low = high or part_a != part_b)")
    left = F.least(F.size("ka") - F.col("at_a"), F.size("kb") - F.col("at_b"))
    both = both.filter(left >= least).withColumn("shared", F.array_intersect("ka", "kb"))
    return both.filter((F.element_at("shared", 1) == F.col("rank")) & (F.size("shared") >= least)).select("a", "b", F.size("shared").cast("long").alias("weight"))
