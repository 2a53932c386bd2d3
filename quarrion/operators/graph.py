"""Graphs of labels and documents: an edge list (a, b, weight) with a < b."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import references
from quarrion.operators.numbering import numbered, running_sums
from quarrion.operators.search import top_per_group
from quarrion.shipping import shipped
from quarrion.storage import discard, written

OTHER = "Other"
#: Edges of a group of nodes that one task holds while it closes triangles, about.
GROUP_EDGES = 500_000


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass."""
    ways = F.array(F.struct("a", "b", "weight"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return edges.select(F.explode(ways).alias("e")).select("e.*")


def node_stats(nodes: DataFrame, edges: DataFrame, node: str = "label") -> DataFrame:
    """Degree and mean edge weight of every node; nodes without edges have degree 0."""
    per = symmetric(edges).groupBy(F.col("a").alias(node)).agg(F.count("*").alias("degree"), F.avg("weight").alias("avg_weight"))
    return nodes.join(per, node, "left").na.fill({"degree": 0, "avg_weight": 0.0})


class _Lists:
    """The lists of one group of nodes, each with the nodes it points to, against which the lists of their targets are held."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.low: np.ndarray | None = None

    def add(self, nodes: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> None:
        self.parts.append((nodes, sizes, to))

    def close(self) -> None:
        self.low, sizes, to = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.names, self.to = np.unique(to, return_inverse=True)
        self.by = np.argsort(self.to, kind="stable")
        self.first = np.searchsorted(self.to[self.by], np.arange(len(self.names) + 1))
        self.own = np.repeat(np.arange(len(self.low)), sizes)
        self.marks = np.zeros(len(self.names), bool)
        self.n_low, self.n_to, self.seen, self.room = np.zeros(len(self.low), np.int64), np.zeros(len(self.names), np.int64), [], 0

    def meet(self, mid: int, to: np.ndarray) -> None:
        """Triangles of every node of the group that points to mid, and of what both point to."""
        at = np.searchsorted(self.names, mid)
        lows = self.own[self.by[self.first[at] : self.first[at + 1]]]
        places = np.searchsorted(self.names, to)
        places = places[places < len(self.names)]
        places = places[np.isin(self.names[places], to)]
        self.marks[places] = True
        third = np.concatenate([self.to[self.ends[k] : self.ends[k + 1]] for k in lows])
        hit = self.marks[third]
        self.marks[places] = False
        starts = np.concatenate([[0], np.cumsum(self.ends[lows + 1] - self.ends[lows])[:-1]])
        self.n_low[lows] += np.add.reduceat(hit, starts, dtype=np.int64)
        third = third[hit]
        self.n_to[at] += len(third)
        self.seen.append(third)
        self.room += len(third)
        if self.room > GROUP_EDGES:
            self.flush()

    def flush(self) -> None:
        self.n_to += np.bincount(np.concatenate([np.empty(0, np.int64), *self.seen]), minlength=len(self.names))
        self.seen, self.room = [], 0

    def counts(self) -> Iterator[pa.RecordBatch]:
        if self.low is not None:
            self.flush()
            node, n = np.concatenate([self.low, self.names]), np.concatenate([self.n_low, self.n_to])
            yield pa.record_batch([pa.array(node[n > 0]), pa.array(n[n > 0])], ["id", "n"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n) from rows (part, asked, id, to) in the order of part and asked: a group's own lists, then those of its targets."""
    part, held = None, _Lists()
    for batch in batches:
        parts, asked, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "asked", "id"))
        ends, to = batch.column("to").offsets.to_numpy(), batch.column("to").values.to_numpy()
        cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (asked[1:] != asked[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, len(parts)], strict=True):
            if i < j and parts[i] != part:
                yield from held.counts()
                part, held = parts[i], _Lists()
            if i < j and not asked[i]:
                held.add(ids[i:j], np.diff(ends[i : j + 1]), to[ends[i] : ends[j]])
            elif i < j:
                if held.low is None:
                    held.close()
                for k in range(i, j):
                    held.meet(ids[k], to[ends[k] : ends[k + 1]])
    yield from held.counts()


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles) for every node of a triangle.

    Edges point from the node of lower degree to the one of higher, so a node points to at most the root of twice the number of
    edges, hubs to few. An edge's triangles are what its ends both point to: no pair of a hub's neighbours is ever made. Nodes
    next to each other form groups of GROUP_EDGES edges; the list of a node goes once to each group that points to it, not
    once for each edge, and a task holds one group and meets the lists of its targets one by one.
    """
    edges = written(edges.select("a", "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    nodes = written(numbered(degree, ["node"], "id"))
    end = lambda x: nodes.select(F.col("node").alias(x), F.struct("d", "id").alias(f"at_{x}"))
    ends = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("at_a", "at_b")["id"].alias("id"), F.greatest("at_a", "at_b")["id"].alias("to"))
    points = ends.groupBy("id").agg(F.collect_list("to").alias("to")).withColumn("size", F.size("to"))
    points = written(running_sums(points, ["id"], {"upto": "size"}).select(F.floor((F.col("upto") - F.col("size")) / GROUP_EDGES).alias("part"), "id", "to"))
    asked = points.select("part", F.explode("to").alias("id")).distinct().join(points.select("id", "to"), "id")
    rows = points.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    most = points.agg(F.max("part")).first()[0] or 0
    dealt = shipped(rows).repartition(int(most) + 1, "part").sortWithinPartitions("part", "asked")
    found = dealt.select("part", "asked", "id", "to").mapInArrow(_closed, "id long, n long").groupBy("id").agg(F.sum("n").alias("triangles"))
    return found.join(nodes.select("id", "node"), "id").select("node", "triangles")


def bridge_scores(edges: DataFrame, max_neighbors: int | None = None, min_degree: int = 2) -> DataFrame:
    """Share of a node's neighbour pairs that aren't linked, and that share times the degree.

    All neighbours count: pairs follow from the degree, and those that are linked are the node's triangles. With max_neighbors,
    of more neighbours those with the largest weights count, ties by name.
    """
    edges = written(edges)
    both = symmetric(edges)
    degree = both.groupBy("a").agg(F.count("*").alias("degree")).filter(F.col("degree") >= min_degree).withColumnRenamed("a", "node")
    score = (F.col("pairs") - F.col("linked")) / F.col("pairs")
    if max_neighbors is None:
        pairs = (F.col("degree") * (F.col("degree") - 1) / 2).cast("long")
        per = degree.withColumn("pairs", pairs).join(triangles(edges), "node", "left").withColumn("linked", F.coalesce("triangles", F.lit(0)))
        return per.filter("pairs > 0").select("node", "degree", "pairs", score.alias("bridge_score"), (score * F.col("degree")).alias("weighted_score"))
    near = top_per_group(both, ["a"], [F.desc("weight"), F.col("b")], max_neighbors).withColumnRenamed("a", "node").join(degree, "node").select("node", "b")
    wedges = near.select("node", F.col("b").alias("x")).join(near.select("node", F.col("b").alias("y")), "node").filter("x < y")
    linked = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.lit(1).alias("linked"))
    per = wedges.join(linked, ["x", "y"], "left").groupBy("node").agg(F.count("*").alias("pairs"), F.count("linked").alias("linked"))
    return per.join(degree, "node").select("node", "degree", "pairs", score.alias("bridge_score"), (score * F.col("degree")).alias("weighted_score"))


def unlinked_examples(edges: DataFrame, neighbors: int = 10, examples: int = 3) -> DataFrame:
    """Per node, the first pairs of its heaviest neighbours that aren't linked."""
    edges = written(edges)
    near = top_per_group(symmetric(edges), ["a"], [F.desc("weight"), F.col("b")], neighbors).select(F.col("a").alias("node"), F.col("b").alias("n"))
    pairs = near.select("node", F.col("n").alias("a")).join(near.select("node", F.col("n").alias("b")), "node").filter("a < b")
    return top_per_group(pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti"), ["node"], [F.col("a"), F.col("b")], examples).select("node", "a", "b")


def _linked(edges: DataFrame) -> tuple:
    """What tells one set of edges from another, in any order."""
    h = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with an edge to another.

    Large and small stars in turn: every node links its greater neighbours, then its lesser ones, to the least of them, until
    nothing changes. Each step is a grouped minimum and a join that splits where it is skewed, so a giant component's root isn't a
    key that all of its nodes are joined on.
    """
    stars = written(edges.filter("a != b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    mark = _linked(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.first("high")).alias("least"))
        large = written(both.filter("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low")).filter("high != low").distinct())
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        kept = large.join(least, "high")
        small = kept.select(F.greatest("low", "least").alias("high"), F.least("low", "least").alias("low")).unionByName(kept.select("high", F.col("least").alias("low")))
        after = written(small.filter("high != low").distinct())
        discard(large, stars)
        stars, before, mark = after, mark, _linked(after)
        if mark == before:
            break
    return stars.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(stars.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())


def communities(nodes: DataFrame, edges: DataFrame, min_weight: int = 5, node: str = "label") -> DataFrame:
    """Component of every node on edges of the least weight; nodes alone are one group."""
    roots = components(edges.filter(F.col("weight") >= min_weight)).withColumnRenamed("node", node)
    return nodes.join(roots, node, "left").withColumn("community", F.coalesce(F.col("root").cast("string"), F.lit(OTHER))).drop("root")


def reference_edges(excerpts: DataFrame, item: str = "url", text: str = "text", most: int = 100) -> DataFrame:
    """An edge from an item to each reference in its excerpts, with the first characters of the excerpt as context."""
    return excerpts.select(item, F.explode(references(F.col(text))).alias("ref"), F.substring(text, 1, most).alias("context"))


def ego_network(edges: DataFrame, node: str, n: int = 20) -> DataFrame:
    """The heaviest neighbours of a node, ties by name."""
    own = edges.filter((F.col("a") == node) | (F.col("b") == node))
    other: Column = F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a"))
    return own.select(other.alias("neighbor"), "weight").orderBy(F.desc("weight"), "neighbor").limit(n)


def reading_path(postings: DataFrame, start, item: str = "url", key: str = "keyword", depth: int = 2, per_key: int = 3, most: int = 20) -> DataFrame:
    """Breadth-first path from an item over shared keys: per key the first so many new items, up to most in all.

    The frontier and what is visited are bounded by most, so they travel as small tables.
    """
    spark = postings.sparkSession
    path = [(start, 0)]
    frontier = [start]
    kind = postings.schema[item].dataType.simpleString()
    for level in range(1, depth + 1):
        own = spark.createDataFrame([(x,) for x in frontier], f"{item} {kind}")
        seen = spark.createDataFrame([(x,) for x, _ in path], f"{item} {kind}")
        keys = postings.join(F.broadcast(own), item, "left_semi").select(key).distinct()
        new = postings.join(keys, key, "left_semi").join(F.broadcast(seen), item, "left_anti").select(key, item).distinct()
        found = top_per_group(new, [key], [F.col(item)], per_key).select(item).distinct().orderBy(item).limit(most - len(path))
        frontier = [r[0] for r in found.collect()]
        path += [(x, level) for x in frontier]
        if not frontier or len(path) >= most:
            break
    return spark.createDataFrame(path, f"{item} {kind}, depth int")
