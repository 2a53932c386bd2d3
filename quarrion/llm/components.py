"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrion.llm.shared import written


def _mark(edges: DataFrame) -> tuple:
    """A digest of the set of edges that doesn't depend on their order."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (u, v); the root is the least node of the component.

    Alternates large-star and small-star steps until the edges are stars. Every step is a grouped minimum and a join,
    and each is written to the shared folder, so lineage stays short and no neighbourhood is gathered.

    Edges may come in either direction and more than once. An edge with a null end, or from a node to itself, joins nothing, and
    its node isn't listed unless another edge has it. Without edges there are no rows. Other columns are left out.
    """
    edges = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(least, "u")
        small = kept.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(kept.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
