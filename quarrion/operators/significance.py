"""Whether two samples differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.operators.numbering import running_sums

#: Terms of the series of the limit distribution.
TERMS = 100


def largest_gap(rows: DataFrame, value: str, own: str) -> DataFrame:
    """(ks): the greatest difference of the distribution functions of the values where own is 1 and where it is 0.

    Exact at every distinct value. Rows are counted by value first; the counts run up over ranges of values, in many tasks.
    """
    counts = rows.groupBy(F.col(value).alias("x")).agg(F.sum(own).alias("a"), F.sum(1 - F.col(own)).alias("b"))
    sums = running_sums(counts, ["x"], {"sum_a": "a", "sum_b": "b"})
    total = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    return sums.crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("sum_a") / F.col("n_a") - F.col("sum_b") / F.col("n_b"))).alias("ks"))


def ks_probability(ks: Column, n_a: Column, n_b: Column) -> Column:
    """How likely so large a gap is by chance, by the limit distribution."""
    size = n_a * n_b / (n_a + n_b) * ks * ks
    terms = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * size))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def two_samples(rows: DataFrame, value: str, own: str) -> DataFrame:
    """One row that compares the values where own is 1 (a) with those where it is 0 (b); null values are left out.

    mean_a, mean_b and their ratio; Welch's t with its degrees of freedom df, from moments; ks and ks_p.
    """
    rows = rows.filter(F.col(value).isNotNull())
    a, b = (F.when(F.col(own) == k, F.col(value)) for k in (1, 0))
    moments = rows.agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.var_samp(a) / F.count(a)).alias("v_a"), (F.var_samp(b) / F.count(b)).alias("v_b"), F.count(a).alias("n_a"), F.count(b).alias("n_b"))
    both = moments.crossJoin(F.broadcast(largest_gap(rows, value, own)))
    v_a, v_b = F.col("v_a"), F.col("v_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(v_a + v_b)
    df = (v_a + v_b) * (v_a + v_b) / (v_a * v_a / (F.col("n_a") - 1) + v_b * v_b / (F.col("n_b") - 1))
    return both.select("mean_a", "mean_b", (F.col("mean_a") / F.col("mean_b")).alias("ratio"), t.alias("t"), df.alias("df"), "ks", ks_probability(F.col("ks"), F.col("n_a"), F.col("n_b")).alias("ks_p"))
