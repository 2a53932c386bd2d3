"""Regular monthly series: counts, gap filling, rolling statistics, bursts, trends, seasonality, periodicity.

A series is a frame (keys..., period DATE, value). All windows run over series that are already aggregated to one row
per key and month. Rows without a period are dropped before counting, as are null keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTINEL = 999.0


def monthly_counts(df: DataFrame, ts: str | Column, keys: Sequence[str] = (), grain: str = "MM") -> DataFrame:
    """Rows per month (grain MM) or year (YYYY)."""
    period = F.trunc(F.col(ts) if isinstance(ts, str) else ts, grain)
    return df.select(*keys, period.alias("period")).filter("period is not null").groupBy(*keys, "period").agg(F.count("*").alias("value"))


def gap_filled(series: DataFrame, keys: Sequence[str] = (), bounds: str = "own", first: str | None = None, last: str | None = None) -> DataFrame:
    """Adds the missing months with value 0, from each key's first month to its last, or over the whole frame's range."""
    ends = series.groupBy(*keys).agg(F.min("period").alias("lo"), F.max("period").alias("hi")).filter("lo is not null")
    if bounds == "global":
        whole = series.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
        ends = ends.select(*keys).crossJoin(F.broadcast(whole)).filter("lo is not null")
    lo, hi = F.to_date(F.lit(first)) if first else F.col("lo"), F.to_date(F.lit(last)) if last else F.col("hi")
    spine = ends.select(*keys, F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("period"))
    return spine.join(series, [*keys, "period"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("period") if keys else Window.orderBy("period")


def moving_average(series: DataFrame, window: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    return series.withColumn("moving_avg", F.avg("value").over(_by(keys).rowsBetween(1 - window, 0)))


def rolling_z(series: DataFrame, keys: Sequence[str] = (), window: int = 12, min_periods: int = 3) -> DataFrame:
    """z of each value in the trailing window that ends with it; no z before min_periods rows; a deviation of 0 counts as 1."""
    frame = _by(keys).rowsBetween(1 - window, 0)
    enough = F.count("value").over(frame) >= min_periods
    std = F.stddev_samp("value").over(frame)
    out = series.withColumn("mean", F.when(enough, F.avg("value").over(frame))).withColumn("std", F.when(enough, F.when(std == 0, F.lit(1.0)).otherwise(std)))
    return out.withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))


def bursts(series: DataFrame, threshold: float = 2.0, quiet: float = -1.5, **options) -> DataFrame:
    z = rolling_z(series, **options)
    return z.withColumn("is_burst", F.coalesce(F.col("z") > threshold, F.lit(False))).withColumn("is_quiet", F.coalesce(F.col("z") < quiet, F.lit(False)))


def series_summary(series: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    """Totals, spread, extreme months (the first of equals) and burst counts of each series."""
    flagged = bursts(series, keys=keys, **options)
    first = F.struct(-F.unix_date("period"))
    return flagged.groupBy(*keys).agg(
        F.sum("value").alias("total"), F.count("*").alias("months"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"),
        F.max_by("period", F.struct("value", first)).alias("peak_month"), F.min_by("period", F.struct("value", F.struct(F.unix_date("period")))).alias("low_month"),
        F.sum(F.col("is_burst").cast("long")).alias("n_bursts"), F.sum(F.col("is_quiet").cast("long")).alias("n_quiet"),
    )


def keyword_bursts(series: DataFrame, key: str = "keyword", window: int = 12, threshold: float = 2.5, min_active: int = 6) -> DataFrame:
    """Bursts per keyword: at least min_active months with a value; a rolling deviation of 0 or null falls back to the series' own."""
    whole, frame = Window.partitionBy(key), Window.partitionBy(key).orderBy("period").rowsBetween(1 - window, 0)
    own = F.stddev_samp("value").over(whole)
    std = F.when(F.count("value").over(frame) >= 3, F.stddev_samp("value").over(frame))
    out = series.withColumn("active", F.sum((F.col("value") > 0).cast("int")).over(whole)).withColumn("own", own)
    out = out.filter((F.col("active") >= min_active) & (F.col("own") > 0))
    mean = F.when(F.count("value").over(frame) >= 3, F.avg("value").over(frame))
    out = out.withColumn("mean", mean).withColumn("std", F.when((std == 0) | std.isNull(), F.col("own")).otherwise(std))
    return out.withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).filter(F.col("z") > threshold).select(key, "period", "value", "z")


def trend_ratio(dated: DataFrame, key: str, recent_months: int = 12, top: int | None = 50, rising: float = 1.2, falling: float = 0.8) -> DataFrame:
    """Recent against earlier monthly average per key; the earlier one divides by its distinct active months.

    Everything follows from the counts per key and month, which are shuffled once.
    """
    monthly = dated.filter("period is not null").groupBy(key, "period").agg(F.count("*").alias("n"))
    last = monthly.agg(F.max("period").alias("last"))
    marked = monthly.crossJoin(F.broadcast(last)).withColumn("recent", F.col("period") > F.add_months("last", -recent_months))
    per = marked.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("recent"), F.col("n")).otherwise(0)).alias("n_recent"), F.count_if(~F.col("recent")).alias("active"))
    if top:
        per = per.orderBy(F.desc("total"), key).limit(top)
    recent = F.col("n_recent") / recent_months
    earlier = (F.col("total") - F.col("n_recent")) / F.greatest("active", F.lit(1))
    ratio = F.when(earlier > 0, recent / earlier).otherwise(F.when(recent > 0, F.lit(SENTINEL)).otherwise(0.0))
    out = per.select(key, "total", recent.alias("recent_avg"), earlier.alias("historical_avg"), ratio.alias("ratio"))
    return out.withColumn("direction", F.when(F.col("ratio") > rising, "rising").when(F.col("ratio") < falling, "declining").otherwise("stable"))


def first_seen(dated: DataFrame, key: str) -> DataFrame:
    return dated.groupBy(key).agg(F.min("period").alias("first_seen"), F.count("*").alias("total"))


def keyword_spans(dated: DataFrame, key: str = "keyword", recent_months: int = 24, gone_months: int = 12, min_total: int = 5) -> DataFrame:
    """First and last month per keyword; emergent if first seen lately, vanishing if common once and not seen lately."""
    monthly = dated.filter("period is not null").groupBy(key, "period").agg(F.count("*").alias("n"))
    last = monthly.agg(F.max("period").alias("end"))
    recent = F.when(F.col("period") > F.add_months("end", -recent_months), F.col("n")).otherwise(0)
    per = monthly.crossJoin(F.broadcast(last)).groupBy(key).agg(F.min("period").alias("first"), F.max("period").alias("last"), F.sum("n").alias("total"), F.sum(recent).alias("recent_count"), F.max("end").alias("end"))
    emergent, vanishing = F.col("first") > F.add_months("end", -recent_months), (F.col("last") < F.add_months("end", -gone_months)) & (F.col("total") >= min_total)
    return per.select(key, "first", "last", "total", "recent_count", emergent.alias("is_emergent"), vanishing.alias("is_vanishing"))


def seasonality(series: DataFrame) -> DataFrame:
    return series.groupBy(F.month("period").alias("month_of_year")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.sum("value").alias("total"))


def year_month_pivot(series: DataFrame) -> DataFrame:
    wide = series.withColumn("m", F.month("period")).groupBy(F.year("period").alias("year")).pivot("m", list(range(1, 13)))
    return wide.agg(F.sum("value")).na.fill(0).select("year", *(F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))


def autocorrelation(series: DataFrame, max_lag: int = 48) -> DataFrame:
    """Pearson correlation of the series with itself, lag months before; significant beyond 2/sqrt(n)."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    at = series.select("value", F.row_number().over(Window.orderBy("period")).alias("i"), n.alias("n"))
    lagged = at.select(F.col("value").alias("x"), F.col("i"), "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_lag), F.col("n") - 1).cast("int"))).alias("lag")).filter("n > 1")
    before = at.select(F.col("value").alias("y"), F.col("i").alias("j"))
    both = lagged.join(before, F.col("j") == F.col("i") - F.col("lag"))
    return both.groupBy("lag").agg(F.corr("x", "y").alias("r"), F.max("n").alias("n")).select("lag", "r", (F.abs("r") > 2 / F.sqrt("n")).alias("significant"))


def periodogram(series: DataFrame) -> DataFrame:
    """Power at each whole frequency of the linearly detrended series, without the mean."""
    one = Window.partitionBy(F.lit(1))
    at = series.select(F.col("value").cast("double").alias("v"), (F.row_number().over(Window.orderBy("period")) - 1).cast("double").alias("t"), F.count("*").over(one).alias("n"))
    fit = at.agg(F.regr_slope("v", "t").alias("slope"), F.regr_intercept("v", "t").alias("icpt"))
    flat = at.crossJoin(F.broadcast(fit)).select("t", "n", (F.col("v") - F.col("slope") * F.col("t") - F.col("icpt")).alias("x")).filter("n > 1")
    waves = flat.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    angle = 2 * F.pi() * F.col("k") * F.col("t") / F.col("n")
    per = waves.groupBy("k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"), F.max("n").alias("n"))
    return per.select("k", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"), (F.col("n") / F.col("k")).alias("period_months"))
