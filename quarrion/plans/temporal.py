"""Temporal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.operators import timeseries as T
from quarrion.operators.cooccurrence import pairs
from quarrion.plans import entities as E
from quarrion.plans.registry import Registry

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle


MONTHS = E.ARTICLES + """, m as (select month as period, count(*) as value from articles group by month),
spine as (select cast(unnest(generate_series((select min(period) from m), (select max(period) from m), interval 1 month)) as date) as period),
series as (select s.period, coalesce(m.value, 0) as value from spine s left join m using (period))"""
Z = MONTHS + """, w as (
    select period, value, count(*) over f as c, avg(value) over f as mean, stddev_samp(value) over f as sd from series
    window f as (order by period rows between 11 preceding and current row)),
z as (select period, value, case when c >= 3 then mean end as mean, case when c >= 3 then case when sd = 0 then 1.0 else sd end end as std from w),
zz as (select *, (value - mean) / std as z from z)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.gap_filled(T.monthly_counts(E.articles(spark, sf_dir), "month"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.labels(spark, sf_dir).withColumnRenamed("month", "period")


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.postings(spark, sf_dir).withColumnRenamed("month", "period")


@query(f"with {E.ARTICLES} select month as period, count(*) as value from articles group by month", dates="period")
def monthly_counts(spark, sf_dir):
    return T.monthly_counts(E.articles(spark, sf_dir), "month")


@query(f"with {E.ARTICLES} select cast(date_trunc('year', month) as date) as period, count(*) as value from articles group by 1", dates="period")
def yearly_counts(spark, sf_dir):
    return T.monthly_counts(E.articles(spark, sf_dir), "month", grain="YYYY")


@query(f"with {MONTHS} select period, value from series", dates="period")
def gap_filled_months(spark, sf_dir):
    return _series(spark, sf_dir)


@query(f"with {Z} select period, value, round(mean, 4) as mean, round(std, 4) as std, round(z, 4) as z, coalesce(z > 2.0, false) as is_burst, coalesce(z < -1.5, false) as is_quiet from zz", dates="period", rounded="mean std z")
def monthly_bursts(spark, sf_dir):
    return T.bursts(_series(spark, sf_dir))


@query(f"with {MONTHS} select period, value, round(avg(value) over (order by period rows between 5 preceding and current row), 4) as moving_avg from series", dates="period", rounded="moving_avg")
def moving_average(spark, sf_dir):
    return T.moving_average(_series(spark, sf_dir))


@query(f"""with {Z} select sum(value)::bigint as total, count(*) as months, round(avg(value), 4) as mean, median(value)::double as median, round(stddev_samp(value), 4) as std,
    arg_max(period, value * 100000 - epoch(period) / 86400) as peak_month, arg_min(period, value * 100000 + epoch(period) / 86400) as low_month,
    count(*) filter (where z > 2.0) as n_bursts, count(*) filter (where z < -1.5) as n_quiet from zz""", dates="peak_month low_month", rounded="mean std")
def series_summary(spark, sf_dir):
    return T.series_summary(_series(spark, sf_dir))


@query(f"with {E.LABELS} select label, min(month) as first_seen, count(*) as total from labels group by label", dates="first_seen")
def label_first_seen(spark, sf_dir):
    return T.first_seen(_dated(spark, sf_dir), "label")


_TREND = """, mx as (select max(month) as last from {src}),
p as (select {key}, count(*) as total, count(*) filter (where month > last - interval 12 month) as n_recent, count(distinct case when month <= last - interval 12 month then month end) as active
      from {src}, mx group by {key} order by total desc, {key} limit {top}),
r as (select *, n_recent / 12.0 as ra, (total - n_recent)::double / greatest(active, 1) as ha from p),
q as (select *, case when ha > 0 then ra / ha when ra > 0 then 999.0 else 0.0 end as ratio from r)
select {key}, total, round(ra, 4) as recent_avg, round(ha, 4) as historical_avg, round(ratio, 4) as ratio,
       case when ratio > 1.2 then 'rising' when ratio < 0.8 then 'declining' else 'stable' end as direction from q"""


@query(f"with {E.LABELS}" + _TREND.format(src="labels", key="label", top=50), rounded="recent_avg historical_avg ratio")
def label_trends(spark, sf_dir):
    return T.trend_ratio(_dated(spark, sf_dir), "label")


_PAIRS = """, pairs as (select a.article_id, a.month, a.label || '|' || b.label as pair from labels a join labels b on a.article_id = b.article_id and a.label < b.label)"""


@query(f"with {E.LABELS}{_PAIRS}" + _TREND.format(src="pairs", key="pair", top=20), rounded="recent_avg historical_avg ratio")
def pair_shifts(spark, sf_dir):
    both = pairs(_dated(spark, sf_dir), "article_id", "label", ("period",)).select("period", F.concat_ws("|", "a", "b").alias("pair"))
    return T.trend_ratio(both, "pair", top=20)


@query(f"""with {E.LABELS}, m as (select label, month as period, count(*) as value from labels group by all),
    e as (select min(period) as lo, max(period) as hi from m),
    s as (select label, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as period from (select distinct label from m), e)
    select label, period, coalesce(value, 0) as value from s left join m using (label, period)""", dates="period")
def label_timelines(spark, sf_dir):
    return T.gap_filled(T.monthly_counts(_dated(spark, sf_dir), "period", ["label"]), ["label"], bounds="global")


_KEYWORD = E.POSTINGS + """, m as (select keyword, month as period, count(*) as value from postings group by all),
e as (select keyword, min(period) as lo, max(period) as hi from m group by keyword),
s as (select keyword, cast(unnest(generate_series(lo, hi, interval 1 month)) as date) as period from e),
series as (select keyword, period, coalesce(value, 0) as value from s left join m using (keyword, period))"""


@query(f"with {_KEYWORD} select keyword, period, value from series", dates="period")
def keyword_timelines(spark, sf_dir):
    return T.gap_filled(T.monthly_counts(_posted(spark, sf_dir), "period", ["keyword"]), ["keyword"])


@query(f"""with {_KEYWORD}, w as (
    select *, sum((value > 0)::int) over (partition by keyword) as active, stddev_samp(value) over (partition by keyword) as own, count(*) over f as c, avg(value) over f as mean, stddev_samp(value) over f as sd
    from series window f as (partition by keyword order by period rows between 11 preceding and current row)),
    z as (select keyword, period, value, (value - case when c >= 3 then mean end) / case when c < 3 or sd = 0 or sd is null then own else sd end as z from w where active >= 6 and own > 0)
    select keyword, period, value, round(z, 4) as z from z where z > 2.5""", dates="period", rounded="z")
def keyword_bursts(spark, sf_dir):
    series = T.gap_filled(T.monthly_counts(_posted(spark, sf_dir), "period", ["keyword"]), ["keyword"])
    return T.keyword_bursts(series)


@query(f"""with {E.POSTINGS}, mx as (select max(month) as hi from postings),
    p as (select keyword, min(month) as first, max(month) as last, count(*) as total, count(*) filter (where month > hi - interval 24 month) as recent_count, max(hi) as hi from postings, mx group by keyword)
    select keyword, first, last, total, recent_count, first > hi - interval 24 month as is_emergent, last < hi - interval 12 month and total >= 5 as is_vanishing from p""", dates="first last")
def keyword_spans(spark, sf_dir):
    return T.keyword_spans(_posted(spark, sf_dir))


@query(f"with {MONTHS} select month(period)::int as month_of_year, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, sum(value)::bigint as total from series group by 1", rounded="mean std")
def seasonality(spark, sf_dir):
    return T.seasonality(_series(spark, sf_dir))


@query(f"with {MONTHS} select year(period)::int as year, " + ", ".join(f"coalesce(sum(value) filter (where month(period) = {m}), 0)::bigint as m{m:02d}" for m in range(1, 13)) + " from series group by 1")
def year_month_pivot(spark, sf_dir):
    return T.year_month_pivot(_series(spark, sf_dir))


@query(f"""with {MONTHS}, i as (select value, row_number() over (order by period) as i, count(*) over () as n from series)
    select l.lag::int as lag, round(corr(a.value, b.value), 4) as r, abs(corr(a.value, b.value)) > 2 / sqrt(max(a.n)) as significant
    from generate_series(1, 48) l(lag) join i a on l.lag <= a.n - 1 join i b on b.i = a.i - l.lag group by l.lag""", rounded="r")
def autocorrelation(spark, sf_dir):
    return T.autocorrelation(_series(spark, sf_dir))


@query(f"""with {MONTHS}, i as (select value::double as v, (row_number() over (order by period) - 1)::double as t, count(*) over () as n from series),
    f as (select regr_slope(v, t) as s, regr_intercept(v, t) as c from i),
    x as (select t, n, v - s * t - c as x from i, f)
    select k::int as k, round(sum(x * cos(2 * pi() * k * t / n)) ** 2 + sum(x * sin(2 * pi() * k * t / n)) ** 2, 2) as power, round(max(n) / k, 4) as period_months
    from x, generate_series(1, 1000) g(k) where k <= n // 2 group by k""")
def periodogram(spark, sf_dir):
    return T.periodogram(_series(spark, sf_dir)).select("k", F.round("power", 2).alias("power"), F.round("period_months", 4).alias("period_months"))


@query(f"with {E.LABELS} select label as category, month, count(*) as n from labels where label in ('Brand#11', 'Brand#12') group by all", dates="month")
def category_timeline(spark, sf_dir):
    picked = E.labels(spark, sf_dir).filter(F.col("label").isin("Brand#11", "Brand#12"))
    return picked.groupBy(F.col("label").alias("category"), "month").agg(F.count("*").alias("n"))


@query(f"with {E.POSTINGS} select keyword, min(month) as first_month from postings group by keyword", dates="first_month")
def first_occurrences(spark, sf_dir):
    return E.postings(spark, sf_dir).groupBy("keyword").agg(F.min("month").alias("first_month"))


@query(f"""with {E.POSTINGS}, m as (select month, count(*) as n from postings where keyword = 'Brand#11' group by month)
    select sum(n)::bigint as total, min(month) as first_month, arg_max(month, n * 100000 - epoch(month) / 86400) as peak_month, max(n) as peak from m""", dates="first_month peak_month")
def reading_timeline(spark, sf_dir):
    per = E.postings(spark, sf_dir).filter("keyword = 'Brand#11'").groupBy("month").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("total"), F.min("month").alias("first_month"), F.max_by("month", F.struct("n", -F.unix_date("month"))).alias("peak_month"), F.max("n").alias("peak"))
