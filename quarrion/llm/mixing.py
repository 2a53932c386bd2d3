"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a seeded hash and read up to three times over. A copy of a document gets its virtual
finish time: the tokens its source has served up to and with it, divided by the source's target. All copies are
sorted by finish time over the whole corpus and the queue stops when the total budget is served. Copies that finish too
late to be reached aren't made. Both running sums have three levels (over coarse ranges of the hash or of time, over
the ranges of one of these, and over the rows of one range), so no source and no stretch of time goes through a single
task: a task orders about RANGE_ROWS rows or ranges.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a row of size 0 takes
nothing. Rows with the same id and text are told apart by their position in the shuffle. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.llm.shared import doc_text, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Rows of a range of the shuffle or of the queue, about.
RANGE_ROWS = 1024


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: its size, and its target after the excess over MAX_REPEATS times its size went to the others.

    A target is min(3 * size, level * weight); the level follows from the sources in the order in which they fill up.
    The table has a row per source, so its windows are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", MAX_REPEATS * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # The first source in that order that doesn't fill up sets the level of all that come after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("source").isNull().alias("last"), F.col("source").alias("s"), F.col("level").alias("level")))).over(whole)
    per = per.withColumn("at", level)
    target = F.when(F.col("level") * F.col("weight") > F.col("cap"), F.col("cap").cast("double")).otherwise(F.col("at.level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _ahead(sums: DataFrame, keys: list[str], by: str, coarse: Column, values: dict[str, str]) -> DataFrame:
    """Per row of sums (keys, by, and the values' columns): what comes before it in the order of by, under the new names.

    coarse doesn't fall where by rises. The rows of one coarse range are summed in a task, and the coarse ranges of one key.
    """
    rows = sums.withColumn("coarse", coarse)
    level = rows.groupBy(*keys, "coarse").agg(*(F.sum(v).alias(v) for v in values))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    level = level.select(*(F.col(k).alias(f"l_{k}") for k in keys), F.col("coarse").alias("l_coarse"), *(F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"l_{v}") for v in values))
    own = Window.partitionBy(*keys, "coarse").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*keys, by, "coarse", *(F.coalesce(F.sum(v).over(own), F.lit(0)).alias(v) for v in values))
    same = F.col("coarse") == F.col("l_coarse")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"l_{k}"))
    return rows.join(level, same).select(*keys, by, *((F.col(v) + F.col(f"l_{v}")).alias(name) for v, name in values.items()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, taken, n_copies and first_finish, its first finish time."""
    text = doc_text(text_col)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), F.md5(text)).cast("binary"))
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), order.alias("key")))
    rows = sized.count()
    digits = 1
    while 16**digits * RANGE_ROWS < rows:
        digits += 1

    targets = source_targets(sized)
    part = F.substring("key", 1, digits)
    ranged = sized.withColumn("part", part)
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("p_size"), F.count("*").alias("p_rows"))
    sums = _ahead(sums, ["source"], "part", F.substring("part", 1, (digits + 1) // 2), {"p_size": "s0", "p_rows": "r0"})
    sums = sums.withColumnsRenamed({"source": "p_source", "part": "p_part"}).join(targets.withColumnRenamed("source", "t_source"), F.col("p_source").eqNullSafe(F.col("t_source")))
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    ranged = ranged.withColumn("s1", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r1", F.row_number().over(own))
    served = ranged.join(sums, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("s0") + F.col("s1")).alias("served"), (F.col("r0") + F.col("r1")).alias("rank")
    )
    served = written(served)

    # At virtual time 1 each source has served its target, but for a part of one document at most; after it, those that
    # aren't at their cap go on. So the budget is served by the time in `end`.
    per = served.groupBy("source").agg(F.max("size").alias("most"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    late = per.agg(F.sum("most").alias("left"), F.sum(F.when(F.col("target") < MAX_REPEATS * F.col("source_size"), F.col("target"))).alias("rate")).first()
    end = 1 + (late["left"] or 0) / late["rate"] + 1e-9 if late["rate"] else float(MAX_REPEATS)
    last = F.least(F.lit(MAX_REPEATS - 1), F.floor((end * F.col("target") - F.col("served")) / F.col("source_size")).cast("int"))
    copies = served.filter("size > 0").withColumn("last", last).filter("last >= 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("last"))))
    copies = copies.withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("served")) / F.col("target"))
    span = max(1, MAX_REPEATS * rows // RANGE_ROWS)
    copies = copies.withColumn("stretch", F.floor(F.col("finish") * span))
    per = copies.groupBy("stretch").agg(F.sum("size").alias("t_size"))
    per = _ahead(per, [], "stretch", F.floor(F.col("stretch") / max(1, math.isqrt(span))), {"t_size": "t0"})
    queue = Window.partitionBy("stretch").orderBy("finish", F.col("source").asc_nulls_last(), "rank", "copy").rowsBetween(Window.unboundedPreceding, 0)
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    taken = copies.withColumn("t1", F.sum("size").over(queue)).join(per, "stretch").filter(2 * (F.col("t0") + F.col("t1")) - F.col("size") <= 2 * budget)
    taken = taken.groupBy(F.col("source").alias("t_source"), F.col("rank").alias("t_rank")).agg(F.count("*").alias("n"), F.min("finish").alias("first_finish"))
    out = served.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("rank") == F.col("t_rank")), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * n).alias("taken"), n.alias("n_copies"), "first_finish")
