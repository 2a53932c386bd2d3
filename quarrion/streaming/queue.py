"""A work queue of urls as a stream of what happened to them, with retries.

An event says that a url was found, done, or failed. A url that failed waits twice as long after each failure, then it is
pending again; after the last try it is dead. Events may come in any order: done wins, failures are counted, and the latest one
decides when the wait ends. Null urls and null kinds are left out; a null time can't be waited for, so such a failure counts only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrion.shipping import shipped
from quarrion.storage import conf
from quarrion.streaming.incremental import STATE

TRIES, WAIT_MS = 3, 3_600_000
_RESULT = "url string, status string, failures int"


def _summed(events: DataFrame, also: Sequence[str]) -> DataFrame:
    """Per url what its events come to, in one partial aggregation."""
    failed = F.col("kind") == "failed"
    own = events.filter("url is not null and kind is not null").groupBy(F.col("url").cast("string").alias("url"), *also)
    return own.agg(F.bool_or(F.col("kind") == "done").alias("done"), F.count_if(failed).cast("int").alias("failures"), F.max(F.when(failed, F.unix_millis("at"))).alias("last"), F.max(F.unix_millis("at")).alias("seen"))


def _status(now: Column, tries: int, wait_ms: int) -> Column:
    until = F.coalesce(F.col("last"), F.lit(0)) + wait_ms * F.pow(F.lit(2), F.col("failures") - 1).cast("long")
    return F.when(F.col("done"), "done").when(F.col("failures") >= tries, "dead").when((F.col("failures") > 0) & (until > now), "waiting").otherwise("pending")


def queue_status(events: DataFrame, now: Column, tries: int = TRIES, wait_ms: int = WAIT_MS, also: Sequence[str] = ()) -> DataFrame:
    """(url, status, failures) of a table of events (url, kind, at), at a time in milliseconds; now may use the columns of also,
    which have one value in the whole table."""
    return _summed(events, also).select("url", _status(now, tries, wait_ms).alias("status"), "failures")


class Retries(StatefulProcessor):
    """A url's state: whether it is done, its failures, the time of the latest, and when the timer ends that stands for its wait.

    Calls to the state are what a url costs, so it is read once and written once, and timers are touched where a wait changes.
    """

    def __init__(self, tries: int, wait_ms: int):
        self.tries, self.wait_ms = tries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("url", "done boolean, failures int, last long, timer long")

    def row(self, key: tuple, now: int, own: tuple, before: int | None) -> Row:
        """The status of a url at a time. before: when its timer ends, if it has one."""
        done, failures, last = own
        until = last + self.wait_ms * 2 ** (failures - 1) if failures else 0
        waits = not done and 0 < failures < self.tries and until > now
        if before is not None and not (waits and until == before):
            self.handle.deleteTimer(before)
        if waits and until != before:
            self.handle.registerTimer(until)
        self.state.update((*own, until if waits else None))
        return Row(url=key[0], status="done" if done else "dead" if failures >= self.tries else "waiting" if waits else "pending", failures=failures)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, failures, last, timer = self.state.get() or (False, 0, 0, None)
        for r in rows:
            done = done or r.kind == "done"
            if r.kind == "failed":
                failures, last = failures + 1, max(last, r.ms or 0)
        yield self.row(key, timerValues.getCurrentWatermarkInMs(), (done, failures, last), timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, failures, last, timer = self.state.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield self.row(key, now, (done, failures, last), None if timer == now else timer)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, tries: int = TRIES, wait_ms: int = WAIT_MS, late: str = "10 minutes") -> DataFrame:
    """The changes of queue_status for a stream of events: a row whenever a url's events or the end of its wait change it."""
    rows = shipped(events).filter("url is not null and kind is not null").withWatermark("at", late)
    rows = rows.select(F.col("url").cast("string").alias("url"), F.col("kind").cast("string").alias("kind"), "at", F.unix_millis("at").alias("ms"))
    return rows.groupBy("url").transformWithState(Retries(tries, wait_ms), outputStructType=_RESULT, outputMode="Update", timeMode="EventTime")


def run_queue(events: DataFrame, out: str, checkpoint: str, tries: int = TRIES, wait_ms: int = WAIT_MS, late: str = "10 minutes") -> DataFrame:
    """Takes what there is of a stream of events, and reads the last status of each url. A batch's cost follows its events.

    A url's sums are the state of a streaming aggregation. Whether its wait has ended follows, where the statuses are read, from the
    watermark that queue_stream's timers go by: the latest event, less `late`.
    """
    spark: SparkSession = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with conf(spark, STATE):
        query = _summed(events, ()).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    seen = spark.read.schema("url string, done boolean, failures int, last long, seen long, batch long").parquet(out)
    last = seen.groupBy("url").agg(F.max_by(F.struct("done", "failures", "last"), "batch").alias("r")).select("url", "r.*")
    end = seen.agg(F.unix_millis(F.timestamp_millis(F.max("seen")) - F.expr(f"interval {late}")).alias("_now"))
    return last.crossJoin(F.broadcast(end)).select("url", _status(F.coalesce("_now", F.lit(0)), tries, wait_ms).alias("status"), "failures")
