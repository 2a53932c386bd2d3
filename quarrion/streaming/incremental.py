"""Incremental merges and their streaming forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrion.storage import conf

#: State of streams: on the executors' disks, with changes in the checkpoint, and bounded memory over all stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_KIND = "__kind"

def new_rows(found: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of found whose keys known doesn't have, each key once. Null keys compare equal."""
    own = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    seen = known.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    return found.dropDuplicates(list(keys)).join(seen, own, "left_anti")


def appended(base: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the rows of found that are new by their keys."""
    return base.unionByName(new_rows(found, base, keys), allowMissingColumns=True)


def upserted(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row by order of each key; between base and changes, the change wins a tie.

    One partial aggregation over the union instead of a full outer join, so a key with many changes is reduced first.
    """
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rest = [c for c in base.columns if c not in keys and c != order]
    last = both.groupBy(*keys).agg(F.max(F.struct(order, "_new", *rest)).alias("_row"))
    return last.select(*keys, f"_row.{order}", *(f"_row.{c}" for c in rest)).select(*base.columns)


def counted(base: DataFrame, mentions: DataFrame, key: str = "name", count: str = "mention_count", seen: str = "first_seen") -> DataFrame:
    """Counters with the mentions added; new names start with their first mention."""
    added = mentions.groupBy(key).agg(F.count("*").alias(count), F.min(seen).alias(seen))
    return base.select(key, count, seen).unionByName(added.select(key, count, seen)).groupBy(key).agg(F.sum(count).alias(count), F.min(seen).alias(seen))


def queued(queue: DataFrame, urls: DataFrame) -> DataFrame:
    """A work queue (url, status) with the urls it doesn't have yet as pending; what is done stays done."""
    return appended(queue.select("url", "status"), urls.select("url", F.lit("pending").alias("status")), ["url"])


def finished(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue with the urls of done marked so."""
    ended = done.select(F.col("url").alias("_url")).distinct()
    rows = queue.join(ended, F.col("url") == F.col("_url"), "left")
    return rows.select("url", F.when(F.col("_url").isNotNull(), "done").otherwise(F.col("status")).alias("status"))


def split_failed(rows: DataFrame, ok: str) -> tuple[DataFrame, DataFrame]:
    """Rows to go on with, and the dead letters."""
    good = F.coalesce(F.expr(ok), F.lit(False))
    return rows.filter(good), rows.filter(~good)


def ingest(spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str, keys: Sequence[str], ok: str = "true", files_per_batch: int | None = None, pattern: str = "*") -> None:
    """Takes the new files of a folder into target, rows new by their keys only; rows that fail ok go to target_failed.

    The keys that were taken are the state of the stream, on the executors' disks and in the checkpoint, so a batch costs what
    it holds: the target is never read. Null keys compare equal. A batch is written under its own number, so one that is
    repeated after a failure replaces itself. log has a line per batch.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source)
    names = rows.columns
    good, failed = split_failed(rows, ok)
    counted_only = rows.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema), F.when(F.coalesce(F.expr(ok), F.lit(False)), "good").otherwise("bad").alias(_KIND))
    both = good.dropDuplicates(list(keys)).withColumn(_KIND, F.lit("new")).unionByName(failed.withColumn(_KIND, F.lit("failed"))).unionByName(counted_only)

    def take(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.filter(F.col(_KIND) == "new").select(names).write.mode("overwrite").parquet(f"{target}/batch={number}")
        held.filter(F.col(_KIND) == "failed").select(names).write.mode("overwrite").parquet(f"{target}_failed/batch={number}")
        log = held.agg(F.lit(number).alias("batch"), F.count_if(F.col(_KIND).isin("good", "bad")).alias("rows"), F.count_if(F.col(_KIND) == "good").alias("good"), F.count_if(F.col(_KIND) == "new").alias("new"))
        log.write.mode("overwrite").json(f"{target}_log/batch={number}")
        held.unpersist()

    with conf(spark, STATE):
        query = both.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
        query.awaitTermination()


def windowed_counts(events: DataFrame, ts: str = "ts", keys: Sequence[str] = ("event_type",), every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key and tumbling window; on a stream, late rows are taken for so long. The batch form gives the same."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def streamed(spark: SparkSession, folder: str, pattern: str, schema, transform, out: str, checkpoint: str) -> DataFrame:
    """Runs transform over a folder's files as a stream until all are taken, and reads what it gave."""
    rows = transform(spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/batch=*")
