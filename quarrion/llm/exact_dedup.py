"""Exact deduplication with stateful streaming.

Rows are landed in a table with the digest of their normalised text and a locator: the number of the task that wrote the
row and the row's position in its file. A stream over the digests of that table, in bounded batches, keeps one entry per
digest in a disk-backed (RocksDB) state store that never expires: the digest, the stable identifier and the locator of
the row that stays, and the count. The full normalised texts of all rows that hit an entry are fetched by their
locators and compared byte by byte: equal texts of a digest are one group, summed before the shuffle, so that a common
text costs one row per task. Where a digest has several texts, its rows are grouped by the text.

Defined results: a null text counts as empty, so null and empty rows are one group; a null id is the smallest id.
If rows repeat with the same id and the same text, one of them stays. An empty table gives an empty result. The id may
be of any type that has an order. Only the id and text columns are looked at, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.llm.shared import ascii_lower, conf, doc_text, shared_folder, written

#: The state lives on the executors' disks; memory over all stores of an executor is bounded.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


#: Batches of the stream over a landed table.
BATCHES = 4


def _landed(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per input row, with the whole of it. The locator is fixed once the table is written."""
    sha = F.unhex(F.sha2(ascii_lower(doc_text(text_col)), 256))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), sha.alias("sha"))
    return written(rows.withColumn("digest", digest(F.col("sha"))).withColumn("loc", F.monotonically_increasing_id()))


def _state(landed: DataFrame, files_per_batch: int | None) -> DataFrame:
    """Streams the landed digests through the keyed state and returns the last entry of each."""
    spark = landed.sparkSession
    out, checkpoint = shared_folder(spark), shared_folder(spark)
    files = landed.inputFiles()
    keys = landed.select("doc_id", "digest", "loc")
    entry = (F.max(F.struct("doc_id", "loc")).alias("top"), F.count("*").alias("n"))
    if not files:
        return keys.groupBy("digest").agg(*entry)
    reader = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files_per_batch or -(-len(files) // BATCHES))
    entries = reader.parquet(files[0].rsplit("/", 1)[0]).groupBy("digest").agg(*entry)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with conf(spark, STATE_CONF):
        stream = entries.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
        stream.awaitTermination()
    # An entry only grows, so its last version is the largest one.
    seen = spark.read.schema(entries.schema).parquet(f"{out}/batch=*")
    return seen.groupBy("digest").agg(F.max("top").alias("top"), F.max("n").alias("n"))


def _grouped(landed: DataFrame, text_col: str, files_per_batch: int | None) -> DataFrame:
    """Per landed row: doc_id, sha, loc, and top and n of its group."""
    state = written(_state(landed, files_per_batch))
    keys = landed.select("doc_id", "sha", "digest", "loc")
    # Joins that fetch texts are sort-merge joins at any size: what they move follows the input, with no turn from broadcasts.
    hits = keys.join(state.filter("n > 1").select("digest"), "digest", "left_semi").select("loc").hint("merge")
    texts = landed.select("digest", "loc", "doc_id", "sha", ascii_lower(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))).alias("norm")).join(hits, "loc", "left_semi")
    alike = texts.groupBy("digest", "norm").agg(F.count("*").alias("n"))
    several = written(alike.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"))
    if not several.limit(1).count():
        return keys.join(state, "digest").select("doc_id", "sha", "loc", "top", "n")
    mixed = texts.join(several, "digest")
    own = mixed.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "loc")).alias("top"), F.count("*").alias("n"))
    rest = keys.join(several, "digest", "left_anti").join(state, "digest")
    return rest.select("doc_id", "sha", "loc", "top", "n").unionByName(mixed.join(own, ["digest", "norm"]).select("doc_id", "sha", "loc", "top", "n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda sha: sha, files_per_batch: int | None = None) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    digest maps the SHA-256 of the normalised text to the state's key; a weaker one stays exact, as full texts decide.
    """
    groups = _grouped(_landed(docs, id_col, text_col, digest), text_col, files_per_batch)
    return groups.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("loc") == F.col("top.loc")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = lambda sha: sha, files_per_batch: int | None = None) -> DataFrame:
    """docs without the rows that exact_groups drops, columns unchanged."""
    landed = _landed(docs, id_col, text_col, digest)
    stay = _grouped(landed, text_col, files_per_batch).filter(F.col("loc") == F.col("top.loc")).select("loc")
    return landed.select("row", "loc").join(written(stay).hint("merge"), "loc", "left_semi").select("row.*")
