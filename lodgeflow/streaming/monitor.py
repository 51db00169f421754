"""The listing monitor as Structured Streaming.

Listing snapshots (one crawl each, tagged with ``snapshot``) arrive as files.
Each micro-batch runs filter -> dedupe -> classify per snapshot, keeps the
listings whose id is neither in the seen store nor in an earlier snapshot of
the same batch, and writes alerts and store rows into the batch's own
partition.  So the answer does not depend on how files fall into
micro-batches, and a replayed batch (same batch id after a failure) reads
the store as the batch before left it and overwrites only its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgeflow import params as P
from lodgeflow.functions.text import listing_id
from lodgeflow.operators.classify import classify, priority_group
from lodgeflow.operators.dedupe import dedupe
from lodgeflow.operators.filters import filter_listings
from lodgeflow.operators.rank import with_sort_keys
from lodgeflow.plans.publish import seen_rows
from lodgeflow.schema import LISTING, SEEN
from lodgeflow.sources.seen_store import DIGITS, SeenStore
from lodgeflow.sources.tables import exists

SNAPSHOT_SCHEMA = T.StructType(LISTING.fields + [T.StructField("snapshot", T.LongType())])


def snapshot_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_store(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], SEEN)
    seen = spark.read.schema(SEEN).parquet(path)
    return seen if before_batch is None else seen.where(F.col("batch_id") < before_batch)


def searched(batch: DataFrame, params: P.SearchParams) -> DataFrame:
    """Each snapshot's search result with listing ids."""
    result = classify(dedupe(filter_listings(batch, params), by=("snapshot",)), params)
    return with_sort_keys(result.withColumn("priority_group", priority_group())).withColumn("listing_id", listing_id())


def unseen(result: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings whose id was seen neither before nor in an earlier snapshot of the batch."""
    fresh = result.join(seen.select("listing_id"), "listing_id", "left_anti")
    first = fresh.groupBy("listing_id").agg(F.min("snapshot").alias("_first"))
    return fresh.join(first, "listing_id").where(F.col("snapshot") == F.col("_first")).drop("_first")


def monitor(spark: SparkSession, source_path: str, out_path: str, checkpoint: str,
            params: P.SearchParams = P.DEFAULT, available_now: bool = True,
            interval: str = "60 minutes", max_files: int | None = None, seed_store: str | None = None, digits: int = DIGITS):
    """Start the monitor; ``available_now`` runs what is there and stops (one cycle).

    Alerts go to ``out_path/alerts``, partitioned by batch id, and the store to
    ``out_path/seen`` (:class:`SeenStore`). A poll reads only the id ranges of the
    store that its results fall into; ``digits`` of the id make a range. ``seed_store`` optionally names an existing
    store folder (partitioned by batch) read as history before the first batch.
    """
    alerts_path, store = f"{out_path}/alerts", SeenStore(spark, f"{out_path}/seen", digits)
    as_of = F.to_timestamp(F.lit(params.as_of))

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        result = searched(batch, params).persist()      # its ranges, then its rows
        seen = store.rows(batch_id, near=result)
        if seed_store:
            seen = seen.unionByName(read_store(spark, seed_store))
        new = unseen(result, seen).withColumn("batch_id", F.lit(batch_id).cast("bigint")).persist()   # two writes read it
        (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(alerts_path))
        store.append(seen_rows(new, batch_id, as_of), batch_id)
        new.unpersist()
        result.unpersist()

    writer = (snapshot_stream(spark, source_path, max_files).writeStream
              .foreachBatch(run_batch).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Large, never-expiring key state belongs in RocksDB (off-heap, spills to local disk,
    snapshots to the checkpoint folder); only set when the deployment chose nothing."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def first_seen(spark: SparkSession, source_path: str, out_path: str, checkpoint: str):
    """Ids emitted the first time ever: one stateful dedupe over the whole stream.

    The state holds every id ever seen (the store never expires, as in the
    reference), partitioned by id across state-store partitions; each batch
    shuffles only its own rows.
    """
    use_rocksdb_state(spark)
    stream = snapshot_stream(spark, source_path).withColumn("listing_id", listing_id())
    return (stream.select("listing_id", "snapshot").dropDuplicates(["listing_id"])
            .writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


FIRST = ("title", "price", "url", "source")


def seen_registry(spark: SparkSession, store_path: str) -> DataFrame:
    """The store as one row per id: its first record, by time, then batch and content, and the number of sightings."""
    first = F.min(F.struct("first_seen", "batch_id", *FIRST))
    return (read_store(spark, store_path).groupBy("listing_id").agg(first.alias("_f"), F.count(F.lit(1)).alias("sightings"))
            .select("listing_id", *[F.col(f"_f.{c}") for c in FIRST], "_f.first_seen", "sightings"))


def registry(spark: SparkSession, source_path: str, out_path: str, checkpoint: str, available_now: bool = True,
             interval: str = "60 minutes"):
    """Keep the registry of all ids up to date: first record, first and last snapshot, sightings.

    The state holds one record an id; a batch is reduced to one row an id and task
    before its exchange, and only the ids it touches are written, in the batch's own
    partition of ``out_path``. A batch that runs again overwrites that partition.
    """
    use_rocksdb_state(spark)
    stream = snapshot_stream(spark, source_path).withColumn("listing_id", listing_id())
    state = stream.groupBy("listing_id").agg(F.min(F.struct("snapshot", "seq", *FIRST)).alias("_f"), F.max("snapshot").alias("last_snapshot"),
                                             F.count(F.lit(1)).alias("sightings"))
    rows = state.select("listing_id", *[F.col(f"_f.{c}") for c in FIRST], F.col("_f.snapshot").alias("first_snapshot"), "last_snapshot", "sightings")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

    writer = rows.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry as the last batch left it: each id's latest row."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in ("listing_id", "batch_id")]
    return rows.groupBy("listing_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("_r")).select("listing_id", "_r.*")
