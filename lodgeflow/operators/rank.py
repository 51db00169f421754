"""Ranking: the listing sort order, a distributed global rank, top-N per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.labels import is_subsidized
from lodgeflow.session import checkpoint_dir

ID_BITS = 33  # monotonically_increasing_id: partition index above bit 33


def sort_columns() -> list[Column]:
    """Subsidized first, then tier, recent first, price (null as 99999), input order."""
    tier = F.col("location_tier")
    return [
        F.when(is_subsidized(), 0).otherwise(1).alias("type_ord"),
        F.when(tier == P.TIER_PREFERRED, 0).when(tier == P.TIER_EXPANDED, 1).otherwise(2).alias("tier_ord"),
        F.when(F.col("is_recent"), 0).otherwise(1).alias("recent_ord"),
        F.coalesce(F.col("price"), F.lit(P.UNRANKED_PRICE)).alias("price_key"),
    ]


SORT_KEYS = ("type_ord", "tier_ord", "recent_ord", "price_key", "seq")


def with_sort_keys(df: DataFrame) -> DataFrame:
    if "price_key" in df.columns:
        return df
    return df.select("*", *sort_columns())


def global_rank(df: DataFrame, keys, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of each row in the total order ``keys`` (which must be unique).

    No single task sees all rows: the frame is range-partitioned on the keys
    and sorted inside partitions; each row gets (partition, offset) from
    monotonically_increasing_id; the per-partition row counts (one row per
    partition, so bounded by the partition count) are prefix-summed and
    broadcast.  The sorted frame is checkpointed to the shared checkpoint
    folder first, so ids are fixed even if executors are lost and stages rerun.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    ordered = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
               .withColumn("_rid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    pid = F.shiftright(F.col("_rid"), ID_BITS)
    counts = ordered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    offsets = offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    local = F.col("_rid").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    return (ordered.join(F.broadcast(offsets), pid == F.col("_pid"))
            .withColumn(name, F.col("_off") + local + 1)
            .drop("_rid", "_pid", "_off"))


def rank_listings(df: DataFrame, name: str = "rank") -> DataFrame:
    """Listings in ranking order with their 1-based rank."""
    return global_rank(with_sort_keys(df), SORT_KEYS, name)


def top_n(df: DataFrame, group: str = "priority_group", n: int = 30) -> DataFrame:
    """First n rows of each group in rank order, with group size and rows left out.

    ``row_number() <= n`` becomes a WindowGroupLimit that also runs before the
    shuffle, so a huge group reaches its final task as at most n rows per map
    task.  Group sizes come from a partial-aggregated count, not a window.
    """
    keyed = with_sort_keys(df)
    w = Window.partitionBy(group).orderBy(*[F.col(k) for k in SORT_KEYS])
    top = keyed.withColumn("group_pos", F.row_number().over(w)).where(F.col("group_pos") <= n) \
        .withColumn("group_pos", F.col("group_pos").cast("bigint"))
    sizes = keyed.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    # a row per group value on one side, n at most on the other
    return (top.join(sizes, group)
            .withColumn("left_out", F.greatest(F.col("group_size") - n, F.lit(0))))


def sort_by(df: DataFrame, column: str, ascending: bool = True, name: str = "pos") -> DataFrame:
    """Viewer sort: price numeric with null as 99999, text by lower-case locale order.

    Ties keep the incoming rank order (a stable sort), so the rank keys follow.
    """
    keyed = with_sort_keys(df)
    if column == "price":
        k = F.coalesce(F.col("price"), F.lit(P.UNRANKED_PRICE))
    else:
        k = F.collate(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), "UNICODE")
    keyed = keyed.withColumn("_sort", k)
    order = [F.col("_sort").asc() if ascending else F.col("_sort").desc()] + [F.col(c) for c in SORT_KEYS]
    out = global_rank(keyed, order, name)
    return out.drop("_sort")
