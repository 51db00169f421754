"""Aggregations: per-source and per-group counts, run totals, facet statistics.

Every aggregate here is a hash aggregate with map-side partial aggregation:
a source or group holding a third of all rows costs one partial row per map
task, never one oversized task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.labels import is_subsidized
from lodgeflow.operators.classify import priority_group


def count_by_source(df: DataFrame) -> DataFrame:
    """Listings per source name; a blank source counts as 'unknown'."""
    src = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    return df.groupBy(src.alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def groups_dim(spark) -> DataFrame:
    """The four priority groups (fixed dimension)."""
    return spark.createDataFrame([(g, key, label) for g, key, label in P.PRIORITY_GROUPS],
                                 "priority_group int, group_key string, group_label string")


def count_by_group(df: DataFrame) -> DataFrame:
    """Size of each priority group, empty groups shown as 0."""
    counts = df.groupBy(priority_group().alias("priority_group")).agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(groups_dim(df.sparkSession)).join(counts, "priority_group", "left")
            .select("priority_group", "group_key", "group_label", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("priority_group"))


def run_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(is_subsidized()).alias("subsidized"),
                  F.count_if(F.col("is_recent")).alias("recent"))


def facet_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Viewer header: total, priced, subsidized, sources (blank counts), cities (blank not)."""
    city = F.nullif(F.col("city"), F.lit(""))
    if approx:
        n_src, n_city = F.approx_count_distinct("source"), F.approx_count_distinct(city)
    else:
        n_src, n_city = F.count_distinct(F.col("source")), F.count_distinct(city)
    return df.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("price").isNotNull()).alias("priced"),
                  F.count_if(is_subsidized()).alias("subsidized"),
                  n_src.alias("sources"), n_city.alias("cities"))


def facet_values(df: DataFrame, columns=("source", "city")) -> DataFrame:
    """Sorted distinct non-empty values of each facet column, as (facet, value)."""
    out = None
    for c in columns:
        part = (df.where(F.col(c) != "").select(F.lit(c).alias("facet"), F.col(c).alias("value")).distinct())
        out = part if out is None else out.unionByName(part)
    return out.orderBy("facet", "value")


def last_check(seen: DataFrame) -> DataFrame:
    """When something new was last recorded: the latest first_seen."""
    return seen.agg(F.max("first_seen").alias("last_check"))


def group_arrays(df: DataFrame, chunk: int = 500) -> DataFrame:
    """Listings of each priority group as rank-ordered arrays of at most ``chunk`` entries.

    One array per group would put a whole group (possibly a third of all
    rows) into one task; chunks keep every array and task bounded.  Positions
    come from the distributed global rank, shifted by each group's first rank.
    """
    from lodgeflow.operators.rank import SORT_KEYS, global_rank, with_sort_keys
    keyed = with_sort_keys(df if "priority_group" in df.columns else df.withColumn("priority_group",
                                                                                   priority_group()))
    ranked = global_rank(keyed.select("priority_group", *SORT_KEYS, "title"), ["priority_group", *SORT_KEYS], "_r")
    starts = ranked.groupBy("priority_group").agg(F.min("_r").alias("_start"))
    pos = ranked.join(F.broadcast(starts), "priority_group") \
        .withColumn("group_pos", F.col("_r") - F.col("_start") + 1)
    chunk_no = F.floor((F.col("group_pos") - 1) / chunk).cast("bigint")
    grouped = pos.groupBy("priority_group", chunk_no.alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("group_pos", "seq", "title"))).alias("_rows"))
    return grouped.select("priority_group", "chunk_no", "n",
                          F.transform("_rows", lambda r: r["seq"]).alias("seqs"),
                          F.transform("_rows", lambda r: r["title"]).alias("titles"))
