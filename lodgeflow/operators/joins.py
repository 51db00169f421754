"""Joins: new-listing anti join, source dimension, zip membership, area theta join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.text import listing_id, norm_lower, py_strip
from lodgeflow.operators.classify import effective_zip
from lodgeflow.operators.rank import global_rank
from lodgeflow.schema import normalize

# Dimension tables below this many rows and characters may be broadcast; above it the
# same join is a shuffle join.  Checked with a bounded count.
BROADCAST_ROW_LIMIT = 100_000
BROADCAST_CHARS = 8 << 20


def bounded_broadcast(dim: DataFrame, rows: int = BROADCAST_ROW_LIMIT, chars: int = BROADCAST_CHARS) -> DataFrame:
    """Broadcast a dimension only after proving its size: few rows, and few characters in its texts."""
    texts = [F.length(c) for c, kind in dim.dtypes if kind == "string"]
    width = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0))
    n, size = dim.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(dim) if n <= rows and (size or 0) <= chars else dim


def sources_dim(spark, config: P.SourceConfig | None = None) -> DataFrame:
    """The source registry as a table: key, name, priority, order, base url, enabled."""
    rows = []
    for i, (key, name, prio, base) in enumerate(P.SOURCES):
        enabled = True if config is None else config.enabled(key)
        rows.append((key, name, prio, i, base, enabled))
    return spark.createDataFrame(
        rows, "source_key string, source string, priority int, source_ord int, base_url string, enabled boolean")


def with_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach priority and registry order to each listing (8-row dimension, broadcast)."""
    dim = sources.select("source", "source_key", "priority", "source_ord", "enabled")
    return df.join(bounded_broadcast(dim), "source", "left")


def union_sources(listings: list[DataFrame], sources: DataFrame, order: str = "seq") -> DataFrame:
    """The listings of many inputs as one, in crawl order.

    Inputs may lack columns (texts become "", numbers null) and carry others, which all
    rows then have. ``seq`` counts from 1 by (priority, source order, the input's own
    ``order``, input); sources that the registry does not know come last, by name.
    Inputs are merged by name, and numbered by a distributed rank.
    """
    tagged = [df.withColumnRenamed(order, "_own").withColumn("_input", F.lit(i)) for i, df in enumerate(listings)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    late = F.lit(2 ** 31 - 1)
    ranked = with_source(rows, sources).withColumns({"_p": F.coalesce("priority", late), "_s": F.coalesce("source_ord", late)})
    keys = ["_p", "_s", "source", "_own", "_input"]
    return normalize(global_rank(ranked, keys, "seq").drop("_p", "_s", "_own", "_input"))


def select_sources(df: DataFrame, sources: DataFrame, priority: int | None = None) -> DataFrame:
    """Keep listings of enabled sources, optionally of one priority only."""
    dim = sources.where("enabled")
    if priority is not None:
        dim = dim.where(F.col("priority") == priority)
    return df.join(bounded_broadcast(dim.select("source")), "source", "left_semi")


def with_listing_id(df: DataFrame) -> DataFrame:
    return df.withColumn("listing_id", listing_id())


def new_listings(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings whose id is not in the seen store (duplicates inside a batch all survive).

    A shuffle anti join on the id: the store grows without bound, so it is
    never broadcast by assumption; AQE may still pick broadcast at run time
    when the store is actually small.
    """
    keyed = df if "listing_id" in df.columns else with_listing_id(df)
    return keyed.join(seen.select("listing_id"), "listing_id", "left_anti")


def zips_dim(spark, zips=P.PREFERRED_ZIPS) -> DataFrame:
    return spark.createDataFrame([(z,) for z in zips], "zip_code string")


def zip_semi(df: DataFrame, zips: DataFrame) -> DataFrame:
    """Listings whose effective zip is in ``zips`` (broadcast left semi join)."""
    keyed = df.withColumn("_zip", effective_zip())
    return keyed.join(bounded_broadcast(zips.select(F.col("zip_code").alias("_zip"))), "_zip", "left_semi") \
        .drop("_zip")


def areas_dim(spark, params: P.SearchParams = P.DEFAULT) -> DataFrame:
    rows = [("preferred", 0, i, a) for i, a in enumerate(params.preferred_areas)]
    rows += [("expanded", 1, i, a) for i, a in enumerate(params.expanded_areas)]
    return spark.createDataFrame(rows, "tier string, tier_ord int, ord int, name string")


def _contained(narrow: DataFrame, areas: DataFrame, sizes: list[int]) -> DataFrame:
    """(seq, _tier) for every area name contained in ``_text``.

    A text that contains a name has a window equal to the name's head, the longest
    one of a power of two letters. So windows of those few sizes and heads meet in an
    equi-join, at least half of each name is compared there, and a candidate is
    verified with its text. Names are unique, so a window that many texts hold
    meets the names of that head only.
    """
    if not sizes:
        return narrow.select("seq", F.lit(0).alias("_tier")).limit(0)
    placed = narrow.where(F.col("_text") != "").select("seq", "_text", F.explode(F.sequence(F.lit(1), F.length("_text"))).alias("_pos"))
    tails = placed.select("seq", F.substring("_text", F.col("_pos"), F.lit(sizes[-1])).alias("_tail"))
    windows = tails.select("seq", F.explode(F.array(*[F.substring("_tail", F.lit(1), F.lit(n)) for n in sizes])).alias("_head"))
    found = windows.join(areas.withColumn("_head", _head()), "_head").select("seq", "_area", "_tier").distinct()
    return found.join(narrow.select("seq", "_text"), "seq").where(F.col("_text").contains(F.col("_area"))).select("seq", "_tier")


def _head() -> Column:
    n = F.pow(F.lit(2), F.floor(F.log2(F.length("_area")))).cast("int")
    return F.substring("_area", F.lit(1), n)


def tier_join(df: DataFrame, areas: DataFrame, zips: DataFrame) -> DataFrame:
    """Location tier as a join to an area table (for area lists too long for literals).

    Matches are: city equal to the area (both tiers), a preferred zip, or the
    area name contained in the address text.  Preferred-by-text outranks
    expanded-by-city, as in the literal form.  Blank area names match nothing.
    Only narrow columns enter the joins, all of which are equi-joins whatever
    the size of the tables; a dimension of proven small size is broadcast.
    """
    text = F.lower(F.concat_ws(" ", "address", "neighborhood", "full_address"))
    narrow = df.select("seq", norm_lower("city").alias("_city"), text.alias("_text"),
                       effective_zip().alias("_zip"))
    a = (areas.where(py_strip("name") != "").select(F.col("tier_ord").alias("_tier"), F.lower("name").alias("_area"))
         .groupBy("_area").agg(F.min("_tier").alias("_tier")))
    sizes = sorted(r.n for r in a.select(F.length(_head()).alias("n")).distinct().collect())      # powers of two: a few rows
    a = bounded_broadcast(a)
    by_city = narrow.join(a, F.col("_city") == F.col("_area")).select("seq", "_tier")
    by_zip = narrow.join(bounded_broadcast(zips.select(F.col("zip_code").alias("_zip"))), "_zip", "left_semi").select("seq", F.lit(0).alias("_tier"))
    best = _contained(narrow, a, sizes).unionByName(by_city).unionByName(by_zip).groupBy("seq").agg(F.min("_tier").alias("_tier"))
    tier = F.when(F.col("_tier") == 0, P.TIER_PREFERRED).when(F.col("_tier") == 1, P.TIER_EXPANDED).otherwise(P.TIER_OTHER)
    return df.join(best, "seq", "left").withColumn("location_tier", tier).drop("_tier")
