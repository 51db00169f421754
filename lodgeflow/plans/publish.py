"""Publishing: CSV rows, grouped JSON, run metadata and the seen store.

Writers take a path and write in parallel; row order in files follows the
rank through a range-partitioned sort, never through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.labels import price_label, recent_label, tier_label, type_label
from lodgeflow.functions.text import listing_id
from lodgeflow.operators.classify import priority_group


def csv_frame(df: DataFrame) -> DataFrame:
    """The 23 export columns in order, with labels for type, tier, price and recency."""
    labelled = {
        "housing_type": type_label(), "location_tier": tier_label(),
        "is_recent": recent_label(), "price": price_label(missing=P.MISSING_PRICE_CSV),
    }
    return df.select(*[labelled.get(c, F.col(c)).alias(c) for c in P.CSV_COLUMNS])


def _ordered(df: DataFrame, *order: str) -> DataFrame:
    """Rows in order: parts by ranges, sorted inside, so the files in order of their names are the whole order."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def write_csv(df: DataFrame, path: str, order: str = "rank") -> None:
    """CSV with header; quotes doubled, spaces kept, empty fields written empty. Rows stand in
    ``order`` within a file, and the files in order of their names."""
    out = csv_frame(_ordered(df, order) if order in df.columns else df)
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_csv`, as text but for the numbers; empty texts stay empty."""
    numbers = {"bathrooms": "double", "sqft": "bigint"}
    schema = ", ".join(f"{c} {numbers.get(c, 'string')}" for c in P.CSV_COLUMNS)
    rows = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return rows.na.fill("", [c for c in P.CSV_COLUMNS if c not in numbers])


def with_group(df: DataFrame) -> DataFrame:
    """Attach the priority group number and its export key."""
    g = priority_group()
    key = F.when(g == 1, P.PRIORITY_GROUPS[0][1]).when(g == 2, P.PRIORITY_GROUPS[1][1]) \
        .when(g == 3, P.PRIORITY_GROUPS[2][1]).otherwise(P.PRIORITY_GROUPS[3][1])
    return df.withColumn("priority_group", g).withColumn("group_key", key)


def write_grouped_json(df: DataFrame, path: str, order: str = "rank") -> None:
    """One JSON-lines folder per priority group, in ``order`` within it; reading the root gives all listings."""
    out = with_group(df)
    out = _ordered(out, "group_key", order) if order in df.columns else out
    out.write.mode("overwrite").partitionBy("group_key").json(path)


def read_grouped_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """The listings of :func:`write_grouped_json` with the schema they had; ``rank`` gives their order."""
    return spark.read.schema(schema).json(path)


def run_metadata(df: DataFrame, params: P.SearchParams, resident: dict) -> DataFrame:
    """The one-row run summary: resident (name, age, monthly_income), search, total, scrape time."""
    res = resident
    scraped = params.as_of.replace(" ", "T")
    return df.agg(F.count(F.lit(1)).alias("total_results")).select(
        F.lit(res.get("name", "")).alias("resident"),
        F.lit(res.get("age", "")).cast("bigint").alias("resident_age"),
        F.lit(res.get("monthly_income", "")).cast("bigint").alias("monthly_income"),
        F.lit(params.state).alias("search_state"),
        F.lit(f"${params.min_rent}-${params.max_rent}").alias("rent_range"),
        F.lit(", ".join(str(b) for b in params.bedrooms)).alias("bedrooms"),
        "total_results",
        F.lit(scraped).alias("scraped_at"))


def seen_rows(new: DataFrame, batch_id: int, first_seen) -> DataFrame:
    """Store rows for newly alerted listings."""
    lid = F.col("listing_id") if "listing_id" in new.columns else listing_id()
    return new.select(lid.alias("listing_id"), "title", "price", "url", "source",
                      first_seen.cast("timestamp").alias("first_seen"),
                      F.lit(batch_id).cast("bigint").alias("batch_id"))


def append_seen(rows: DataFrame, path: str) -> None:
    """Write store rows into their batch partition; a retried batch overwrites only itself."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))
