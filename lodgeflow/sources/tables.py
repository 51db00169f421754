"""Readers for the input tables and the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodgeflow import schema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Crawled pages with the declared page schema (no inference)."""
    return spark.read.schema(schema.PAGE).format(fmt).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """The seen-listing store; an empty frame with the store schema when absent."""
    if path and exists(spark, path):
        return spark.read.schema(schema.SEEN).parquet(path)
    return spark.createDataFrame([], schema.SEEN)
