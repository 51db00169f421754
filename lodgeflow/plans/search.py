"""The batch search: listings -> filter -> dedupe -> classify -> rank.

Order matters and follows the reference dataflow: filters run before
dedupe (a filtered-out row cannot shadow a later duplicate), classification
after dedupe.  Shuffles: two narrow aggregations and one wide semi join in
dedupe; a range exchange for the rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodgeflow import params as P
from lodgeflow.operators.classify import classify, priority_group
from lodgeflow.operators.dedupe import dedupe
from lodgeflow.operators.filters import filter_listings
from lodgeflow.operators.rank import rank_listings, with_sort_keys


def prepare(df: DataFrame, params: P.SearchParams = P.DEFAULT) -> DataFrame:
    """Filter, dedupe, classify, add priority group and sort keys (no global rank)."""
    out = classify(dedupe(filter_listings(df, params)), params)
    out = out.withColumn("priority_group", priority_group())
    return with_sort_keys(out)


def search(df: DataFrame, params: P.SearchParams = P.DEFAULT) -> DataFrame:
    """The full search with a 1-based ``rank`` column."""
    return rank_listings(classify(dedupe(filter_listings(df, params)), params)
                         .withColumn("priority_group", priority_group()))
