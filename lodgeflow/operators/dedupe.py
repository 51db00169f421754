"""Duplicate removal: first listing per url, then first per (title, price).

The sequential rule (a url is recorded before the title test, so url
survival does not depend on titles) is two "first row per key" steps.  Both
work on narrow columns only, and each is one aggregate: the first row of a key
carries what the next step needs, so nothing is joined back to find it.  Partial
aggregation reduces a key holding a third of all rows to one row per map task
before the shuffle.

The wide rows are read a second time and shuffled exactly once, in the final
semi join on ``seq``, which is unique and so spreads evenly whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow.functions.text import norm_lower, url_clean


def _firsts(rows: DataFrame, key_cols, order: str) -> DataFrame:
    """The row of the smallest ``order`` of each key, whole; ``order`` is unique in the input."""
    rest = [c for c in rows.columns if c not in key_cols and c != order]
    return rows.groupBy(*key_cols).agg(F.min(F.struct(order, *rest)).alias("_first")).select(*key_cols, "_first.*")


def url_survivors(narrow: DataFrame, order: str = "seq", by=()) -> DataFrame:
    """Rows kept by the url rule: blank url, or first row of its cleaned url.

    ``by`` names columns that split the input into independent runs (e.g. one
    crawl snapshot each); keys are only compared inside a run.
    """
    own = F.concat(F.lit("#"), F.col(order).cast("string"))
    keyed = narrow.withColumn("_u", F.when(F.col("url") == "", own).otherwise(F.concat(F.lit("u"), url_clean("url"))))
    return _firsts(keyed, [*by, "_u"], order).select(*narrow.columns)


def title_price_survivors(narrow: DataFrame, order: str = "seq", by=()) -> DataFrame:
    """Rows kept by the title rule: empty raw title, or first row of (stripped title, price).

    Empty-title rows are always kept but their key still counts, so a later
    whitespace-only title with the same price is dropped. Such a row stands
    twice: under its key, where it only counts, and under one of its own.
    """
    empty = F.col("title") == ""
    own = F.concat(F.lit("#"), F.col(order).cast("string"))
    keys = F.array(F.concat(F.lit("t"), norm_lower("title")), F.when(empty, own))
    keyed = narrow.withColumn("_t", F.explode(F.filter(keys, lambda k: k.isNotNull())))
    first = _firsts(keyed.withColumn("_price", F.when(~F.startswith("_t", F.lit("#")), F.col("price"))), [*by, "_t", "_price"], order)
    return first.where(~empty | F.startswith("_t", F.lit("#"))).select(*narrow.columns)


def _keep(df: DataFrame, survivors: DataFrame, order: str) -> DataFrame:
    return df.join(survivors.select(order), order, "left_semi")


def dedupe_url(df: DataFrame, order: str = "seq") -> DataFrame:
    return _keep(df, url_survivors(df.select(order, "url"), order), order)


def dedupe_title_price(df: DataFrame, order: str = "seq") -> DataFrame:
    return _keep(df, title_price_survivors(df.select(order, "title", "price"), order), order)


def dedupe(df: DataFrame, order: str = "seq", by=()) -> DataFrame:
    """Url rule, then title+price rule among url survivors (per ``by`` run if given)."""
    narrow = df.select(order, *by, "url", "title", "price")
    return _keep(df, title_price_survivors(url_survivors(narrow, order, by), order, by), order)
