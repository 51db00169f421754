"""Search filters: rent, bedrooms, state, listing age, free text and facets.

All of them are a single ``where`` on raw listing columns, so Catalyst can
push them towards the scan and no filter needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.dates import days_before, posted_ts
from lodgeflow.functions.labels import is_subsidized
from lodgeflow.functions.text import norm_lower


def rent_predicate(min_rent: int, max_rent: int | None) -> Column:
    """Market rows must lie in [min, max]; subsidized rows only under 1.5 x max.
    Without a maximum there is no upper test."""
    p = F.col("price")
    if max_rent is None:
        return p.isNull() | is_subsidized() | (p >= min_rent)
    return p.isNull() | F.when(is_subsidized(), p <= F.lit(float(max_rent) * P.SUBSIDIZED_PRICE_FACTOR)) \
        .otherwise(p.between(min_rent, max_rent))


def bedroom_predicate(labels) -> Column:
    """Blank bedrooms always pass; no labels means no filter."""
    if not labels:
        return F.lit(True)
    b = norm_lower("bedrooms")
    return (b == "") | b.isin(*labels)


def state_predicate(state: str, restrict: bool) -> Column:
    """Case-insensitive state match, only when both sides are non-empty."""
    if not (restrict and state):
        return F.lit(True)
    return (F.col("state") == "") | (F.upper(F.col("state")) == state.upper())


def rent_filter(df: DataFrame, min_rent: int = 0, max_rent: int | None = None) -> DataFrame:
    return df.where(rent_predicate(min_rent, max_rent))


def bedroom_filter(df: DataFrame, labels) -> DataFrame:
    return df.where(bedroom_predicate(labels))


def state_filter(df: DataFrame, state: str, restrict: bool) -> DataFrame:
    return df.where(state_predicate(state, restrict))


def filter_listings(df: DataFrame, params: P.SearchParams) -> DataFrame:
    """Rent, bedroom and state filters as one predicate."""
    return df.where(rent_predicate(params.min_rent, params.max_rent)
                    & bedroom_predicate(params.bedroom_labels())
                    & state_predicate(params.state, params.restrict_to_state))


def age_filter(df: DataFrame, as_of: str, subsidized_days: int = 90, market_days: int = 7) -> DataFrame:
    """Opt-in listing-age window; undated or unparsable rows are kept."""
    ts = posted_ts("date_posted")
    limit = F.when(is_subsidized(), days_before(as_of, subsidized_days)).otherwise(days_before(as_of, market_days))
    return df.where(ts.isNull() | (ts >= limit))


SEARCH_COLUMNS = ("title", "address", "city", "full_address", "neighborhood")


def search_text(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over the address-like columns."""
    if not query:
        return df
    q = query.lower()
    cond = F.lit(False)
    for c in SEARCH_COLUMNS:
        cond = cond | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    return df.where(cond)


def facet_filter(df: DataFrame, source: str = "", housing_type: str = "", city: str = "",
                 bedrooms: str = "", max_price: int | None = None) -> DataFrame:
    """Exact facet filters; 'Studio' also matches '0'; null price passes a price cap."""
    cond = F.lit(True)
    if source:
        cond = cond & (F.col("source") == source)
    if housing_type:
        cond = cond & (F.col("housing_type") == housing_type)
    if city:
        cond = cond & (F.col("city") == city)
    if bedrooms:
        b = F.lower(F.col("bedrooms"))
        cond = cond & (b.isin("studio", "0") if bedrooms == "Studio" else (b == bedrooms))
    if max_price:
        cond = cond & (F.col("price").isNull() | (F.col("price") <= max_price))
    return df.where(cond)
