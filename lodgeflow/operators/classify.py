"""Classification: full address, zip backfill, location tier, recency, groups.

All narrow: area and zip lists are fixed configuration (23 names, 13 zips)
and enter the plan as literals, so classification never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.dates import hours_before, posted_ts
from lodgeflow.functions.labels import directions_url, full_address, is_subsidized
from lodgeflow.functions.text import contains_any, norm_lower, py_strip

ZIP_RE = r"\b(\d{5})(?:-\d{4})?\b"


def _zip_parts(zip_code="zip_code", full="full_address", address="address"):
    stripped = py_strip(F.col(zip_code))
    in_full = F.when(F.col(full) != "", F.regexp_extract(F.col(full), ZIP_RE, 1)).otherwise(F.lit(""))
    in_addr = F.when(F.col(address) != "", F.regexp_extract(F.col(address), ZIP_RE, 1)).otherwise(F.lit(""))
    found = F.coalesce(F.nullif(in_full, F.lit("")), F.nullif(in_addr, F.lit("")))
    return stripped, found


def effective_zip(zip_code="zip_code", full="full_address", address="address") -> Column:
    """Stripped zip, else the first 5-digit number in full address, then address."""
    stripped, found = _zip_parts(zip_code, full, address)
    return F.when(stripped != "", stripped).otherwise(F.coalesce(found, F.lit("")))


def backfilled_zip(zip_code="zip_code", full="full_address", address="address") -> Column:
    """The stored zip: unchanged unless blank and a number was found."""
    stripped, found = _zip_parts(zip_code, full, address)
    return F.when(stripped != "", F.col(zip_code)).otherwise(F.coalesce(found, F.col(zip_code)))


def _area_text() -> Column:
    return F.lower(F.concat_ws(" ", F.col("address"), F.col("neighborhood"), F.col("full_address")))


def tier_exact(params: P.SearchParams = P.DEFAULT) -> Column:
    """City is a preferred area or the zip is a preferred zip."""
    city = norm_lower("city")
    return city.isin(*[a.lower() for a in params.preferred_areas]) | \
        effective_zip().isin(*params.preferred_zips)


def tier_contains(params: P.SearchParams = P.DEFAULT) -> Column:
    """A preferred area name occurs anywhere in address, neighborhood or full address."""
    return contains_any(_area_text(), [a.lower() for a in params.preferred_areas])


def tier_expanded(params: P.SearchParams = P.DEFAULT) -> Column:
    """City equals, or the address text contains, an expanded area."""
    exp = [a.lower() for a in params.expanded_areas]
    return norm_lower("city").isin(*exp) | contains_any(_area_text(), exp)


def location_tier(params: P.SearchParams = P.DEFAULT) -> Column:
    return (F.when(tier_exact(params) | tier_contains(params), F.lit(P.TIER_PREFERRED))
            .when(tier_expanded(params), F.lit(P.TIER_EXPANDED))
            .otherwise(F.lit(P.TIER_OTHER)))


def recency(as_of: str, hours: int = 48) -> Column:
    """Posted at or after as_of minus hours; blank or unparsable dates are not recent."""
    return F.coalesce(posted_ts("date_posted") >= hours_before(as_of, hours), F.lit(False))


def with_full_address(df: DataFrame) -> DataFrame:
    df = df.withColumn("full_address", full_address())
    return df.withColumn("directions_url", directions_url("full_address"))


def classify_tier(df: DataFrame, params: P.SearchParams = P.DEFAULT) -> DataFrame:
    """Tier from the address as built, then the zip backfill (full address keeps the raw zip)."""
    df = df.withColumn("location_tier", location_tier(params))
    return df.withColumn("zip_code", backfilled_zip())


def classify(df: DataFrame, params: P.SearchParams = P.DEFAULT) -> DataFrame:
    """Full address and map link, tier, recency and the scrape stamp."""
    df = with_full_address(df)
    df = classify_tier(df, params)
    return df.withColumns({
        "is_recent": recency(params.as_of, params.recent_hours),
        "date_scraped": F.date_format(F.to_timestamp(F.lit(params.as_of)), "yyyy-MM-dd HH:mm"),
    })


def priority_group(housing_type="housing_type", tier="location_tier") -> Column:
    """1 subsidized/senior/section 8; market rows by tier: 2 preferred, 3 expanded, 4 other."""
    t = F.col(tier)
    return (F.when(is_subsidized(housing_type), F.lit(1))
            .when(t == P.TIER_PREFERRED, F.lit(2))
            .when(t == P.TIER_EXPANDED, F.lit(3))
            .otherwise(F.lit(4)))
