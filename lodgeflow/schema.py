"""Schemas of listings, pages and the seen store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, B, TS, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(), T.IntegerType()

# Raw listing fields in the order of the record type; missing strings are "".
LISTING = T.StructType([
    T.StructField("seq", L, False),
    T.StructField("title", S), T.StructField("price", L), T.StructField("bedrooms", S),
    T.StructField("bathrooms", D), T.StructField("sqft", L),
    T.StructField("address", S), T.StructField("city", S), T.StructField("state", S),
    T.StructField("zip_code", S), T.StructField("neighborhood", S),
    T.StructField("url", S), T.StructField("source", S), T.StructField("date_posted", S),
    T.StructField("phone", S), T.StructField("contact_name", S),
    T.StructField("amenities", S), T.StructField("pet_policy", S),
    T.StructField("housing_type", S),
])

STRING_FIELDS = tuple(f.name for f in LISTING.fields if isinstance(f.dataType, T.StringType))

PAGE = T.StructType([
    T.StructField("source", S), T.StructField("search_city", S),
    T.StructField("city_ord", I), T.StructField("page_no", I),
    T.StructField("url", S), T.StructField("html", S),
    T.StructField("fetched_at", TS), T.StructField("error", S),
    # search (also null), locator or senior; a locator's or senior page's number differs from those of the search it stands beside
    T.StructField("kind", S),
])

SEEN = T.StructType([
    T.StructField("listing_id", S), T.StructField("title", S), T.StructField("price", L),
    T.StructField("url", S), T.StructField("source", S),
    T.StructField("first_seen", TS), T.StructField("batch_id", L),
])


def normalize(df: DataFrame) -> DataFrame:
    """Bring any listing frame to LISTING: typed columns, "" for missing strings.

    Extra columns (e.g. snapshot keys) are kept after the listing columns.
    """
    cols = []
    for f in LISTING.fields:
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            if isinstance(f.dataType, T.StringType):
                c = F.coalesce(c, F.lit(""))
            cols.append(c.alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.lit("market" if f.name == "housing_type" else "").alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [c for c in df.columns if c not in LISTING.fieldNames()]
    return df.select(*cols, *extra)
