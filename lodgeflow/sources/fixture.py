"""Listings derived from the driver tables (orders x customer x nation).

Every listing trap lives in this one derivation: duplicate urls with case
and slash variants, blank urls, blank and whitespace-only titles, null and
zero prices, blank beds, mixed-case states, five-digit street numbers,
area-name substrings in addresses and every supported date format plus one
that must not parse.  One order is one listing; ``seq`` is the order key.
``crawled_at`` is the order date: the crawl that saw the listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow import schema
from lodgeflow.sources.tables import read_table


def _case(key: Column, pairs, default) -> Column:
    out = None
    for k, v in pairs:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def fixture_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # nation has 25 rows at every scale factor: a proven-small broadcast side.
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = (orders.join(customer, orders.o_custkey == customer.c_custkey)
         .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")))

    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("string")
    seg = F.col("c_mktsegment")
    title = (F.when(k % 41 == 0, "").when(k % 43 == 0, "  ")
             .otherwise(F.concat(F.when(k % 2 == 0, F.lower(seg)).otherwise(seg),
                                 F.lit(" Court "), (ck % 200).cast("string"))))
    price = (F.when(k % 10 == 0, F.lit(None).cast("bigint")).when(k % 17 == 0, F.lit(0).cast("bigint"))
             .otherwise((F.floor(F.col("o_totalprice") / 25000) * 100).cast("bigint")))
    bedrooms = _case(k % 6, [(0, "Studio"), (1, "1"), (2, "2"), (3, "3"), (4, "")], "0")
    bathrooms = F.when(k % 4 == 0, F.lit(None).cast("double")).otherwise(((k % 5) * 0.5).cast("double"))
    street = _case(k % 13, [(0, "Monroe Rd"), (1, "Concord Pkwy")], "Main St")
    address = F.when(k % 9 == 0, "").otherwise(
        F.concat((100 + (k * 7) % 20000).cast("string"), F.lit(" "), street))
    city = _case(k % 8, [(0, "Midland"), (1, " Charlotte"), (2, "Gastonia"), (3, "Raleigh"),
                         (4, ""), (5, "Mint Hill"), (6, "charlotte")], F.col("n_name"))
    state = _case(k % 7, [(0, "SC"), (1, "nc"), (2, "")], "NC")
    zip_code = _case(k % 5, [(0, "28227"), (1, "28202"), (2, "28025")], "")
    neighborhood = F.when(k % 19 == 0, "Matthews").when(k % 23 == 0, "NoDa").otherwise("")
    url = F.when(k % 11 == 0, "").otherwise(F.concat(
        F.lit("https://"), F.when(k % 3 == 0, "EX.org/u/").otherwise("ex.org/u/"),
        ((ck * 31 + k) % 6000).cast("string"), F.when(k % 4 == 1, "/").otherwise("")))
    source = _case(ck % 8, [(0, "nchousingsearch.org"), (1, "hud.gov"), (2, "affordablehousing.com"),
                            (3, "gosection8.com"), (4, "apartments.com"), (5, "craigslist"),
                            (6, "zillow")], "rent.com")
    housing_type = (F.when((ck % 8).isin(0, 1, 2), F.when(k % 3 == 0, "senior").otherwise("subsidized"))
                    .when(ck % 8 == 3, "section8").otherwise("market"))
    date_posted = _case(k % 8, [
        (0, ""),
        (1, F.substring(day, 1, 10)),
        (2, F.substring(day, 1, 19)),
        (3, F.concat(F.substring(day, 1, 10), F.lit("T09:30:00-05:00"))),
        (4, F.substring(day, 1, 16)),
        (5, F.concat(F.substring(day, 6, 2), F.lit("/"), F.substring(day, 9, 2), F.lit("/"),
                     F.substring(day, 1, 4))),
        (6, F.concat(F.lit("Jun "), (1 + k % 28).cast("string"), F.lit(", "), F.substring(day, 1, 4))),
    ], "3-1-2026")
    phone = F.when(k % 6 == 0, "").otherwise(
        F.concat(F.lit("(704) 555-"), F.substring((10000 + ck).cast("string"), 2, 4)))

    df = j.select(
        k.alias("seq"), title.alias("title"), price.alias("price"), bedrooms.alias("bedrooms"),
        bathrooms.alias("bathrooms"), address.alias("address"), city.alias("city"),
        state.alias("state"), zip_code.alias("zip_code"), neighborhood.alias("neighborhood"),
        url.alias("url"), source.alias("source"), housing_type.alias("housing_type"),
        date_posted.alias("date_posted"), phone.alias("phone"),
        F.col("o_orderdate").alias("crawled_at"),
    )
    return schema.normalize(df)


# The same derivation in ANSI SQL, used as the oracle's base relation.
FIXTURE_SQL = """SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 43 = 0 THEN '  '
       ELSE concat(CASE WHEN o_orderkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END,
                   ' Court ', CAST(o_custkey % 200 AS VARCHAR)) END AS title,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0
       ELSE CAST(floor(o_totalprice / 25000) * 100 AS BIGINT) END AS price,
  CASE o_orderkey % 6 WHEN 0 THEN 'Studio' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '3'
       WHEN 4 THEN '' ELSE '0' END AS bedrooms,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST((o_orderkey % 5) * 0.5 AS DOUBLE) END AS bathrooms,
  CAST(NULL AS BIGINT) AS sqft,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat(CAST(100 + (o_orderkey * 7) % 20000 AS VARCHAR), ' ',
       CASE o_orderkey % 13 WHEN 0 THEN 'Monroe Rd' WHEN 1 THEN 'Concord Pkwy' ELSE 'Main St' END) END AS address,
  CASE o_orderkey % 8 WHEN 0 THEN 'Midland' WHEN 1 THEN ' Charlotte' WHEN 2 THEN 'Gastonia' WHEN 3 THEN 'Raleigh'
       WHEN 4 THEN '' WHEN 5 THEN 'Mint Hill' WHEN 6 THEN 'charlotte' ELSE n_name END AS city,
  CASE o_orderkey % 7 WHEN 0 THEN 'SC' WHEN 1 THEN 'nc' WHEN 2 THEN '' ELSE 'NC' END AS state,
  CASE o_orderkey % 5 WHEN 0 THEN '28227' WHEN 1 THEN '28202' WHEN 2 THEN '28025' ELSE '' END AS zip_code,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Matthews' WHEN o_orderkey % 23 = 0 THEN 'NoDa' ELSE '' END AS neighborhood,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('https://', CASE WHEN o_orderkey % 3 = 0 THEN 'EX.org/u/' ELSE 'ex.org/u/' END,
       CAST((o_custkey * 31 + o_orderkey) % 6000 AS VARCHAR), CASE WHEN o_orderkey % 4 = 1 THEN '/' ELSE '' END) END AS url,
  CASE o_custkey % 8 WHEN 0 THEN 'nchousingsearch.org' WHEN 1 THEN 'hud.gov' WHEN 2 THEN 'affordablehousing.com'
       WHEN 3 THEN 'gosection8.com' WHEN 4 THEN 'apartments.com' WHEN 5 THEN 'craigslist'
       WHEN 6 THEN 'zillow' ELSE 'rent.com' END AS source,
  CASE WHEN o_orderkey % 8 = 0 THEN '' WHEN o_orderkey % 8 = 1 THEN substring(CAST(o_orderdate AS VARCHAR), 1, 10)
       WHEN o_orderkey % 8 = 2 THEN substring(CAST(o_orderdate AS VARCHAR), 1, 19)
       WHEN o_orderkey % 8 = 3 THEN concat(substring(CAST(o_orderdate AS VARCHAR), 1, 10), 'T09:30:00-05:00')
       WHEN o_orderkey % 8 = 4 THEN substring(CAST(o_orderdate AS VARCHAR), 1, 16)
       WHEN o_orderkey % 8 = 5 THEN concat(substring(CAST(o_orderdate AS VARCHAR), 6, 2), '/', substring(CAST(o_orderdate AS VARCHAR), 9, 2), '/', substring(CAST(o_orderdate AS VARCHAR), 1, 4))
       WHEN o_orderkey % 8 = 6 THEN concat('Jun ', CAST(1 + o_orderkey % 28 AS VARCHAR), ', ', substring(CAST(o_orderdate AS VARCHAR), 1, 4))
       ELSE '3-1-2026' END AS date_posted,
  CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('(704) 555-', substring(CAST(10000 + o_custkey AS VARCHAR), 2, 4)) END AS phone,
  '' AS contact_name, '' AS amenities, '' AS pet_policy,
  CASE WHEN o_custkey % 8 IN (0, 1, 2) THEN CASE WHEN o_orderkey % 3 = 0 THEN 'senior' ELSE 'subsidized' END
       WHEN o_custkey % 8 = 3 THEN 'section8' ELSE 'market' END AS housing_type,
  o_orderdate AS crawled_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
