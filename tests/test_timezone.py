"""Results do not depend on the session time zone (dates are parsed and compared in one zone)."""

import __spark_entry__ as E

NAMES = ("posted_ts", "classify_recency", "seen_scan", "export_metadata")


def _rows(spark, name):
    return sorted(tuple(r) for r in E.queries()[name](spark, "/root/testdata/sf0.001").collect())


def test_queries_independent_of_session_time_zone(spark):
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "UTC")
        utc = {n: _rows(spark, n) for n in NAMES}
        spark.conf.set(key, "America/New_York")
        ny = {n: _rows(spark, n) for n in NAMES}
    finally:
        spark.conf.set(key, before)
    assert utc == ny
