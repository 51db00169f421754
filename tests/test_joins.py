"""Area join: one answer for any size of the area table, no join of all pairs."""

import pytest
from pyspark.sql import functions as F

from lodgeflow.operators import joins as JN


def frame(spark):
    rows = [(1, "12 Elm St", "Midland", ""), (2, "3 Mint Hill Rd", "Raleigh", ""), (3, "", "", "28227"), (4, "x", "Charlotte", ""),
            (5, "9 mooresville hwy", "Nowhere", ""), (6, "", "", ""), (7, "1 A St", "Apex", "99999"), (8, "Concordia Way", "Apex", "")]
    df = spark.createDataFrame(rows, "seq long, address string, city string, zip_code string")
    return df.withColumns({"neighborhood": F.lit(""), "full_address": F.concat_ws(", ", "address", "city")})


def tiers(spark, areas):
    zips = spark.createDataFrame([("28227",)], "zip_code string")
    return {r.seq: r.location_tier for r in JN.tier_join(frame(spark), areas, zips).collect()}


WANT = {1: "preferred", 2: "preferred", 3: "preferred", 4: "expanded", 5: "expanded", 6: "other", 7: "other", 8: "preferred"}


def test_blank_names_match_nothing_and_size_changes_nothing(spark, monkeypatch):
    areas = JN.areas_dim(spark)
    blank = spark.createDataFrame([("preferred", 0, 99, ""), ("preferred", 0, 98, "  "), ("expanded", 1, 97, None)], areas.schema)
    assert tiers(spark, areas) == WANT and tiers(spark, areas.union(blank)) == WANT
    many = areas.union(blank).union(spark.range(100_001).select(F.lit("expanded"), F.lit(1), F.lit(5), F.concat(F.lit("zz place "), F.col("id").cast("string"))))
    assert tiers(spark, many) == WANT
    monkeypatch.setattr(JN.bounded_broadcast, "__defaults__", (0, 0))
    assert tiers(spark, areas) == WANT
    assert set(tiers(spark, areas.limit(0)).values()) == {"preferred", "other"}


@pytest.mark.parametrize("limit", [(100_000, 8 << 20), (0, 0)])
def test_no_nested_loop_join(spark, monkeypatch, limit):
    monkeypatch.setattr(JN.bounded_broadcast, "__defaults__", limit)
    zips = spark.createDataFrame([("28227",)], "zip_code string")
    plan = JN.tier_join(frame(spark), JN.areas_dim(spark), zips)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dedupe_reads_its_input_twice(spark, tmp_path):
    from lodgeflow.operators.dedupe import dedupe
    rows = [(1, "u/1", "A", 5), (2, "U/1/", "B", 5), (3, "", "a ", 5), (4, "", "", 7), (5, "", " ", 7), (6, "", "", 7), (7, "", " ", 8), (8, "", "c", None),
            (9, "", "C", None)]
    spark.createDataFrame(rows, "seq long, url string, title string, price long").write.parquet(f"{tmp_path}/t")
    out = dedupe(spark.read.parquet(f"{tmp_path}/t"))
    assert sorted(r.seq for r in out.collect()) == [1, 4, 6, 7, 8]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("FileScan") <= 2 and "SortMergeJoin" not in plan.split("Aggregate")[-1]
