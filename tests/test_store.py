"""Seen store, registry, sinks and the union of sources."""

import csv
import glob
import uuid

from pyspark.sql import functions as F

from lodgeflow.operators import joins as JN
from lodgeflow.plans import publish as PB
from lodgeflow.plans.catalog import searched
from lodgeflow.operators.rank import rank_listings
from lodgeflow.schema import LISTING, SEEN
from lodgeflow.session import checkpoint_dir
from lodgeflow.sources.seen_store import SeenStore
from lodgeflow.streaming import monitor as MN

SMALL = "/root/testdata/sf0.001"


def fresh(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/').removeprefix('file:')}/tables/{name}-{uuid.uuid4().hex[:8]}"


def seen(spark, *ids):
    rows = [(i, "t", None, "", "s", None, 0) for i in ids]
    return spark.createDataFrame(rows, SEEN)


def test_runs_are_merged_by_level_and_replays_change_nothing(spark):
    store = SeenStore(spark, fresh(spark, "store"), digits=1, fanout=2)
    assert store.rows().count() == 0 and store.runs() == []
    ids = [f"{n:x}{n:03d}" for n in range(7)]
    for n, i in enumerate(ids):
        before = sorted(r.listing_id for r in store.rows(n).collect())
        assert before == sorted(ids[:n])
        store.append(seen(spark, i), n)
        if n in (1, 3, 6):                                     # the batch runs again: same history, same outcome
            assert sorted(r.listing_id for r in store.rows(n).collect()) == before
            store.append(seen(spark, i), n)
    assert sorted(r.listing_id for r in store.rows().collect()) == ids
    assert sorted(k for _, k in store.runs()) == [0, 1, 2]      # 7 batches: 1 + 2 + 4
    gone = store.tidy()
    assert gone and store.tidy() == []
    assert sorted(r.listing_id for r in store.rows().collect()) == ids
    assert sorted(r.listing_id for r in store.rows(6).collect()) == ids[:6]     # the last batch may still run again
    store.append(seen(spark).limit(0), 7)
    assert store.rows().count() == 7


def test_a_poll_reads_the_ranges_of_its_ids_only(spark):
    store = SeenStore(spark, fresh(spark, "store"), digits=2)
    store.append(seen(spark, *[f"{n:02x}{n:030d}" for n in range(256)]), 0)
    near = spark.createDataFrame([("0a" + "z" * 30,), ("ff" + "z" * 30,)], "listing_id string")
    rows = store.rows(near=near)
    assert sorted(r.listing_id[:2] for r in rows.collect()) == ["0a", "ff"]
    plan = rows._jdf.queryExecution().executedPlan()
    scan = [p for p in plan.toString().split("\n") if "FileScan" in p]
    assert scan and "id_range" in scan[0].split("PartitionFilters")[1]
    assert len(rows.inputFiles()) == 256 and store.rows(near=near.limit(0)).count() == 0


def test_the_registry_outlives_a_restart(spark):
    src, out, ckpt = (fresh(spark, n) for n in ("snapshots", "registry", "registry-ckpt"))
    url = lambda n: f"https://x/{n}"
    polls = [[(1, url(1), "A", 10, 1), (2, url(2), "B", 20, 1), (3, url(1), "A again", 11, 1)], [(4, url(2), "B later", 21, 2), (5, url(3), "C", None, 2)],
             [(6, url(1), "A late", 12, 3)]]
    for rows in polls:
        df = spark.createDataFrame([tuple({"seq": s, "url": u, "title": t, "price": p, "source": "zillow"}.get(f.name, None if f.name in ("bathrooms", "sqft") else "")
                                          for f in LISTING.fields) + (snap,) for s, u, t, p, snap in rows], MN.SNAPSHOT_SCHEMA)
        df.write.mode("append").partitionBy("snapshot").parquet(src)
        q = MN.registry(spark, src, out, ckpt)
        q.awaitTermination()
        assert q.exception() is None
    got = sorted((r.title, r.price, r.url, r.source, r.first_snapshot, r.last_snapshot, r.sightings) for r in MN.read_registry(spark, out).collect())
    assert got == [("A", 10, url(1), "zillow", 1, 3, 3), ("B", 20, url(2), "zillow", 1, 2, 2), ("C", None, url(3), "zillow", 2, 2, 1)]
    written = spark.read.parquet(out).groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in written) == [(0, 2), (1, 2), (2, 1)]     # only what a batch touched


def test_csv_files_in_order_of_their_names_are_the_ranking(spark):
    ranked = rank_listings(searched(spark, SMALL)).persist()
    path = fresh(spark, "csv")
    PB.write_csv(ranked, path)
    rows = []
    for name in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(name, newline="") as f:
            rows += [r["url"] + "|" + r["title"] for r in csv.DictReader(f)]
    want = [r.url + "|" + r.title for r in ranked.orderBy("rank").collect()]
    assert rows == want and len(rows) > 50
    assert PB.read_csv(spark, path).count() == len(want)


def test_groups_keep_their_rank_order(spark):
    ranked = rank_listings(searched(spark, SMALL))
    path = fresh(spark, "groups")
    PB.write_grouped_json(ranked, path)
    for folder in glob.glob(f"{path}/group_key=*"):
        ranks = [r.rank for name in sorted(glob.glob(f"{folder}/part-*")) for r in spark.read.json(name).select("rank").collect()]
        assert ranks == sorted(ranks) and ranks


def test_union_numbers_uneven_inputs_in_crawl_order(spark, listings):
    a = listings(dict(seq=5, title="z5", source="zillow"), dict(seq=1, title="z1", source="zillow")).drop("phone", "price")
    b = listings(dict(seq=9, title="h9", source="hud.gov")).withColumn("extra", F.lit("x"))
    c = listings(dict(seq=2, title="?2", source="unknown.org"), dict(seq=1, title="z1b", source="zillow"))
    out = JN.union_sources([a, b, c], JN.sources_dim(spark))
    rows = out.orderBy("seq").collect()
    assert [(r.seq, r.title) for r in rows] == [(1, "h9"), (2, "z1"), (3, "z1b"), (4, "z5"), (5, "?2")]
    assert [r.extra for r in rows] == ["x", None, None, None, None] and rows[1].phone == "" and rows[1].price is None
    assert JN.union_sources([a.limit(0), b.limit(0)], JN.sources_dim(spark)).count() == 0


def test_scratch_tables_can_be_cleared(spark):
    import os

    from lodgeflow import session
    old, session._SCRATCH = session._SCRATCH, []
    try:
        path = session.scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.exists(path.removeprefix("file:")) and session.clear_scratch(spark) == 1
        assert not os.path.exists(path.removeprefix("file:")) and session.clear_scratch(spark) == 0
    finally:
        session._SCRATCH = old
