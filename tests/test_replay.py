"""A retried batch rewrites only its own partition: the store is the same after a replay."""

import uuid

from pyspark.sql import functions as F

from lodgeflow.plans.publish import append_seen, seen_rows
from lodgeflow.session import checkpoint_dir
from lodgeflow.sources.tables import read_seen
from lodgeflow.streaming.monitor import read_store


def test_seen_append_is_idempotent_per_batch(spark, listings):
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/replay-{uuid.uuid4().hex[:8]}"
    assert read_seen(spark, path).count() == 0                       # absent store reads as empty
    first = listings(dict(seq=1, url="https://x/1", title="A"), dict(seq=2, url="https://x/2", title="B"))
    second = listings(dict(seq=3, url="https://x/3", title="C"))
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    append_seen(seen_rows(first.withColumn("listing_id", F.md5("url")), 0, now), path)
    append_seen(seen_rows(second.withColumn("listing_id", F.md5("url")), 1, now), path)
    before = sorted(tuple(r) for r in read_seen(spark, path).collect())
    append_seen(seen_rows(second.withColumn("listing_id", F.md5("url")), 1, now), path)   # batch 1 replayed
    after = sorted(tuple(r) for r in read_seen(spark, path).collect())
    assert before == after and len(after) == 3
    # a replay of batch 1 sees only what came before it
    assert read_store(spark, path, before_batch=1).count() == 2
