"""Curriculum mixing: targets, taken words and positions against direct versions."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from lodgeflow.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        t = {s: cap * sizes[s] if s in full else w[s] * rest / free for s in names}
        over = {s for s in names if s not in full and t[s] > cap * sizes[s]}
        if not over:
            return t
        full |= over


def brute_taken(rows, cap=3):
    size = lambda t: len((t or "").encode().split())
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    target, at, out = brute_targets(total), {}, []
    key = lambda r: hashlib.md5((str(r[0]) if r[0] is not None else r[1] or "").encode()).hexdigest()
    for d, t, s in sorted(rows, key=lambda r: (key(r), r[0] is not None, r[0] or 0, size(r[1]))):
        n, c = size(t), at.get(s, 0)
        at[s] = c + n
        out.append((d, s, n, total[s], round(target[s], 6), n * sum(c + e * total[s] + n / 2 < target[s] for e in range(cap))))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.curriculum(df).select("doc_id", "source", "size", "source_size", F.round("target", 6), "taken")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rows = [(i, "w\x0bx " * (i * 7 % 23), ["b", "a", "é", "z", None][i % 5 if i < 60 else 0]) for i in range(300)]
    rows += [(5, "q r", "a"), (5, "q r", "a"), (None, "n n n", "b"), (None, None, None), (400, "x " * 50000, "z")]
    assert run(spark, rows) == brute_taken(rows)


def test_limits_and_reruns(spark):
    rows = [(i, "w " * 10, f"s{i % 9}" if i % 100 else "rare") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.curriculum(df)
    assert plan.where("taken > 3 * size or target > 3.000001 * source_size").count() == 0
    near = plan.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 10 for r in near)
    again = mixing.curriculum(df.repartition(7))
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, again.collect()))


def test_edge_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a"), (2, " ", None)]) == brute_targets_zero()
    df = spark.createDataFrame([(1, "a b", "s", 3.0, 4)], "doc_id long, text string, source string, target double, size int")
    got = mixing.mix(df).collect()
    assert [tuple(r)[:5] for r in got] == [(1, "a b", "s", 3.0, 4)] and all(0 <= r.mix_position < 1 for r in got)


def brute_targets_zero():
    return [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


@pytest.mark.parametrize("c", range(3))
def test_positions_invert_the_integrated_schedule(spark, c):
    points = mixing.SCHEDULES[c]

    def spent(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            x = min(max(t - t0, 0), t1 - t0)
            out += x * w0 + x * x * (w1 - w0) / (t1 - t0) / 2
        return out
    df = spark.range(101).select((F.col("id") / 100).alias("q")).withColumn("t", mixing.position(F.col("q"), F.lit(c)))
    got = [(r.q, r.t) for r in df.orderBy("q").collect()]
    assert all(math.isclose(spent(t) / spent(1.0), q, abs_tol=1e-9) for q, t in got)
    assert [t for _, t in got] == sorted(t for _, t in got)


def test_mix_is_ordered_by_position(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(200)], "doc_id long, text string, source string")
    pos = [r.mix_position for r in mixing.mix(df).collect()]
    assert pos == sorted(pos) and len(pos) == mixing.curriculum(df).agg(F.sum(F.size("positions"))).first()[0]


def test_columns_named_like_the_operators_own_come_back(spark):
    names = ["positions", "mix_position", "id", "source", "doc", "target", "taken", "size", "key", "bucket", "name"]
    df = spark.createDataFrame([(i, "w " * 5, f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    for n in names:
        if n != "source":
            df = df.withColumn(n, F.lit(f"own {n}"))
    got = mixing.mix(df)
    assert got.columns == [c for c in df.columns if c != "mix_position"] + ["mix_position"]
    rows = got.collect()
    assert rows and all(r.positions == "own positions" and r.doc == "own doc" and 0 <= r.mix_position < 1 for r in rows)


def test_rounds_go_on_until_no_source_is_above_its_cap(spark):
    sizes = spark.createDataFrame([(f"s{i:04d}", 2 ** (i // 8)) for i in range(400)], "source string, source_size long")
    rows = mixing.source_targets(sizes, cap=1.5).collect()
    total = float(sum(r.source_size for r in rows))
    assert all(r.target <= 1.5 * float(r.source_size) * (1 + 1e-12) for r in rows)
    assert math.isclose(sum(r.target for r in rows), total, rel_tol=1e-9)
