"""Embedding near-dedup against brute force: recall of the index, exact counts on what it finds."""

import numpy as np
import pandas as pd
import pytest

from lodgeflow.llm import embed_dedup
from lodgeflow.llm.embed_dedup import near_vectors


def brute(rows, threshold=0.93):
    ok = [i for i, (d, v, l) in enumerate(rows)
          if d is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, near = len(rows), {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    near[a].add(b)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        comp = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] == comp))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((tuple(r) for r in near_vectors(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("block", [3, 1024])
def test_one_cell_is_exact(spark, block, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + 0.12 * rng.normal(size=8)], i % 2) for i in range(60)]
    rows += [(100 + i, rows[3][1], 1) for i in range(5)]
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [float("nan")] + [1.0] * 7, 1), (204, [float("inf")] + [1.0] * 7, 1),
             (205, [None] + [1.0] * 7, 1), (206, rows[3][1], None), (None, rows[3][1], 1), (207, [1.0] * 3, 1), (208, [2.0] * 3, 1),
             (103, rows[3][1], 1)]
    assert run(spark, rows, probes=10000, block=block) == brute(rows)
    assert run(spark, []) == []


def test_recall_on_the_table_with_near_copies(spark):
    r = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    rng = np.random.default_rng(11)
    x = embed_dedup.unit(np.array(r.embedding.tolist()))
    rows = [(int(i), [float(v) for v in e], int(label)) for i, e, label in zip(r.vec_id, r.embedding, r.label)]
    for i in range(0, 2000, 2):                        # near copies at cosines of 0.93 to 0.99
        side = rng.normal(size=64)
        side = embed_dedup.unit((side - (side @ x[i]) * x[i])[None])[0]
        cos = rng.uniform(0.93, 0.99)
        rows.append((10_000 + i, [float(v) for v in cos * x[i] + np.sqrt(1 - cos * cos) * side], rows[i][2]))
    got, want = run(spark, rows), brute_counts(rows)
    assert all(g[1] <= want[g[0]] for g in got) and sum(want.values()) >= 1900
    assert sum(g[1] for g in got) / sum(want.values()) >= 0.95


def brute_counts(rows):
    x = embed_dedup.unit(np.float32([v for _, v, _ in rows]).astype(float))
    label = np.array([r[2] for r in rows])
    n = ((x @ x.T >= 0.93) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    return {r[0]: int(k) for r, k in zip(rows, n)}


def test_pairs_count_once_over_several_cells(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 5))
    rows = [(i, [float(v) for v in np.float32(base[i % 300] + 0.05 * rng.normal(size=5))], 0) for i in range(1200)]
    got, want = run(spark, rows, probes=3), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    assert sum(g[1] for g in got) / sum(w[1] for w in want) > 0.9

def test_every_link_of_a_large_group_of_near_copies(spark):
    """80,000 rows, a third of them distinct near copies at cosines of about 0.95."""
    rng = np.random.default_rng(3)
    n, group = 80_000, 26_667
    x = rng.normal(size=(n, 64))
    x[:group] = embed_dedup.unit(rng.normal(size=(1, 64))) + rng.normal(size=(group, 64)) * np.sqrt((1 / 0.95 - 1) / 64)
    x = np.float32(embed_dedup.unit(x)[rng.permutation(n)])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": np.zeros(n, np.int32)}),
                               "vec_id long, embedding array<float>, label int")
    r = near_vectors(df).toPandas().sort_values("vec_id")
    u = embed_dedup.unit(x)
    some = rng.permutation(n)[:3000]
    dots = u[some] @ u.T
    low, high = (dots >= 0.93 + 1e-12).sum(axis=1) - 1, (dots >= 0.93 - 1e-12).sum(axis=1) - 1
    got = r.n_links.to_numpy()[some]
    assert len(r) == n and high.sum() > 1_000_000 and ((low <= got) & (got <= high)).all()


def test_cells_leave_no_link_out_and_skip_far_cells(spark):
    """Tight clusters in many cells: exact counts and components."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in np.float32(base[i % 40] + 0.2 * rng.normal(size=16))], i % 2) for i in range(900)]
    assert run(spark, rows, block=32) == brute(rows)


def test_columns_named_like_the_operators_own(spark):
    from pyspark.sql import functions as F

    from lodgeflow.llm.embed_dedup import near_vectors
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.99, 0.01]), (3, "b", [1.0, 0.0])], "vec_id long, label string, embedding array<double>")
    for c in ("id", "v", "good", "cid", "mult", "n_links", "component_id", "kept", "home", "near", "k0", "k1"):
        df = df.withColumn(c, F.lit("own"))
    assert sorted(tuple(r) for r in near_vectors(df).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
