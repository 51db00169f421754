"""SimHash against a brute-force version."""

import re

import numpy as np
import pytest
import xxhash

from lodgeflow.llm import simhash


def brute(rows, shingle=3, max_bits=2):
    fps = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j in range(len(rows)):
                if j not in seen and (fps[x] ^ fps[j]).bit_count() <= max_bits:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in simhash.simhash_components(df).collect()), key=repr)


def test_against_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Word"), (5, "one\x0bword"), (6, "É a b"), (7, "é a b"),
            (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (None, "only here"), (9, "x " * 400000 + "y")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b c", "z", 3), (2, "a b c", "z", 4)], "doc_id long, text string, fp string, id int")
    assert [r.component_id for r in simhash.simhash_components(df).collect()] == [1, 1]
    assert [tuple(r) for r in simhash.keep_one(df).collect()] == [(1, "a b c", "z", 3)]


@pytest.mark.parametrize("size", [3, 40, 1500])
def test_list_components_agree_with_pairs(size):
    rng = np.random.default_rng(size)
    fp = np.unique(rng.integers(0, 1 << 16, size).astype(np.int64) << 8)
    link = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= 2
    label = np.arange(len(fp))
    while True:
        new = np.where(link, label[None, :], len(fp)).min(axis=1)
        if (new == label).all():
            break
        label = new
    got = dict(map(tuple, simhash._within(fp, 2)))
    assert all(got.get(f, f) == fp[label[i]] for i, f in enumerate(fp))


def test_list_over_batches():
    import pyarrow as pa
    fp = np.array([0b01, 0b11, 0b111, 1 << 40], np.int64)
    b = lambda at, key, x: pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(key, pa.int64()), pa.array(x)], ["at", "key", "fp"])
    got = [r for o in simhash._links(2)(iter([b([0, 0], [0, 0], fp[:2]), b([0, 1], [0, 0], fp[2:])])) for r in zip(*o.to_pydict().values())]
    assert got == [(3, 1), (7, 1)]
