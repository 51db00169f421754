"""Substring dedup against a brute-force version; the index against plain counting."""

import random

import numpy as np
import pytest

from lodgeflow.llm import substring
from lodgeflow.llm.substring import FMIndex, dedup_substrings


def brute(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i:i + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = {j for i in range(len(w) - window + 1) if d is not None and least[tuple(w[i:i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((d, len(w), len(gone), kept))
    return sorted(out, key=repr)


def run(spark, rows, window=13):
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, unit int, blob string")
    got = dedup_substrings(df, window=window).select("doc_id", "n_words", "n_removed", "kept_text")
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("window", [2, 6, 13])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    text = lambda n, v: " ".join(rng.choice("abcdéfghij"[:v]) for _ in range(n))
    passage = [text(40, 10) for _ in range(4)]
    rows = [(i * 3 % 97, text(rng.randint(0, 30), 10) + "\n " + rng.choice(passage)[rng.randint(0, 9):] + "\t" + text(9, 3)) for i in range(90)]
    rows += [(500, None), (501, ""), (502, " \x0b"), (None, passage[0]), (503, passage[0]), (503, passage[0]), (-4, passage[0]),
             (504, "z " * 30000), (505, "z " * 40), (506, "A" + passage[1])]
    assert run(spark, rows, window) == brute(rows, window)


def test_whole_table_and_empty_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows, 13)
    assert run(spark, []) == []


@pytest.mark.parametrize("size", [2, 3, 17, 1000])
def test_index_counts_occurrences(size):
    rng = np.random.default_rng(size)
    text = np.append(rng.integers(1, size, 700) if size > 1 else np.ones(700, np.int64), 0)
    at = np.arange(len(text) - 4)
    lo, hi = FMIndex(text, size).search(text, at, 3)
    grams = [tuple(text[i:i + 3]) for i in at]
    want = {g: sum(tuple(text[j:j + 3]) == g for j in range(len(text) - 2)) for g in set(grams)}
    assert (hi - lo).tolist() == [want[g] if want[g] > 1 else 1 for g in grams]


def test_very_frequent_anchors_are_dealt_out(monkeypatch):
    import pyarrow as pa
    from lodgeflow.llm.units import requests, squeeze, unsqueeze
    monkeypatch.setattr(substring, "HOT", 3)
    b = requests(0, 7, np.array([5, 9, 11], np.uint64), np.array([1, 2, 9], np.uint32), 1)
    said = substring._repeats(pa.Table.from_batches([b]))
    assert unsqueeze(said.column("vals")[0].as_py()).tolist() == [0, 1, 2]
    import zstandard
    words = " ".join(f"w{i}" for i in range(20)).encode()
    unit = pa.table({"unit": [7], "ids": [[1, 2]], "flags": [[False] * 2], "lens": pa.array([[len(words)] * 2], pa.list_(pa.int32())),
                     "blob": [zstandard.ZstdCompressor().compress(words * 2)]})
    n = len(np.unique(substring._windows(*substring._words(unit.to_pylist()[0], substring.Hashes()), [1, 2], 13)[2]))
    hot = pa.table({"unit": [7], "kind": [0], "bucket": [0], "vals": [squeeze(np.full(n, 2, np.uint8))]})
    out = substring._segments(13, 50)(None, unit, hot)
    assert sum(len(unsqueeze(x)) for x in out.column("docs").to_pylist()) == 16 and out.num_rows > n
    found = [substring._search(13)(out.filter(pa.compute.equal(out.column("shard"), s))) for s in set(out.column("shard").to_pylist())]
    done = substring._rewrite(13, pa.int64())(None, unit, pa.concat_tables(found))
    assert done.column("spans").to_pylist() == [[], [{"start": 0, "end": 20}]]
