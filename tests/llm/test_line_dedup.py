"""Line dedup against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from lodgeflow.llm.line_dedup import LineIndex, dedup_lines

SPACES = " \t\n\x0b\f\r"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars, min_docs):
    order = lambda d: (d is not None, d or 0)
    held = {}
    for i, (doc, text) in enumerate(rows):
        for k in {low(x).strip(SPACES) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := held.get(low(x).strip(SPACES), [])) >= min_docs and doc != max(h, key=order))]
        out.append((doc, text if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in dedup_lines(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 3)])
def test_against_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    pool = ["", "aaaa", "AAAA ", "\tbbbbb", "ÉÉÉÉ", "éééé", "cc", "ddddd\r", "eeee e"]
    rows = [(i * 7, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(None, "aaaa\nzz"), (None, None), (3, None), (4, ""), (273, "aaaa\nbbbbb"), (273, "aaaa\nbbbbb"), (273, "AAAA")]
    assert run(spark, rows, min_chars=4, min_docs=3, batches=batches, fanout=fanout) == brute(rows, 4, 3)


def test_empty_table_long_text_and_extra_columns(spark):
    assert run(spark, []) == []
    line = "x" * 60
    df = spark.createDataFrame([(i, line + "\n" + "y\n" * (20000 * (i == 2)), "a", -1) for i in range(5)],
                               "doc_id long, text string, h1 string, n_lines int")
    got = sorted(tuple(r) for r in dedup_lines(df).select("doc_id", "h1", "n_lines", "n_dropped", F.length("text")).collect())
    assert got == [(0, "a", 2, 1, 0), (1, "a", 2, 1, 0), (2, "a", 20002, 1, 40000), (3, "a", 2, 1, 0), (4, "a", 2, 0, 61)]


def test_runs_are_compacted(spark):
    index = LineIndex(2)
    for i in range(4):
        index.add(spark.createDataFrame([(i, 0)], "h1 long, h2 int"))
    assert [len(x) for x in index.levels] == [0, 0, 1]
    got = index.split(spark.createDataFrame([(2, 0), (9, 0)], "h1 long, h2 int"))
    assert sorted((r.h1, r.fresh) for r in got.collect()) == [(2, False), (9, True)]


def test_ids_of_other_types(spark):
    line = "z" * 50
    rows = [(f"d{i}", line + f"\n{i}") for i in range(6)] + [(None, line)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(df).collect()}
    assert got == {**{f"d{i}": (str(i), 1) for i in range(5)}, "d5": (line + "\n5", 0), None: ("", 1)}
