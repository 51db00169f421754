"""Decontamination against a brute-force version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodgeflow.llm import decontam


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def ws(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def brute(docs, items, window=13, share=20):
    grams = []
    for item, text in items:
        w = ws(text)
        n = min(len(w), window)
        grams += [(item, w[i:i + n]) for i in range(len(w) - n + 1)] if w else []
    out = []
    for doc, text in docs:
        w = ws(text)
        hit, ids = set(), set()
        for item, g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    ids |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), len(ids), sorted(ids), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontam.decontaminate(d, i, **kw).collect()), key=repr)


@pytest.mark.parametrize("block", [3, 1000])
def test_against_brute_force(spark, block):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "c-d", "E"]) for _ in range(n))
    items = [(i, text(rng.randint(1, 9))) for i in range(8)] + [(10, "?!"), (11, None), (None, "a b"), (2, "a"), (12, "zzz")]
    docs = [(i, text(rng.randint(0, 30))) for i in range(30)] + [(1, "a b"), (1, "a b"), (1, "a"), (None, "a E b"), (None, None), (40, "")]
    docs.append((41, "q " * 30000 + "a b c"))
    assert run(spark, docs, items, window=4, block=block) == brute(docs, items, 4)


def test_empty_tables_and_extra_columns(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, 0, [], False)]
    d = spark.createDataFrame([(1, "x y", "k", 1), (2, "y z", "k", 2), (None, "x y", "k", 3)], "doc_id long, text string, word string, pos int")
    i = spark.createDataFrame([(7, "X  Y", "k")], "item_id long, text string, gram string")
    assert sorted(r.pos for r in decontam.drop_contaminated(d, i).collect()) == [2, 3]


def test_a_window_that_many_items_share(spark):
    from lodgeflow.llm.decontam import decontaminate
    shared = " ".join(f"p{i}" for i in range(13))
    items = spark.createDataFrame([(i, shared + f" own{i}") for i in range(3000)] + [(None, shared)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + shared + " b"), (2, shared[3:]), (None, shared + " own7"), (3, None)], "doc_id long, text string") \
        .withColumn("win", F.lit("w")).withColumn("wins", F.lit(1)).withColumn("hit_id", F.lit(2))
    got = {r.doc_id: r for r in decontaminate(docs, items).collect()}
    assert got[1].n_items == 3000 and got[1].item_ids == sorted(map(str, range(3000))) and got[1].n_hit == 13 and got[1].contaminated
    assert got[2].n_hit == 0 and got[2].item_ids == [] and got[None].n_hit == 14 and got[None].n_items == 3000 and got[3].n_words == 0
