"""Katz scores against a direct model, and its normalisation."""

import math
import random
import zlib
from collections import Counter, defaultdict

from lodgeflow.llm import lm, units


def direct(rows):
    low = lambda s: bytes(c + 32 if 65 <= c <= 90 else c for c in (s or "").encode())
    toks = [(d, low(t).split() + ["END"]) for d, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows]
    c1, c2, ch = Counter(), Counter(), Counter()
    for (_, t), out in zip(toks, held):
        if not out:
            c1.update(t)
            c2.update(zip(["BEGIN", *t], t))
            ch.update(["BEGIN", *t[:-1]])
    n, v = sum(c1.values()), len(c1)
    hist = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = lm.discounts(hist(c1)), lm.discounts(hist(c2))
    d = lambda ds, r: ds[min(r, 6)]
    unknown = 1 - sum(d(d1, c) * c / (n + 1) for c in c1.values())
    p1 = lambda w: d(d1, c1[w]) * c1[w] / (n + 1) if c1[w] else unknown
    after = defaultdict(list)
    for h, w in c2:
        after[h].append(w)

    def prob(h, w):
        if c2[h, w]:
            return d(d2, c2[h, w]) * c2[h, w] / (ch[h] + 1)
        if not ch[h]:
            return p1(w)
        seen = sum(d(d2, c2[h, x]) * c2[h, x] / (ch[h] + 1) for x in after[h])
        return (1 - seen) / (1 - sum(p1(x) for x in after[h])) * p1(w)

    out = [(doc, o, len(t), sum(c1[w] > 0 for w in t), n, round(sum(math.log10((c1[w] + .1) / (n + .1 * (v + 1))) for w in t), 6),
            round(sum(math.log10(prob(h, w)) for h, w in zip(["BEGIN", *t], t)), 6)) for (doc, t), o in zip(toks, held)]
    return sorted(out, key=repr), prob, c1, ch


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, h string, score double")
    return sorted((tuple(r)[:5] + (round(r.base_score, 6), round(r.score, 6)) for r in lm.lm_score(df).collect()), key=repr)


def corpus():
    rng = random.Random(9)
    words = ["the", "The", "of", "É", "é", "x\x0by"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, [40, 9, 30, 4, 5, 6] + [1 + i % 7 for i in range(60)], k=rng.randint(0, 60)))) for i in range(160)]
    return rows + [(10, None), (10, "the of"), (10, "the of"), (None, "w1 q"), (9000, "never seen words"), (9001, "the " * 30000)]


def test_against_a_direct_model(spark, monkeypatch):
    rows = corpus()
    assert run(spark, rows) == direct(rows)[0]
    assert run(spark, []) == []


def test_many_units_and_buckets_give_the_same(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = direct(rows)[0]
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 5000)
    got = run(spark, rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-5) for g, w in zip(got, want) for a, b in zip(g[5:], w[5:]))


def test_direct_model_is_normalised():
    _, prob, c1, ch = direct(corpus())
    for h in [*list(ch)[:30], "never"]:
        assert math.isclose(sum(prob(h, w) for w in [*c1, "unseen"]), 1, abs_tol=1e-9)


def test_only_held_out_rows(spark):
    docs = [(d, "a b") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0][:3]
    assert [r[4] for r in run(spark, docs)] == [0, 0, 0]


def test_irregular_counts_of_counts_fall_back():
    assert all(0 < x <= 1 for h in ([0] * 6, [1, 0, 0, 0, 0, 0], [3, 9, 1, 0, 0, 4], [100, 40, 20, 12, 8, 6]) for x in lm.discounts(h))


def test_squeeze_round_trips():
    import numpy as np
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64))
    assert (units.unsqueeze_sorted(units.squeeze_sorted(a)) == a).all() and len(units.unsqueeze(units.squeeze(a[:0]))) == 0
