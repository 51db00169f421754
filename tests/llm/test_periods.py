"""Periodic runs against brute force: random words of few kinds, planted powers, edge rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodgeflow.llm import periods
from lodgeflow.llm.queries import op13_periodic_runs


def brute(w, power=3, least=24):
    """All maximal stretches of every period, each with its smallest."""
    found = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(w):
    return [tuple(r) for r in periods.find_runs(np.array(w, np.int64)).tolist()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 30)), max_size=8))
def test_planted_powers(parts):
    w = []
    for word, times, more in parts:
        long = word * (times + 1)
        w += long[:len(word) * times + min(more, len(word))]
    assert runs_of(w) == brute(w)


def test_random_words_of_few_kinds():
    rng = random.Random(1)
    for n in [0, 1, 23, 24, 25, 64, 200, 700]:
        for kinds in (1, 2, 3):
            for _ in range(6):
                w = [rng.randrange(kinds) for _ in range(n)]
                assert runs_of(w) == brute(w)
    fib = [0], [0, 1]
    while len(fib[1]) < 600:
        fib = fib[1], fib[1] + fib[0]
    assert runs_of(fib[1]) == brute(fib[1])
    w = ([0] * 40 + [1]) * 12 + [2] * 100 + ([0, 1] * 30 + [3]) * 5
    assert runs_of(w) == brute(w)


def test_long_texts_stay_linear():
    w = [0] * 300_000
    assert runs_of(w) == [(0, 300_000, 1)]
    piece = list(range(50_000))
    assert runs_of(piece * 4 + piece[:7]) == [(0, 200_007, 50_000)]
    assert runs_of(([0] * 100 + [1]) * 2000)[-1] == (201_899, 101, 101) or (0, 202_000, 101) in runs_of(([0] * 100 + [1]) * 2000)


def test_range_successor():
    rng = np.random.default_rng(2)
    v = rng.permutation(500)
    tree = periods.RangeSuccessor(v)
    lo = rng.integers(0, 500, 300)
    hi = np.minimum(lo + rng.integers(1, 90, 300), 500)
    x = rng.integers(0, 600, 300)
    got = tree.below(lo, hi, x)
    assert got.tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
    on = got < hi - lo
    assert tree.nth(lo[on], hi[on], got[on]).tolist() == [int(min(y for y in v[a:b] if y >= c)) for a, b, c in zip(lo[on], hi[on], x[on])]


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_documents_and_edges(spark, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a " * 100_000, "one", " ".join(["x", "y", "z"] * 9) + "\n\x0b tail", "é\x85\xa0 " * 30]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) + " " + " ".join((["p", "q", rng.choice("abp")] * 20)[:rng.randrange(60)]) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "runs", "best", "n_words"):
        df = df.withColumn(c, df["text"])
    got = periods.periodic_runs(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 5 for r in got) == 2
    import re
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id if r.doc_id is not None else 5] or "")
        if r.doc_id == 3:
            assert [tuple(x) for x in r.runs] == [(0, 100_000, 1)] and r.collapsed_text == "a"
            continue
        want = brute(w)
        assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want and r.collapsed_text == collapsed(w, want)
        assert (r.best is None) == (not want)
        if want:
            assert tuple(r.best) == min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
    assert periods.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periods.periodic_runs(df, power=2)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(400)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "a b c " * 20), (-3, "v w " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for i, t in rows:
        w = (t or "").split()
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        runs, r = brute(w), got[i]
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None, None, None)
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert planted > 5
