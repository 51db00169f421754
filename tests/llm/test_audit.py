"""Source divergence audit against a direct count, and edge rows."""

import random
import re
from collections import Counter, defaultdict

from lodgeflow.llm import audit

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, smooth=2, scale=10 ** 9, top=10):
    groups, seen, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOW))
        groups[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = sorted(s for x, s in groups if x == lang)
        whole = sum((groups[lang, s] for s in sources), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + smooth) // (size + smooth * len(kept)) for t in kept}

        p, q = {s: shares(groups[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if groups[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def test_equals_direct_counts(spark):
    rng = random.Random(5)
    words = ["Ab", "aB", "c", "é", "É", "x_y", "naïve", "z9z", " ", "中文", "ß", "q" * 50]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "S3", None]),
             rng.choice([" ", "\n", "-", "7"]).join(rng.choices(words, [9, 5, 4, 3, 3, 2, 2, 1, 1, 1, 1, 1], k=rng.randrange(30)))) for _ in range(300)]
    rows += rows[:40] + [("en", "s1", None), ("de", "alone", "x"), ("it", "a", None), ("it", "b", "")]
    for least in (1, 10, 1000):
        assert rows_of(audit.divergence(table(spark, rows), min_docs=least)) == brute(rows, least)


def test_blocks_flushes_and_matrix_steps_change_nothing(spark, monkeypatch):
    text = ("Alpha BETA, gamma" + "w" * 5000 + " é") * 60
    whole = audit.term_counts(text.encode())
    for size in (1, 7, 4096):
        monkeypatch.setattr(audit, "_BLOCK", size)
        assert audit.term_counts(text.encode()) == whole
    assert whole == Counter(x.encode() for x in TERM.findall(text.translate(LOW)))


def test_flush_keeps_sums(monkeypatch):
    import pyarrow as pa
    rows = [("en", "s", f"a b c{i % 7}") for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["lang", "source", "text"])

    def total():
        n, docs = Counter(), Counter()
        for b in audit._tally(iter([batch])):
            for t, x, d in zip(*(b.column(c).to_pylist() for c in ("term", "n", "docs"))):
                n[t] += x
                docs[t] += d
        return n, docs

    once = total()
    monkeypatch.setattr(audit, "_FLUSH", 3)
    assert total() == once and once[0][b"a"] == 100
    monkeypatch.setattr(audit, "_CELLS", 1)
    cells = pa.table({"term": pa.array([b"x", b"y", b"x"]), "source": ["a", "b", "b"], "p": pa.array([10, 30, 50], pa.int64())})
    groups = pa.table({"lang": ["l", "l"], "source": ["b", "a"], "zero": pa.array([3, 2], pa.int64())})
    assert audit._pair_sums(cells, groups).to_pylist() == [{"lang": "l", "source": "a", "item": "b", "value": 40 * 40 // 60 + 28 * 28 // 32}]


def test_edge_tables(spark):
    empty = table(spark, [])
    assert rows_of(audit.divergence(empty)) == []
    odd = table(spark, [(None, None, None), ("", "", "a"), ("", "b", "long " * 300_000)])
    for c in ("term", "n", "docs", "total", "first", "size", "kinds", "bucket", "value", "rank", "item", "part", "p"):
        odd = odd.withColumn(c, odd["text"])
    got = rows_of(audit.divergence(odd, min_docs=1))
    assert got == brute([(None, None, None), ("", "", "a"), ("", "b", "long " * 300_000)], 1) and len(got) == 4


def test_large_counts_stay_exact(spark):
    rows = table(spark, [("en", "a", "x"), ("en", "b", "y")])
    got = rows_of(audit.divergence(rows, min_docs=1, scale=10 ** 9, smooth=10 ** 9))
    assert got == brute([("en", "a", "x"), ("en", "b", "y")], 1, smooth=10 ** 9)
