"""Quality classifier: held-out accuracy, shrinking, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodgeflow.llm import quality


def test_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(d, lab, fit_rows=2500).join(lab.withColumnsRenamed({"quality": "q", "toxic": "t"}), "doc_id")
    fitted = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2500).select("doc_id")
    held = rows.join(fitted, "doc_id", "left_anti").select("kept", "q", "t").collect()
    good = [r.kept for r in held if r.q == 1 and r.t == 0]
    bad = [not r.kept for r in held if r.q == 0 or r.t == 1]
    assert len(good) > 800 and sum(good) / len(good) > 0.99
    assert len(bad) > 200 and sum(bad) / len(bad) > 0.93


def test_logistic_fit_matches_a_known_optimum():
    x, y = np.array([[0.0]] * 10 + [[1.0]] * 10), np.array([1.0] * 2 + [0.0] * 8 + [1.0] * 7 + [0.0] * 3)
    w = quality.fit_logistic(x, y, penalty=1e-9)
    assert math.isclose(w[1], math.log(0.2 / 0.8), abs_tol=1e-4) and math.isclose(w[0] + w[1], math.log(0.7 / 0.3), abs_tol=1e-4)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, None, "a", None), (2, "", None, "x"), (3, " \t", "a", "x"), (4, "w " * 200000, "a", "x"),
            (5, "fine words here", "a", "x"), (5, "fine words here", "a", "x"), (None, "more words", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("host", F.lit(3))


def test_edge_rows_without_labels(spark, edge):
    labels = spark.createDataFrame([(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(edge, labels).collect()
    assert len(got) == 7 and all(r.kept for r in got)
    assert sorted(r.n_words for r in got) == [0, 0, 0, 2, 3, 3, 200000]
    assert all(r.quality_evidence is None and r.quality == r.quality_prior for r in got if r.n_words == 0)
    assert quality.judge(edge.limit(0), labels.limit(0)).collect() == []
    assert quality.keep_good(edge, labels).columns == edge.columns


def test_sparse_sites_shrink_towards_their_parents(spark):
    model = quality.Classifier([], 0.0, 1.0, np.zeros(28), np.zeros(1))
    rows = [(i, "bad" if i % 10 else "good", "big" if i < 900 else "good-host", "p") for i in range(1000)]
    rows += [(2000, "bad", "tiny", "p"), (2001, "good", "big", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    old_fit, old_evidence = quality.fit, quality.evidence
    try:
        quality.fit = lambda *a, **k: model
        quality.evidence = lambda d, m, i, t, h, p: d.select(
            F.col("doc_id").alias("id"), h.alias("host"), p.alias("path"), F.lit(1).cast("long").alias("n_words"),
            F.when((F.col("text") == "good") | (F.col("source") == "good-host"), 2.0).otherwise(-2.0).alias("quality_logit"),
            F.lit(-3.0).alias("toxic_logit"))
        got = {r.doc_id: r.quality_prior for r in quality.judge(docs, labels).collect()}
    finally:
        quality.fit, quality.evidence = old_fit, old_evidence
    own = 1 / (1 + math.exp(2))
    big, good, whole = 0.2, 0.88, 0.27
    assert abs(got[1] - big) < 0.03 and abs(got[950] - good) < 0.05       # large sites keep their own mean
    assert own < got[2000] < whole                                       # one document moves a site only part of the way
    assert got[2001] < 0.5                                               # a sparse path stays near its host, not the global mean


def brute_posteriors(rows):
    """Site posteriors from (host, path, n_words, quality logit, toxic logit), by the formulas of the docstring."""
    sig, logit = lambda x: 1 / (1 + math.exp(-x)), lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    out = [{} for _ in rows]
    for at, name in ((3, "quality"), (4, "toxic")):
        known = [r for r in rows if r[2] > 0]
        whole = sum(sig(r[at]) for r in known) / len(known)

        def groups(key):
            found = {}
            for r in rows:
                s = found.setdefault(key(r), [0, 0.0])
                if r[2] > 0:
                    s[0] += 1
                    s[1] += sig(r[at])
            return found

        def strength(found, prior):
            some = {k: v for k, v in found.items() if v[0] > 0}
            between = sum(n * (s / n - prior(k)) ** 2 - prior(k) * (1 - prior(k)) for k, (n, s) in some.items()) / sum(n for n, _ in some.values())
            inside = sum(prior(k) * (1 - prior(k)) for k in some) / len(some)
            return 10_000.0 if between <= 0 or not inside else min(10_000.0, max(1.0, inside / between - 1))

        hosts = groups(lambda r: r[0])
        k = strength(hosts, lambda h: whole)
        host = {h: (s + k * whole) / (n + k) for h, (n, s) in hosts.items()}
        paths = groups(lambda r: r[:2])
        k = strength(paths, lambda p: host[p[0]])
        path = {p: (s + k * host[p[0]]) / (n + k) for p, (n, s) in paths.items()}
        for o, r in zip(out, rows):
            prior = path[r[:2]]
            o[name] = sig(r[at] + logit(prior) - logit(whole)) if r[2] > 0 else prior
            o[name + "_prior"], o["n"] = prior, r[2]
    return out


def test_posteriors_against_brute_force(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, "src1", None), (-2, " ", None, "xx"), (-3, "some words", "tiny", "en")], "doc_id long, text string, source string, lang string")
    d = d.select("doc_id", "text", "source", "lang").union(odd)
    model = quality.fit(d, lab)
    seen = {r.id: r for r in quality.evidence(d, model, "doc_id", "text", F.col("source"), F.col("lang")).collect()}
    ids = sorted(seen)
    want = brute_posteriors([(seen[i].host, seen[i].path, seen[i].n_words, seen[i].quality_logit, seen[i].toxic_logit) for i in ids])
    got = {r.doc_id: r for r in quality.judge(d, lab).collect()}
    assert len(got) == len(ids) > 900
    for i, w in zip(ids, want):
        r = got[i]
        assert all(math.isclose(r[c], w[c], rel_tol=1e-7, abs_tol=1e-9) for c in ("quality", "toxic", "quality_prior", "toxic_prior"))
        assert r.kept == (w["n"] == 0 or (w["quality"] >= 0.5 and w["toxic"] <= 0.5))
    assert 0 < sum(not r.kept for r in got.values()) < len(ids) / 2
