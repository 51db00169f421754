"""URL filter against a brute-force version, and the cascade's exactness."""

import random
import re

from pyspark.sql import functions as F

from lodgeflow.llm.urlfilter import Cascade, judge_urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.org", "/fr/", "block"), ("B.com", "/x/y/", "block"), ("b.com", "/x/", "allow"), ("b.com", "/x/", "block")]


def brute(rows):
    out = []
    for i, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), a == "block", h.lower() + p) for h, p, a in RULES
                if ("." + host).endswith("." + h.lower()) and path.startswith(p)]
        best = max(fits) if fits else None
        out.append((i, host, path, best and best[3], "block" if best and best[2] else "allow"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["x.net", "EXAMPLE.net", "m.example.net", "anet", ".net", "example.com", "q.a.org", "a.org", "b.COM", "z.b.com", "", "É.org"]
    paths = ["", "/", "/en/1", "/en", "/de/a/b?x", "/fr/#t", "/x/y/z", "/x//y/", "?q=/fr/", "/x/y"]
    rows = [(i, f"http://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(400)]
    rows += [(None, None), (1, ""), (1, "no scheme/fr/"), (2, "a://b://net/"), (2, "a://b://net/"), (3, "http://x.net/" + "d/" * 300)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, rule int")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), RULES[0]], "host string, path string, action string")
    assert sorted((tuple(r) for r in judge_urls(df, rules).collect()), key=repr) == brute(rows)
    assert judge_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in judge_urls(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("key"), F.col("id")).alias("key"))
    listed = universe.where("abs(hash(key)) % 7 = 0")
    c = Cascade(listed, universe, "t")
    assert len(c.levels) > 2
    wrong = universe.where(c.has(F.col("key")) != (F.expr("abs(hash(key)) % 7 = 0"))).count()
    assert wrong == 0


def test_long_lists_are_split_and_answer_alike(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{rng.randrange(3000)}.net/a/b") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.range(2000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net")).alias("host"), F.lit("/a/").alias("path"),
                                     F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("action"))
    whole = sorted(tuple(r) for r in judge_urls(df, rules).collect())
    assert sorted(tuple(r) for r in judge_urls(df, rules, max_bits=4096).collect()) == whole
    for _, host, _, rule, verdict in whole:
        n = int(host[1:].split(".")[0])
        assert (rule, verdict) == ((host + "/a/", "allow" if n % 3 == 0 else "block") if n < 2000 else (None, "allow"))


def test_a_large_level_is_handed_over_whole(spark):
    universe = spark.range(300_000).select(F.col("id").cast("string").alias("key"))
    c = Cascade(universe.where("key % 2 = 0"), universe, "large")
    assert c.levels[0][0] > 200_000
    assert universe.where(c.has(F.col("key")) != (F.expr("key % 2 = 0"))).count() == 0
