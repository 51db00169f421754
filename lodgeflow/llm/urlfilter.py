"""URL filters: a Bloom filter cascade over the corpus's own key universe."""

from __future__ import annotations

import math

import numpy as np
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import UPPER, written

MAX_BITS = 1 << 26     # a first level takes 8 MB at most: the levels are literals of a plan, a longer list takes more plans


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.regexp_replace(_rest(url), "^[^/?#]*", ""), "^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))


def keys_of(host: Column, path: Column) -> Column:
    """Every rule that would fit: each domain the host lies in with each folder of the path."""
    labels, parts = F.split(host, "\\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda j: F.concat(F.array_join(F.slice(parts, F.lit(1), j), "/"), F.lit("/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(domains, lambda d: F.transform(folders, lambda f: F.concat(d, f))))


class Cascade:
    """Exact membership of the universe's keys in a list.

    Level 1 is a Bloom filter of the listed keys, level 2 one of the universe's keys
    that pass level 1 but are not listed, level 3 one of the listed keys that pass
    level 2, and so on until nothing passes wrongly. A key is listed if the first level
    that lacks it is even. The first level's error rate is set so that about as many
    keys pass it wrongly as are listed; so all levels together take a few bits a
    listed key, and a factor of log(universe / listed), not space by the corpus.
    """

    @staticmethod
    def shape(n: int, rest: int) -> tuple[float, int]:
        """Error rate and bits of a first level for n listed keys of a universe of ``rest``."""
        rate = min(0.5, n * math.sqrt(0.5) / max(1, rest))
        return rate, max(64, -(-math.ceil(1.4427 * n * Cascade._hashes(rate)) // 64) * 64)

    @staticmethod
    def _hashes(rate: float) -> int:
        return max(1, math.ceil(-math.log2(rate)))

    def __init__(self, listed: DataFrame, universe: DataFrame, name: str):
        own = written(listed.select("key").distinct(), f"{name}-1")
        n, rest = own.count(), universe.count()
        self.levels: list[tuple[int, int, Column]] = []
        rate = self.shape(n, rest)[0] if n else 0.5
        now, before = own, None
        while n:
            self._add(now, n, rate)
            rate = 0.5
            level = len(self.levels)
            pool = universe.join(own, "key", "left_anti") if before is None else before
            wrong = written(pool.select("key").where(self._holds(F.col("key"), level)), f"{name}-{level + 1}")
            before, now, n = now, wrong, wrong.count()

    def _add(self, keys: DataFrame, n: int, rate: float) -> None:
        k = self._hashes(rate)
        m = max(64, -(-math.ceil(1.4427 * n * k) // 64) * 64)
        level = len(self.levels) + 1
        at = F.explode(F.array(*(self._place(F.col("key"), level, j, m) for j in range(k))))
        words = np.zeros(m // 64, ">i8")
        found = (keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow())        # m / 64 rows at most
        words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.levels.append((m, k, _longs(words)))

    @staticmethod
    def _place(key: Column, level: int, j: int, m: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(m))

    def _holds(self, key: Column, level: int) -> Column:
        m, k, bits = self.levels[level - 1]
        out = F.lit(True)
        for j in range(k):
            at = self._place(key, level, j, m)
            out = out & (F.getbit(F.element_at(bits, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)
        return out

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            out = F.when(self._holds(key, level), out).otherwise(F.lit(level % 2 == 0))
        return out


def _longs(words: np.ndarray) -> Column:
    """An array literal of 64-bit words, handed over as bytes at once: element by element takes minutes."""
    sc = SparkContext._active_spark_context
    jvm, out = sc._jvm, sc._gateway.new_array(sc._jvm.long, len(words))
    jvm.java.nio.ByteBuffer.wrap(bytearray(words.tobytes())).asLongBuffer().get(out)
    return Column(jvm.org.apache.spark.sql.functions.lit(out))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", *, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has (host, path, action): action allow or block, path begins and ends
    with ``/``. A rule fits its host and all subdomains if the url's path starts with
    the rule's; the longest fitting one decides (of equally long ones the longer host),
    a rule listed with both actions blocks. A url that no rule fits is not listed:
    allow, rule null. Null urls, and urls without ``://``, have empty host and path; an
    empty path starts with no rule's. Rules with a null are unused; repeated rules count
    once, repeated pages each return a row. Empty tables: no rows, or no listed key.
    Other columns are ignored.

    Method. A url's keys are its host and parent domains with each folder of its path,
    so a rule fits just if it is among them. The distinct keys of all pages are the
    universe; a :class:`Cascade` for either action, built over it, then answers for each
    key by its bits, in the row: no join, and no wrong answer for any key of the corpus.
    A list whose first level would outgrow ``max_bits`` is split by hash into parts with
    cascades of their own, asked one after the other.
    """
    ok = rules.where("host is not null and path is not null and action in ('allow', 'block')")
    if ok.where("path not rlike '^/(.*/)?$' or host = ''").limit(1).count():
        raise ValueError("a rule's path begins and ends with /, and its host is not empty")
    listed = written(ok.select(F.concat(F.translate("host", UPPER, UPPER.lower()), "path").alias("key"), "action").distinct(), "rules")
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url")).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = written(rows.select("host", "path").distinct().select(F.explode(keys_of(F.col("host"), F.col("path"))).alias("key"))
                       .distinct(), "universe")
    n, rest = listed.count(), universe.count()
    parts = max(1, -(-Cascade.shape(n, rest)[1] // max_bits)) if n else 1
    keys = keys_of(F.col("host"), F.col("path"))
    hits: list[Column] = []
    for p in range(parts):
        part = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == p
        block, allow = (Cascade(listed.where((F.col("action") == a) & part), universe.where(part), a) for a in ("block", "allow"))
        mine = F.filter(keys, lambda k: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(parts)) == p) if parts > 1 else keys
        found = F.filter(mine, lambda k: block.has(k) | allow.has(k))
        best = F.array_max(F.transform(found, lambda k: F.struct(
            F.char_length(k).alias("n"), F.instr(k, "/").alias("at"), k.alias("key"), block.has(k).alias("blocked"))))
        rows = rows.withColumn(f"best{p}", best)
        hits.append(F.col(f"best{p}"))
        if parts > 1:                       # the next part's levels belong to a plan of their own
            rows = written(rows, f"part-{p}")
    rows = rows.withColumn("best", F.greatest(*hits) if parts > 1 else hits[0])
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"),
                       F.when(F.col("best.blocked"), "block").otherwise("allow").alias("verdict"))
