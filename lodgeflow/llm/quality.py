"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import math
import operator
import string
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import word_blocks, written

FIT_ROWS = 20_000      # labelled rows the classifier is fitted on, at most
TERMS = 300            # words and beginnings of words it looks for, at most
_PUNCT = string.punctuation.encode()
_SPLIT = bytes.maketrans(_PUNCT, b" " * len(_PUNCT))
_MARKS = bytes(c for c in _PUNCT if c not in b".,;:'\"-()?")
_UPPER = string.ascii_uppercase.encode()
STEMS = (4, 5)         # it looks for words' beginnings of so many bytes too: inflected words
SHAPE = ("marks", "upper", "again", "alike", "length", "digits")


def shape(text: str | None) -> tuple[int, list[float], set[bytes]]:
    """Words, shape features (see SHAPE) and distinct lower-case words without punctuation."""
    data = (text or "").encode()
    n = again = 0
    kinds: set[bytes] = set()
    raw: set[bytes] = set()
    last: list[bytes] = []
    for words in word_blocks(data):
        words = last + words
        again += sum(map(operator.eq, words, words[1:]))
        n += len(words) - len(last)
        raw.update(words)
        last = words[-1:]
    for words in word_blocks(data.lower().translate(_SPLIT)):
        kinds.update(words)
    size = max(1, len(data))
    less = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    return n, [less(_MARKS), less(_UPPER), again / max(1, n), 1 - len(raw) / max(1, n), math.log1p(n) / 10, less(b"0123456789")], kinds


def stems(kinds: set[bytes]) -> list[tuple[bytes, set[bytes]]]:
    """The words, and their beginnings, each kind behind a prefix of its own."""
    return [(b"", kinds)] + [(b"%d^" % n, {w[:n] for w in kinds if len(w) > n}) for n in STEMS]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products."""
    pairs = [x[:, i] * x[:, j] for i, j in combinations_with_replacement(range(x.shape[1]), 2)]
    return np.column_stack([x, *pairs]) if len(x) else np.zeros((0, x.shape[1] * (x.shape[1] + 3) // 2))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept last) by Newton's method; base rate alone where there is one class only."""
    out = np.zeros(x.shape[1] + 1)
    if len(y) == 0 or y.min() == y.max():
        out[-1] = 0.0 if len(y) == 0 else math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return out
    a = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ out, -30, 30)))
        grad = a.T @ (y - p) - ridge @ out
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + ridge, grad)
        out += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return out


class Classifier:
    """Two logistic heads: quality from the shape of a text, toxicity from its words."""

    def __init__(self, terms: list[bytes], mean, scale, quality, toxic):
        self.by_kind: dict[bytes, dict[bytes, int]] = {}
        for i, t in enumerate(terms):
            kind, _, word = t.rpartition(b"^")
            self.by_kind.setdefault(kind + b"^" * bool(kind), {})[word] = i
        self.mean, self.scale, self.quality, self.toxic = mean, scale, quality, toxic

    def logits(self, texts: Iterator[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Words, and log-odds of good quality and of toxicity. One text's words at a time."""
        sizes, shapes, toxic = [], [], []
        for n, features, kinds in map(shape, texts):
            t = self.toxic[-1]
            for kind, words in stems(kinds):
                ours = self.by_kind.get(kind, {})
                t += sum(self.toxic[ours[w]] for w in ours.keys() & words)
            sizes.append(n)
            shapes.append(features)
            toxic.append(t)
        x = _expand(np.array(shapes, float).reshape(-1, len(SHAPE)))
        q = ((x - self.mean) / self.scale) @ self.quality[:-1] + self.quality[-1]
        return sizes, np.clip(q, -30, 30), np.clip(np.array(toxic, float), -30, 30)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS,
        terms: int = TERMS) -> Classifier:
    """Fit on the ``fit_rows`` labelled ids of smallest hash (rows without an id don't
    count; of an id's labels the lowest quality and the highest toxicity hold)."""
    some = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
            .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("__id"), "__id").limit(fit_rows))
    # at most fit_rows rows of three numbers: bounded
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "__id")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):     # their words are much larger
            got = [shape(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("__id"), b.column("quality"), b.column("toxic"), pa.array([g[1] for g in got], pa.list_(pa.float64())),
                 pa.array([sorted(k + w for k, ws in stems(g[2]) for w in ws) for g in got], pa.list_(pa.binary()))], ["__id", "quality", "toxic", "shape", "kinds"])

    kind = rows.schema["__id"].dataType.simpleString()
    seen = written(rows.select("__id", "text", "quality", "toxic").mapInArrow(
        shapes, f"__id {kind}, quality int, toxic int, shape array<double>, kinds array<binary>"), "labelled")
    known = seen.where("toxic is not null")
    n, pos = known.agg(F.count("*"), F.sum("toxic")).first()
    word = known.select("toxic", F.explode("kinds").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("p"), F.count("*").alias("k"))
    chosen: list[bytes] = []
    if n and pos and pos < n:
        expected = F.col("k") * (pos / n)
        top = (word.where(F.col("p") > expected * 2).withColumn("g", F.col("p") * F.log(F.col("p") / expected))
               .orderBy(F.desc("g"), "word").limit(terms))
        chosen = [bytes(r.word) for r in top.collect()]
    table = F.array(*map(F.lit, [bytearray(c) for c in chosen])) if chosen else F.array().cast("array<binary>")
    got = seen.select("__id", "quality", "toxic", "shape", F.array_intersect("kinds", table).alias("hits")).toPandas()
    got = got.sort_values("__id", kind="stable")
    x = _expand(np.array(got["shape"].tolist(), float).reshape(-1, len(SHAPE)))
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (0.0, 1.0)
    q = got["quality"].notna().to_numpy(bool)
    t = got["toxic"].notna().to_numpy(bool)
    at = {w: i for i, w in enumerate(chosen)}
    h = np.zeros((len(got), len(chosen)))
    for i, hits in enumerate(got["hits"]):
        h[i, [at[bytes(w)] for w in hits]] = 1
    return Classifier(chosen, mean, scale, fit_logistic((x[q] - mean) / scale, got["quality"].to_numpy(float)[q]),
                      fit_logistic(h[t], got["toxic"].to_numpy(float)[t]))


def evidence(docs: DataFrame, model: Classifier, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, n_words, quality_logit, toxic_logit) of every row."""
    narrow = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"),
                         F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, q, t = model.logits(t.as_py() for t in b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(q), pa.array(t)],
                ["id", "host", "path", "n_words", "quality_logit", "toxic_logit"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, host string, path string, n_words long, quality_logit double, toxic_logit double")


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, prior: Column) -> float:
    """Pseudo-counts of the beta prior by moments: how little the groups' means vary
    beyond what their sizes explain. Few or equal groups: strong shrinking."""
    between, inside = groups.agg(
        F.sum(F.col("n") * (mean - prior) ** 2 - prior * (1 - prior)) / F.sum("n"), F.avg(prior * (1 - prior))).first()
    if between is None or between <= 0 or not inside:
        return 10_000.0
    return float(min(10_000.0, max(1.0, inside / between - 1)))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, host: Column | str = "source",
          path: Column | str = "lang", min_quality: float = 0.5, max_toxic: float = 0.5, fit_rows: int = FIT_ROWS,
          terms: int = TERMS) -> DataFrame:
    """(id_col, n_words, quality_evidence, toxic_evidence, quality_prior, toxic_prior,
    quality, toxic, kept) for every row of ``docs``; all but the first two and the last
    are probabilities.

    kept: quality >= min_quality and toxic <= max_toxic. ``host`` and ``path`` name a
    site and a part of it (columns or expressions); null is a site of its own.
    ``labels`` has (id_col, quality, toxic), 0 or 1, nulls unused; without labels of
    both kinds a head gives its base rate, one half at worst, and rejects nothing.
    A text without words (null, empty, blank) brings no evidence: it gets the prior of
    its site and is kept. Repeated rows each return a row and count in their site. An
    empty table returns no rows. Other columns are ignored.

    Method. A classifier, fitted on at most ``fit_rows`` labelled rows (shape of the
    text; its most telling words), gives each document a probability. Sites are
    grouped sums of these: a host's posterior mean is its sum shrunk towards the global
    mean, a path's its sum shrunk towards its host's posterior, each by pseudo-counts
    estimated from all groups, so a sparse site keeps its parent's prior. The
    document's odds are then moved by the odds of its path against the global ones.
    Only sums leave a site: one with a third of all documents is pre-aggregated.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    model = fit(docs, labels, id_col, text_col, fit_rows, terms)
    seen = written(evidence(docs, model, id_col, text_col, col(host), col(path)), "evidence")
    prob = lambda c: 1 / (1 + F.exp(-F.col(c)))
    has = F.col("n_words") > 0
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    seen = seen.withColumn("h", key("host")).withColumn("p", key("path"))
    paths = written(seen.groupBy("h", "p").agg(
        F.count_if(has).alias("n"), F.coalesce(F.sum(F.when(has, prob("quality_logit"))), F.lit(0.0)).alias("q"),
        F.coalesce(F.sum(F.when(has, prob("toxic_logit"))), F.lit(0.0)).alias("t")), "sites")
    hosts = paths.groupBy("h").agg(*(F.sum(c).alias(c) for c in "nqt"))
    n, q, t = paths.agg(*(F.sum(c) for c in "nqt")).first()
    mean = {c: (s / n if n else 0.5) for c, s in (("q", q), ("t", t))}
    for c in "qt":
        k = _strength(hosts.where("n > 0"), F.col(c) / F.col("n"), F.lit(mean[c]))
        hosts = hosts.withColumn(f"h{c}", (F.col(c) + k * mean[c]) / (F.col("n") + k))
    sites = paths.join(hosts.select("h", "hq", "ht"), "h")
    for c in "qt":
        k = _strength(sites.where("n > 0"), F.col(c) / F.col("n"), F.col(f"h{c}"))
        sites = sites.withColumn(f"{c}_prior", (F.col(c) + k * F.col(f"h{c}")) / (F.col("n") + k))
    sites = sites.select("h", "p", "q_prior", "t_prior")
    both = seen.join(sites, ["h", "p"])

    def posterior(logit: str, c: str) -> Column:
        moved = F.col(logit) + _logit(F.col(f"{c}_prior")) - _logit(F.lit(mean[c]))
        return F.when(has, 1 / (1 + F.exp(-moved))).otherwise(F.col(f"{c}_prior"))

    quality, toxic = posterior("quality_logit", "q"), posterior("toxic_logit", "t")
    return both.select(
        F.col("id").alias(id_col), "n_words", F.when(has, prob("quality_logit")).alias("quality_evidence"),
        F.when(has, prob("toxic_logit")).alias("toxic_evidence"), F.col("q_prior").alias("quality_prior"),
        F.col("t_prior").alias("toxic_prior"), quality.alias("quality"), toxic.alias("toxic"),
        (~has | ((quality >= min_quality) & (toxic <= max_toxic))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without those rejected by :func:`judge`, all columns unchanged. Rows
    that share an id go together; rows without an id stay."""
    gone = judge(docs, labels, id_col, **kw).where("not kept").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
