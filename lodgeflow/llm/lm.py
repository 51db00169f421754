"""LM scoring: a bigram model with Katz backoff and Good-Turing discounts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodgeflow.llm.common import word_blocks, written
from lodgeflow.llm.units import REQUEST, Hashes, answers, gathered, mix64, pack, requests, squeeze, texts_of

END, BEGIN = np.uint64(1), np.uint64(2)
CUT = 5                # counts above it are trusted as they are
BUCKET_TOKENS = 2_000_000
WORDS, PAIRS = 0, 1


def discounts(hist: list[int], cut: int = CUT) -> np.ndarray:
    """d[r] for counts r of 0 to cut, 1 beyond (the last entry), from hist[r - 1], the
    number of types counted r times, r = 1 to cut + 1. Katz's renormalised Good-Turing
    ratios; where the counts of counts are too irregular for it (a ratio outside
    (0, 1]), absolute discounting by n1 / (n1 + 2 n2)."""
    n = [0, *hist]
    out = np.ones(cut + 2)
    if n[1]:
        rest = (cut + 1) * n[cut + 1] / n[1]
        gt = [((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if n[r] and rest < 1 else 0.0 for r in range(1, cut + 1)]
        if all(0 < d <= 1 for d in gt):
            out[1:cut + 1] = gt
        else:
            less = n[1] / (n[1] + 2 * n[2])
            out[1:cut + 1] = [(r - less) / r if less < r else 0.5 for r in range(1, cut + 1)]
    return out


def _tokens(row: dict, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """A unit's tokens, documents one after the other, each closed by END; tokens a document."""
    parts, sizes = [], []
    for t in texts_of(row["blob"], row["lens"]):
        words = [hashes.of(w) for w in word_blocks((t or b"").lower())]
        sizes.append(sum(map(len, words)) + 1)
        parts += [*words, np.array([END])]
    return np.concatenate(parts), np.array(sizes)


def _pairs(tok: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the documents, each token's history, and the hash of both."""
    starts = np.cumsum(sizes) - sizes
    history = np.concatenate([[BEGIN], tok[:-1]])
    history[starts] = BEGIN
    return starts, history, mix64(history, tok)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for row in b.to_pylist():
                tok, sizes = _tokens(row, hashes)
                train = np.repeat(~np.array(row["flags"]), sizes)
                for kind, keys in ((WORDS, tok), (PAIRS, _pairs(tok, sizes)[2])):
                    uniq, inv = np.unique(keys, return_inverse=True)
                    yield requests(kind, row["unit"], uniq, np.bincount(inv, train, len(uniq)).astype(np.uint32), buckets)

    return run


def _count(table: pa.Table) -> pa.Table:
    """A bucket's training counts; the lowest bit marks the first unit that trains on the hash."""
    units, slices, keys, vals = gathered(table)
    uniq, inv = np.unique(keys, return_inverse=True)
    c = np.bincount(inv, vals, len(uniq)).astype(np.int64)
    first = np.full(len(uniq), len(keys))
    has = np.flatnonzero(vals)
    np.minimum.at(first, inv[has], has)
    said = c[inv] << 1 | (first[inv] == np.arange(len(keys)))
    hist = [*(int((c == r).sum()) for r in range(1, CUT + 2)), int((c > 0).sum()), int(c.sum())]
    n = len(units)
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    return pa.table({
        "unit": pa.array([*units, -1], pa.int64()), "kind": pa.array([kind] * (n + 1), pa.int32()),
        "bucket": pa.array([bucket] * (n + 1), pa.int32()),
        "vals": pa.array([*(squeeze(said[s]) for s in slices), None], pa.binary()),
        "hist": pa.array([*([None] * n), hist], pa.list_(pa.int64()))})


def _score(n: int, v: int, d1: np.ndarray, d2: np.ndarray, unknown: float, n_docs: int, id_type: pa.DataType):
    """Per unit: documents' sums, what each history has been followed by (each trained
    pair in one unit only), and the histories that documents back off from."""

    def run(_key, unit: pa.Table, said: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        if not rows:
            return pa.table({k: pa.array([], t) for k, t in fields})
        row = rows[0]
        tok, sizes = _tokens(row, Hashes())
        starts, history, pair = _pairs(tok, sizes)
        words, at = np.unique(tok, return_inverse=True)
        c = answers(said, WORDS) >> 1
        p1 = np.where(c > 0, d1[np.minimum(c, CUT + 1)] * c / (n + 1), unknown)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        pairs, one, pat = np.unique(pair, return_index=True, return_inverse=True)
        own = answers(said, PAIRS)
        cp, own = own >> 1, own & 1
        begins = history[one] == BEGIN
        ch = np.where(begins, n_docs, c[at[np.maximum(one - 1, 0)]])
        w = at[one]
        del pair, tok
        d = d2[np.minimum(cp, CUT + 1)]
        with np.errstate(divide="ignore"):
            lp = np.where(cp > 0, np.log10(d * cp / (ch + 1)), np.log10(p1[w]))
        total = lambda x: np.add.reduceat(x, starts)
        docs = len(sizes)
        # histories: sum of the followers' unigram probabilities, and what discounting took from them
        mine = np.flatnonzero(own)
        hs, hi = np.unique(history[one][mine], return_inverse=True)
        follow = np.bincount(hi, p1[w[mine]], len(hs))
        left = np.bincount(hi, np.where(cp[mine] <= CUT, cp[mine] * (1 - d[mine]), 0.0), len(hs))
        hc = np.zeros(len(hs), np.int64)
        hc[hi] = ch[mine]
        # backoffs from known histories
        off = np.flatnonzero(((cp == 0) & (ch > 0))[pat])
        doc = np.repeat(np.arange(docs), sizes)[off]
        order = np.lexsort((history[off], doc))
        bd, bh = doc[order], history[off][order]
        new = np.flatnonzero(np.r_[True, (bd[1:] != bd[:-1]) | (bh[1:] != bh[:-1])]) if len(bd) else np.zeros(0, int)
        times = np.diff(np.r_[new, len(bd)])
        a, b, m = docs, len(hs), len(new)
        numbers = {
            "part": (np.zeros(a, np.int32), np.ones(b, np.int32), np.full(m, 2, np.int32)), "id": (row["ids"], None, None),
            "unit": (np.full(a, row["unit"]), None, np.full(m, row["unit"])), "row": (np.arange(a), None, bd[new]), "held": (row["flags"], None, None),
            "n_tokens": (sizes, None, None), "n_known": (total((c > 0)[at].astype(np.int64)), None, None), "base": (total(base[at]), None, None),
            "score": (total(lp[pat]), None, None), "h": (None, hs.view(np.int64), bh[new].view(np.int64)), "n": (None, hc, times),
            "follow": (None, follow, None), "taken": (None, left, None)}
        return pa.table({k: pa.chunked_array(
            [pa.nulls(size, t) if x is None else pa.array(x, t) for x, size in zip(numbers[k], (a, b, m))]).combine_chunks() for k, t in fields})

    fields = [("part", pa.int32()), ("id", id_type), ("unit", pa.int64()), ("row", pa.int32()), ("held", pa.bool_()), ("n_tokens", pa.int64()),
              ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("h", pa.int64()), ("n", pa.int64()),
              ("follow", pa.float64()), ("taken", pa.float64())]
    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, held_out: Column | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end; null
    texts are empty. The model learns from the rows where ``held_out`` is false (by default
    crc32 of the id as text, null as empty, modulo 10 is not 0). base_score is the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))), score the log10 probability of the text under
    the Katz model. Repeated rows are documents of their own, for counts too. An empty
    table returns no rows; without training rows every word is unknown. Other columns
    are ignored. Words are known by 64-bit hashes.

    Model. P(w | h) = d(c) c(h, w) / (c(h) + 1) if the pair was seen, else a(h) P(w), and
    P(w) if h was not seen; h is the word before, or the begin of the text. P(w) =
    d(c) c(w) / (N + 1), and all unseen words are one type with the rest. d are
    Good-Turing discounts of counts up to 5. a(h) makes the probabilities that follow h
    sum to one exactly. The one added to the denominators keeps some weight for unseen
    words where discounting leaves none.

    Method. Words and pairs are counted over all training documents in hash-range
    buckets; units of documents send their distinct hashes and get the counts back.
    Each trained pair's share in its history's weight is worked out in one of the
    units that hold it. Weights are grouped sums, joined to the backoffs that documents
    make (only there: a pair seen in training needs none). All tables lie partitioned in
    the shared folder.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(10)) == 0 if held_out is None else held_out
    units = pack(docs, id_col, text_col, F.coalesce(held, F.lit(False)))
    size = units.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)) + 1)),
                     F.sum(F.size(F.filter("flags", lambda f: ~f)))).first()
    buckets = max(1, math.ceil((size[0] or 0) / 6 / BUCKET_TOKENS))
    asked = units.mapInArrow(_ask(buckets), REQUEST)
    said = written(asked.groupBy("kind", "bucket").applyInArrow(
        _count, "unit long, kind int, bucket int, vals binary, hist array<long>"), "counts")
    hist = {r.kind: r.hist for r in said.where("unit = -1").groupBy("kind").agg(
        F.array(*(F.sum(F.col("hist")[i]) for i in range(CUT + 3))).alias("hist")).collect()}      # two rows
    empty = [0] * (CUT + 3)
    w, p = hist.get(WORDS, empty), hist.get(PAIRS, empty)
    d1, d2, v, n = discounts(w[:CUT + 1]), discounts(p[:CUT + 1]), w[-2], w[-1]
    unknown = (1 + sum(r * (1 - d1[r]) * w[r - 1] for r in range(1, CUT + 1))) / (n + 1)
    id_type = units.schema["ids"].dataType.elementType
    done = written(
        units.groupBy("unit").cogroup(said.where("unit >= 0").select("unit", "kind", "bucket", "vals").groupBy("unit")).applyInArrow(
            _score(n, v, d1, d2, unknown, size[1] or 0, to_arrow_type(id_type)),
            f"part int, id {id_type.simpleString()}, unit long, row int, held boolean, n_tokens long, n_known long, base double, "
            "score double, h long, n long, follow double, taken double"), "scores", "part")
    weight = (done.where("part = 1").groupBy("h").agg(F.sum("follow").alias("follow"), F.sum("taken").alias("taken"), F.max("n").alias("c"))
              .select("h", F.log10((1 + F.col("taken")) / (F.col("c") + 1) / (1 - F.col("follow"))).alias("weight")))
    off = (done.where("part = 2").select("unit", "row", "h", "n").join(weight, "h")
           .groupBy("unit", "row").agg(F.sum(F.col("n") * F.col("weight")).alias("off")))
    return done.where("part = 0").join(off, ["unit", "row"], "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("score") + F.coalesce("off", F.lit(0.0))).alias("score"))
