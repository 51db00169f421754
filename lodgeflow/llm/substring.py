"""Substring dedup: an FM-index per shard answers which windows of words stand in an earlier document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodgeflow.llm.common import word_blocks, written
from lodgeflow.llm.units import (REQUEST, Hashes, answers, gathered, mix64, pack, requests, squeeze, squeeze_sorted, texts_of,
                                 unsqueeze, unsqueeze_sorted)

GRAM = 5               # words of an anchor
HOT = 1000             # documents from which on an anchor's windows are dealt out one by one
SHARD_WORDS = 2_000_000


class BitVector:
    """Bits packed in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    """Occurrences of a symbol before a position, over the bits of symbols from the highest down."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, now = [], symbols
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            ones = (now >> bit & 1).astype(np.uint8)
            self.levels.append((bit, BitVector(ones), len(now) - int(ones.sum())))
            now = np.concatenate([now[ones == 0], now[ones == 1]])
        self.first = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            r = ones.rank(i)
            i = np.where(c >> bit & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.first[c]


class FMIndex:
    """Backward search over a text of symbols 0 to size - 1; it is read as a ring."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        order = np.argsort(text, kind="stable")
        rank, step = _dense(text[order][None], order), 1
        while step < n and rank.max() < n - 1:
            both = rank * n + np.roll(rank, -step)
            order = np.argsort(both, kind="stable")
            rank = _dense(both[order][None], order)
            step *= 2
        self.rows = order                                     # where each sorted rotation begins
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.tree = WaveletTree(text[order - 1], size)

    def search(self, text: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) that begin with text[i:i + width] for each i of ``at``. A search ends
        early when one row is left: it is the window's own."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.rows))
        live = np.arange(len(at))
        for k in range(width - 1, -1, -1):
            c = text[at[live] + k]
            lo[live] = self.smaller[c] + self.tree.rank(c, lo[live])
            hi[live] = self.smaller[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] - lo[live] > 1]
        return lo, hi


def _dense(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], ordered[0, 1:] != ordered[0, :-1]]))
    return rank


def _words(row: dict, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    parts, sizes = [], []
    for t in texts_of(row["blob"], row["lens"]):
        words = [hashes.of(w) for w in word_blocks(t or b"")]
        sizes.append(sum(map(len, words)))
        parts += words
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.array(sizes, np.int64)


def _windows(tok: np.ndarray, sizes: np.ndarray, ids: list, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, their documents, and their anchors: the least hash of
    GRAM words in the window. Equal windows have equal anchors. Rows without an id
    have no windows: no id is smaller or larger."""
    if len(tok) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    named = np.array([i is not None for i in ids])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero((np.arange(len(tok)) + window <= ends) & named[doc])
    gram = min(GRAM, window)
    g = tok[:len(tok) - gram + 1].copy()
    for k in range(1, gram):
        g = mix64(g, tok[k:len(tok) - gram + 1 + k])
    least = g[:len(tok) - window + 1].copy()
    for k in range(1, window - gram + 1):
        np.minimum(least, g[k:k + len(least)], out=least)
    return at, doc[at], least[at]


def _ask(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for row in b.to_pylist():
                at, doc, anchor = _windows(*_words(row, hashes), row["ids"], window)
                if not len(at):
                    continue
                order = np.lexsort((doc, anchor))
                a, d = anchor[order], doc[order]
                new = np.r_[True, a[1:] != a[:-1]]
                held = np.flatnonzero(new)
                yield requests(0, row["unit"], a[held], np.add.reduceat(new | np.r_[True, d[1:] != d[:-1]], held, dtype=np.int64).astype(np.uint32), buckets)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """For each anchor of each unit: 0 in one document only, 1 in several, 2 in very many."""
    units, slices, keys, vals = gathered(table)
    uniq, inv = np.unique(keys, return_inverse=True)
    docs = np.bincount(inv, vals, len(uniq))
    said = ((docs > 1).astype(np.uint8) + (docs > HOT))[inv].astype(np.uint8)
    n = len(units)
    return pa.table({"unit": pa.array(units, pa.int64()), "kind": pa.array([0] * n, pa.int32()),
                     "bucket": pa.array([table.column("bucket")[0].as_py()] * n, pa.int32()),
                     "vals": pa.array([squeeze(said[s]) for s in slices], pa.binary())})


SEGMENTS = "shard int, unit long, dict binary, words binary, sizes binary, docs binary, ids binary, starts binary, texts binary"


def _segments(window: int, shards: int):
    """Runs of windows that share a repeated anchor, to the anchor's shard; equal runs of
    a unit's words travel once. A very frequent anchor's windows go one by one, by their
    outer words too, so that no shard gets all that surrounds a common passage."""

    def run(_key, unit: pa.Table, said: pa.Table) -> pa.Table:
        out: dict[int, tuple] = {}
        rows = unit.to_pylist()
        if rows:
            row = rows[0]
            tok, sizes = _words(row, Hashes())
            at, doc, anchor = _windows(tok, sizes, row["ids"], window)
            uniq, inv = np.unique(anchor, return_inverse=True)
            much = answers(said, 0)[inv] if len(at) else np.zeros(0, np.uint8)
            keep = much > 0
            at, doc, anchor, much = at[keep], doc[keep], anchor[keep], much[keep]
            if len(at):
                hot = much > 1
                key = np.where(hot, mix64(mix64(anchor, tok[at]), tok[at + window - 1]), anchor)
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | hot[1:]]
                first = np.flatnonzero(new)
                length = np.diff(np.r_[first, len(at)]) + window - 1
                base = (np.cumsum(sizes) - sizes)[doc[first]]
                for s, a, n, d, b in zip((key[first] % np.uint64(shards)).tolist(), at[first].tolist(), length.tolist(),
                                         doc[first].tolist(), base.tolist()):
                    kinds, runs = out.setdefault(s, ({}, []))
                    runs.append((d, a - b, kinds.setdefault(tok[a:a + n].tobytes(), len(kinds))))
        cols: dict[str, list] = {c.split()[0]: [] for c in SEGMENTS.split(", ")}
        for s, (kinds, runs) in sorted(out.items()):
            flat = np.frombuffer(b"".join(kinds), np.uint64)
            names, idx = np.unique(flat, return_inverse=True)
            d, a, t = (np.array(x, np.int32) for x in zip(*runs))
            for c, v in zip(cols, (s, row["unit"], squeeze_sorted(names), squeeze(idx.astype(np.int32)),
                                   squeeze(np.array([len(k) // 8 for k in kinds], np.int32)), squeeze(d),
                                   squeeze(np.array([row["ids"][i] for i in d.tolist()], np.int64)), squeeze(a), squeeze(t))):
                cols[c].append(v)
        types = {"shard": pa.int32(), "unit": pa.int64()}
        return pa.table({c: pa.array(v, types.get(c, pa.binary())) for c, v in cols.items()})

    return run


def _search(window: int):
    """A shard: index the distinct runs of all units, look every window up in it, and say
    which windows of which documents stand in a document of smaller id."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["unit"])
        dicts = [unsqueeze_sorted(r["dict"]) for r in rows]
        names = np.unique(np.concatenate(dicts))
        known: dict[bytes, int] = {}
        plan = []
        for r, names_of in zip(rows, dicts):
            words = (np.searchsorted(names, names_of) + 1).astype(np.int32)[unsqueeze(r["words"])]
            ends = np.cumsum(unsqueeze(r["sizes"])).tolist()
            text = np.array([known.setdefault(words[a:b].tobytes(), len(known)) for a, b in zip([0, *ends], ends)])
            plan.append((r["unit"], unsqueeze(r["docs"]), unsqueeze(r["ids"]), unsqueeze(r["starts"]), text[unsqueeze(r["texts"])]))
        owner = np.full(len(known), np.iinfo(np.int64).max)            # the smallest id that holds each run
        for _, _, ids, _, of in plan:
            np.minimum.at(owner, of, ids)
        runs = [np.frombuffer(k, np.int32) for k in known]
        size = np.array([len(x) for x in runs])
        gap = np.zeros(1, np.int32)                                      # stands behind each run, in no window
        text = np.concatenate([y for x in runs for y in (x, gap)]).astype(np.int64)
        begin = np.cumsum(size + 1) - size - 1
        run_of = np.repeat(np.arange(len(runs)), size + 1)
        n_win = size - window + 1
        at = np.repeat(begin, n_win) + np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        index = FMIndex(text, len(names) + 1)
        lo, hi = index.search(text, at, window)
        held = owner[run_of[index.rows]]
        cut, back = np.unique(lo, return_inverse=True)
        last = np.zeros(len(cut), np.int64)
        last[back] = hi
        edges = np.minimum(np.stack([cut, last], axis=1).reshape(-1), len(held))
        least = np.minimum.reduceat(np.append(held, np.iinfo(np.int64).max), edges)[::2][back]
        offset = np.cumsum(n_win) - n_win
        out = {"unit": [], "docs": [], "starts": []}
        for unit, docs, ids, starts, of in plan:
            k = n_win[of]
            j = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            gone = least[np.repeat(offset[of], k) + j] < np.repeat(ids, k)
            if gone.any():
                out["unit"].append(unit)
                out["docs"].append(squeeze(np.repeat(docs, k)[gone]))
                out["starts"].append(squeeze((np.repeat(starts, k) + j)[gone].astype(np.int32)))
        return pa.table({"unit": pa.array(out["unit"], pa.int64()), "docs": pa.array(out["docs"], pa.binary()),
                         "starts": pa.array(out["starts"], pa.binary())})

    return run


def _rewrite(window: int, id_type: pa.DataType):
    def run(_key, unit: pa.Table, found: pa.Table) -> pa.Table:
        rows = unit.to_pylist()
        ids, n_words, spans, texts = [], [], [], []
        if rows:
            row = rows[0]
            docs = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(x) for x in found.column("docs").to_pylist())])
            starts = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(x) for x in found.column("starts").to_pylist())])
            order = np.lexsort((starts, docs))
            docs, starts = docs[order], starts[order]
            for i, t in enumerate(texts_of(row["blob"], row["lens"])):
                words = (t or b"").split()
                s = starts[slice(*np.searchsorted(docs, [i, i + 1]))]
                here = []
                if len(s):
                    new = np.flatnonzero(np.r_[True, s[1:] > s[:-1] + window])
                    here = [{"start": int(a), "end": int(b) + window} for a, b in zip(s[new], s[np.r_[new[1:] - 1, len(s) - 1]])]
                    kept, pos = [], 0
                    for x in here:
                        kept += words[pos:x["start"]]
                        pos = x["end"]
                    kept += words[pos:]
                else:
                    kept = words
                ids.append(row["ids"][i])
                n_words.append(len(words))
                spans.append(here)
                texts.append(b" ".join(kept).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": pa.array(ids, id_type), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span),
                         "text": pa.array(texts, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 13) -> DataFrame:
    """(id_col, n_words, spans, n_removed, kept_text) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``window``
    consecutive words that covers it starts in a document of smaller id too, judged on
    the input. ``spans`` are the removed stretches as [start, end) word positions;
    kept_text is the other words joined by one space. Ids are integers. Null, empty and
    short texts have no windows; rows without an id keep all words and take none from
    others; rows of equal id take none from each other, and each return a row. An empty
    table returns no rows. Other columns are ignored. Words are known by 64-bit hashes.

    Method. A window's anchor is the least hash of its ``GRAM``-word sequences. Units of
    documents ask hash-range buckets which of their anchors occur in several documents;
    only there can a window repeat. Those stretches go to the anchor's shard, equal
    ones of a unit once, with the smallest id. A shard builds a compressed FM-index
    (suffix order, Burrows-Wheeler transform in a wavelet tree of packed bits) of its
    distinct stretches and streams every unit's windows through backward search; the
    rows found give the smallest id that holds the window. As equal windows share
    their anchor they meet in one shard, so shards grow in number with the corpus and
    each document asks only those that can know it.
    """
    units = pack(docs, id_col, text_col)
    total = units.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0))))).first()[0] or 0
    shards = max(1, math.ceil(total / 6 / SHARD_WORDS))
    id_type = units.schema["ids"].dataType.elementType
    said = written(units.mapInArrow(_ask(window, shards), REQUEST).groupBy("kind", "bucket").applyInArrow(
        _repeats, "unit long, kind int, bucket int, vals binary"), "anchors")
    segments = units.groupBy("unit").cogroup(said.groupBy("unit")).applyInArrow(_segments(window, 2 * shards), SEGMENTS)
    found = written(segments.groupBy("shard").applyInArrow(_search(window), "unit long, docs binary, starts binary"), "found")
    done = units.groupBy("unit").cogroup(found.groupBy("unit")).applyInArrow(
        _rewrite(window, to_arrow_type(id_type)),
        f"id {id_type.simpleString()}, n_words long, spans array<struct<start:bigint,end:bigint>>, text string")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(F.col("id").alias(id_col), "n_words", "spans", removed.alias("n_removed"), F.col("text").alias("kept_text"))
