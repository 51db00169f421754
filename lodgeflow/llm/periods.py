"""Periodic runs: stretches of words that repeat with a period, by internal pattern matching."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodgeflow.llm.common import word_blocks
from lodgeflow.llm.substring import BitVector

POWER = 3               # periods a run holds at least
LEAST = 24              # words a run holds at least; three of the smallest blocks
_BLOCK = 8              # words of the smallest dyadic block
_BATCH = 3 << 20        # bytes of texts that are indexed together; a longer one is alone


class RangeSuccessor:
    """Wavelet tree over numbers: how many of rows [lo, hi) are below x, and the c-th smallest of them."""

    def __init__(self, values: np.ndarray):
        self.levels, now = [], values
        for bit in range(int(values.max(initial=1)).bit_length() - 1, -1, -1):
            ones = (now >> bit & 1).astype(np.uint8)
            self.levels.append((bit, BitVector(ones), len(now) - int(ones.sum())))
            now = np.concatenate([now[ones == 0], now[ones == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        top = 1 << len(self.levels)
        over, x, count = x >= top, np.minimum(x, top - 1), np.zeros(len(x), np.int64)
        whole = hi - lo
        for bit, ones, zeros in self.levels:
            a, b, up = ones.rank(lo), ones.rank(hi), (x >> bit & 1).astype(bool)
            count += np.where(up, (hi - b) - (lo - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return np.where(over, whole, count)

    def nth(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
        value = np.zeros(len(c), np.int64)
        for bit, ones, zeros in self.levels:
            a, b = ones.rank(lo), ones.rank(hi)
            low = (hi - b) - (lo - a)
            up = c >= low
            c, value = np.where(up, c - low, c), value | up.astype(np.int64) << bit
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + b, hi - b)
        return value


class Repeats:
    """Suffix order of a batch of documents, whose words differ from those of other
    documents. For each length 2^k, the places whose 2^k words stand elsewhere in
    their document too, under a name: the first row of the suffixes that begin so."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        rows, key = np.arange(n), words[order]
        rank = np.empty(n, np.int64)
        self.places, self.names, self.blocks = [], [], []
        step = 1
        while True:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(rows) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(rows)])
            rank[order[rows]] = np.repeat(rows[first], size)
            many = np.repeat(size > 1, size)
            size, rows = np.repeat(size, size)[many], rows[many]
            if not len(rows):
                break
            live = order[rows]
            if step >= _BLOCK:
                on = live % step == 0
                self.blocks.append((step, live[on], rank[live[on]], size[on]))
                if step == _BLOCK:
                    self.rows = rows                     # all rows that longer blocks can name
            at = np.sort(live)
            self.places.append(at.astype(np.int32))
            self.names.append(rank[at].astype(np.int32))
            then = live + step
            key = rank[live] * (n + 1) + np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
            by = np.argsort(key, kind="stable")
            key = key[by]
            order[rows] = live[by]
            step *= 2
        self.order = order

    def _named(self, k: int, at: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.places[k], at), len(self.places[k]) - 1)
        return np.where(self.places[k][i] == at, self.names[k][i], -1)

    def alike(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Words from a on that equal those from b on; or before a, those before b."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.places) - 1, -1, -1):
            off = -done - (1 << k) if back else done
            x, y = self._named(k, a + off), self._named(k, b + off)
            done += ((x == y) & (x >= 0)).astype(np.int64) << k
        return done


def _candidates(text: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, b, L): the L words from b on stand q later too. A run of period q and three
    periods or more holds such a block, with q below 2 L, and from L on but for the
    smallest. A block's occurrences that begin within half its length of each other
    form a progression, told by the first, the second and their number."""
    tree = RangeSuccessor(text.order[text.rows])
    out = []
    for size, b, lo, n in text.blocks:
        lo = np.searchsorted(text.rows, lo)
        hi = lo + n
        edges = [1, 5, 9, 13, 16] if size == _BLOCK else [size, size * 3 // 2, size * 2]
        counts = [tree.below(lo, hi, b + e) for e in edges]
        for c, d in zip(counts, counts[1:]):
            on = np.flatnonzero(d > c)
            first, m = tree.nth(lo[on], hi[on], c[on]), (d - c)[on]
            two = m > 1
            step = np.ones(len(on), np.int64)
            step[two] = tree.nth(lo[on][two], hi[on][two], c[on][two] + 1) - first[two]
            if size > _BLOCK:                            # nothing but repeats of a shorter period up to there: not the smallest one
                last = first + (m - 1) * step
                before = counts[0][on] * 0 + d[on] - tree.below(lo[on], hi[on], b[on] + 1)
                same = two & (step * 4 <= size) & ((last - b[on]) % step == 0) & (before * step == last - b[on])
                on, first, step, m = on[~same], first[~same], step[~same], m[~same]
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            start = np.repeat(b[on], m)
            out.append((np.repeat(first, m) + j * np.repeat(step, m) - start, start, np.full(len(j), size)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def find_runs(words: np.ndarray, power: int = POWER, least: int = LEAST) -> np.ndarray:
    """(start, length, period) rows, in order, of all runs in a batch of documents."""
    text = Repeats(words)
    if not text.blocks:
        return np.zeros((0, 3), np.int64)
    q, b, size = _candidates(text)
    order = np.lexsort((b, q, size))
    q, b, size = q[order], b[order], size[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (size[1:] != size[:-1]) | (b[1:] != b[:-1] + size[:-1])] if len(q) else np.zeros(0, bool)
    first = np.flatnonzero(new)                          # neighbouring blocks that repeat at the same distance are one stretch
    last = np.r_[first[1:], len(q)] - 1 if len(q) else first
    q, start, end = q[first], b[first], b[last] + size[last]
    start, end = start - text.alike(start, start + q, back=True), end + q + text.alike(end, end + q)
    held = end - start >= np.maximum(least, power * q)
    q, start, end = q[held], start[held], end[held]
    order = np.lexsort((q, end, start))
    q, start, end = q[order], start[order], end[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(q)]   # the smallest period of each
    return np.stack([start[new], end[new] - start[new], q[new]], axis=1)


class _Batch:
    """Texts as numbers of their words; words of different documents never are alike."""

    def __init__(self):
        self.names: dict[bytes, int] = {}
        self.size, self.ids, self.texts = 0, [], []

    def add(self, key, data: bytes) -> None:
        names = self.names
        blocks = [np.fromiter([names.setdefault(w, len(names)) for w in words], np.int32, len(words)) for words in word_blocks(data)]
        self.texts.append(np.concatenate([*blocks, np.zeros(0, np.int32)]))
        self.ids.append(key)
        self.size += len(data)

    def judged(self, power: int, least: int) -> Iterator[tuple]:
        """(id, words, runs as rows, collapsed text) of each text."""
        ends = np.cumsum([len(t) for t in self.texts])
        flat = np.concatenate(self.texts).astype(np.int64) + np.repeat(np.arange(len(ends)), [len(t) for t in self.texts]) * len(self.names)
        runs = find_runs(flat, power, least)
        cut = np.searchsorted(runs[:, 0], ends)
        words = np.array([*self.names, b""], object)
        for i, (key, t, end) in enumerate(zip(self.ids, self.texts, ends)):
            mine = runs[cut[i - 1] if i else 0:cut[i]] - [end - len(t), 0, 0]
            keep = np.zeros(len(t) + 1, np.int64)
            np.add.at(keep, mine[:, 0] + mine[:, 2], 1)
            np.add.at(keep, mine[:, 0] + mine[:, 1], -1)
            kept = t[np.cumsum(keep[:-1]) == 0]
            yield key, len(t), mine, b" ".join(b" ".join(words[kept[a:a + 65536]]) for a in range(0, len(kept), 65536))


def _best(runs: np.ndarray) -> int:
    return max(range(len(runs)), key=lambda i: (Fraction(int(runs[i, 1]), int(runs[i, 2])), -runs[i, 0], -runs[i, 2]))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, power: int = POWER, least: int = LEAST) -> DataFrame:
    """(id_col, n_words, runs, best, collapsed_text) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch of words with
    smallest period q (words q apart are identical) of at least ``least`` words and
    ``power`` periods that no neighbouring word extends keeping q. ``runs`` holds
    (start, length, period) of all of them by start, then period; ``best`` the one of
    most periods (ties: smallest start, then period), null without runs. A word is
    dropped from collapsed_text if a run contains it after that run's first q words; the
    others stay, joined by one space. ``power`` is 3 or more and ``least`` 24 or more: the
    smallest blocks find nothing shorter.

    Null and blank texts have no words and no runs; their collapsed_text is empty. Rows
    are judged alone: repeated rows and ids, and rows without an id, each return a row.
    An empty table returns no rows. Other columns are ignored. A very long text is
    indexed alone, at about 100 bytes a word.

    Method. The words of some texts are sorted by prefix doubling; words of different
    texts never compare equal. On the way, for L = 8, 16, ..., the aligned blocks of L
    words that stand elsewhere in their text are noted as intervals of the suffix
    order. A wavelet tree over it answers range successor queries: where a block occurs
    next in windows of half its length, L to 2 L words on. Each window's occurrences are
    a progression, and its distances are candidate periods. Stretches of equal
    candidates are extended by the names of doubled lengths, and stand if long enough.
    Nothing is shuffled: skew between documents does not matter.
    """
    if power < 3 or least < 3 * _BLOCK:
        raise ValueError("power must be 3 or more, and least 24 or more")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Batch()

        def flush() -> pa.RecordBatch:
            rows = list(held.judged(power, least))
            as_rows = lambda runs: [dict(zip(("start", "length", "period"), r)) for r in runs.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], to_arrow_type(kind)), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([as_rows(r[2]) for r in rows], pa.list_(run_type)),
                 pa.array([as_rows(r[2][_best(r[2])][None])[0] if len(r[2]) else None for r in rows], run_type),
                 pa.array([r[3].decode() for r in rows], pa.string())], ["id", "n_words", "runs", "best", "collapsed_text"])

        for b in batches:
            for key, text in zip(b.column("id").to_pylist(), b.column("text")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if held.ids and held.size + len(data) > _BATCH:
                    yield flush()
                    held = _Batch()
                held.add(key, data)
        if held.ids:
            yield flush()

    row = "struct<start:bigint,length:bigint,period:bigint>"
    done = narrow.mapInArrow(run, f"id {kind.simpleString()}, n_words long, runs array<{row}>, best {row}, collapsed_text string")
    return done.withColumnRenamed("id", id_col)
