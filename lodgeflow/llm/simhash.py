"""SimHash near-dedup through an inverted index on byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import word_blocks, written
from lodgeflow.llm.components import connected_components

SEED = 42
POSITIONS = 8          # bytes of a fingerprint
DENSE = 1024           # lists up to this size are compared as one block


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash: a bit is 1 if more than half of the shingle hashes set it."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode().lower()):
        words = tail + words
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))),
                            repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
        tail = words[max(0, len(words) - shingle + 1):] if shingle > 1 else []
    if n == 0:
        if not tail:
            return 0
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(tail), SEED)).view(np.int64))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp) of every row."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps, pa.int64())], ["id", "fp"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3,
                       max_bits: int = 2) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; two fingerprints
    link at ``max_bits`` or fewer differing bits (0 to 2), and component_id is the
    smallest id reachable over links. Null, empty and blank texts have fingerprint
    zero and link like any other. A row with a null id links too but gives its
    component no id; component_id is null where no member has one. Repeated rows
    each return a row. An empty table returns none. Other columns are ignored.

    Method. Copies collapse to one row per distinct fingerprint. A fingerprint is
    posted in the index by the values of its bytes. Two that differ in at most
    ``max_bits`` bits share at least ``8 - max_bits`` positional bytes, so instead
    of tallying single-byte postings (each holds 1/256 of all fingerprints, and
    their pairs grow with the square), the index holds the intersections of that
    many postings: a pair meets in a list just when its tally reaches the
    guaranteed minimum. A list differs in ``max_bits`` bytes only, so it has at most
    256**max_bits members whatever the input. In each list the tally is counted,
    the bit distance verified, and at most one link a member emitted.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    masks = [sum(255 << 8 * p for p in at) for at in combinations(range(POSITIONS), POSITIONS - max_bits)]
    posted = classes.select("fp", F.posexplode(F.array(*(
        F.col("fp").bitwiseAND(F.lit(int(np.uint64(m).view(np.int64)))) for m in masks))).alias("at", "key"))
    lists = posted.repartition("at", "key").sortWithinPartitions("at", "key", "fp")
    links = lists.select("at", "key", "fp").mapInArrow(_links(max_bits), "a long, b long")
    roots = connected_components(links)
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labels = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of = labelled.select("fp", "root").join(labels, "root").select("fp", "component_id")
    return fps.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id, all
    columns unchanged. Rows that share an id are one document. Rows without an id
    stay: nothing names them."""
    kept = (simhash_components(docs, id_col, text_col, shingle=shingle, max_bits=max_bits)
            .where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct())
    return docs.join(kept, docs[id_col] == kept["__gone"], "left_anti")


def _links(max_bits: int):
    """Over sorted postings: for each list, links that join what it verifies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            if b is None:
                now, cut = held, None if held is None else len(held[0])
            else:
                now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                if held is not None:
                    now = [np.concatenate(x) for x in zip(held, now)]
                if not len(now[0]):
                    continue
                last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])   # the last list may go on in the next batch
                cut = len(last) - int(last.sum())
                held = [x[cut:] for x in now]
            if not cut:
                continue
            at, key, fp = (x[:cut] for x in now)
            fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1])])
            size = np.diff(np.r_[fresh, cut])
            two = fresh[size == 2]
            found = [_near(fp[two], fp[two + 1], max_bits)]
            found += [_within(fp[i:i + n], max_bits) for i, n in zip(fresh[size > 2], size[size > 2])]
            pairs = np.unique(np.concatenate(found), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Count filter, then verification: shared positional bytes, then differing bits."""
    x = np.ascontiguousarray(a ^ b)
    tally = (x.view(np.uint8).reshape(*x.shape, POSITIONS) == 0).sum(axis=-1)
    return (tally >= POSITIONS - max_bits) & (np.bitwise_count(x.view(np.uint64)) <= max_bits)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    ok = _linked(a, b, max_bits)
    return np.stack([a[ok], b[ok]], axis=1)


def _within(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """One link a member to the smallest one it reaches within its list."""
    label = np.arange(len(fp))
    if len(fp) <= DENSE:
        links = _linked(fp[:, None], fp[None, :], max_bits)
        step = lambda at: np.where(links, at[None, :], len(fp)).min(axis=1)
    else:                                # look the few possible partners up instead of comparing all
        free = int(np.bitwise_or.reduce(fp ^ fp[0]))
        bits = [1 << i for i in range(64) if free >> i & 1]
        flips = [sum(c) for k in range(1, max_bits + 1) for c in combinations(bits, k)]
        ends = []
        for f in flips:
            to = fp ^ np.uint64(f).view(np.int64)
            j = np.minimum(np.searchsorted(fp, to), len(fp) - 1)
            i = np.flatnonzero(fp[j] == to)
            ok = _linked(fp[i], fp[j[i]], max_bits)
            ends.append(np.stack([i[ok], j[i][ok]]))
        i, j = np.concatenate(ends, axis=1)

        def step(at: np.ndarray) -> np.ndarray:
            out = at.copy()
            np.minimum.at(out, i, at[j])
            return out
    while True:
        new = step(label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(fp)))
    return np.stack([fp[own], fp[label[own]]], axis=1)
