"""Embedding near-dedup: spherical k-means cells chosen by exact bounds, blocked cosine products inside cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import written
from lodgeflow.llm.components import connected_components

FIT_ROWS = 16_384      # vectors the cells are fitted on, at most
BLOCK = 4096           # vectors of a block; a task compares two blocks
_ROUNDS = 12
_CHUNK = 256           # vectors of a block multiplied at a time
_SLACK = 1e-6          # added to every bound, far above the rounding of a product


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """k unit centroids of unit vectors by Lloyd's rounds, from evenly spaced rows; the same for the same rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(_ROUNDS):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def _angle(dot: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dot, -1, 1))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *,
                 threshold: float = 0.93, fit_rows: int = FIT_ROWS, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``df``.

    Two rows are compared if their labels are equal and not null and their vectors are
    of one length; they link at a cosine of ``threshold`` or more in double precision.
    Vectors that are null, empty, zero or hold a null or non-finite component, and rows
    without an id or a label, link with nothing. n_links counts the other rows linked
    directly, copies too; component_id is the smallest id reachable, itself included;
    kept: it is its component's own. Repeated rows each return a row and link with each
    other. An empty table returns no rows. Other columns are ignored.

    Method. Exact copies (label and vector) collapse to one class with its number of
    rows, so they never pair up. Spherical k-means, fitted on at most ``fit_rows``
    classes of smallest hash, gives cells, about one a ``block`` of the largest label.
    A class lives in the cell of its nearest centroid and visits every cell before its
    own that may hold a link of it: one whose centroid is no farther away than the
    cell's largest member angle and the threshold's together, and whose border with
    its own cell is no farther than two linked vectors are. Both bounds are exact, so
    each pair is compared, in the first of its two cells. Members and visitors of a
    cell are dealt into blocks by hash; each pair of blocks with members in it is a
    task's matrix product. A task returns at most one row a class: its number of links
    and one link towards the smallest class it reaches there. ``probes`` (cells to
    visit, once) is accepted and has no effect: no cell is left out by count.
    """
    good = (F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("v", F.when(F.col("good"), F.col("v")))
    key = [F.when(F.col("good"), F.xxhash64(F.lit(i), "label", F.size("v"), "v")).alias(f"k{i}") for i in range(2)]
    named = rows.select("id", *key)
    classes = written(rows.where("good").select("id", *key, "label", "v").groupBy("k0", "k1").agg(
        F.min("id").alias("cid"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v")), "classes")

    sample = classes.select("v").orderBy(F.xxhash64("k0", F.lit(7)), "k0", "k1").limit(fit_rows).collect()   # bounded by fit_rows
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r.v), []).append(r.v)
    most = classes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    k = max(1, min(fit_rows // 8, math.ceil(most / block)))
    cells = {d: spherical_kmeans(unit(np.array(v)), max(1, k * len(v) // len(sample))) for d, v in by_size.items()}

    def by_length(vs: list) -> Iterator[tuple]:
        size = np.array([len(v) for v in vs])
        for d in set(size.tolist()) & set(cells):            # lengths that the sample lacks have one cell
            at = np.flatnonzero(size == d)
            yield d, at, unit(np.array([vs[i] for i in at])) @ cells[d].T

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, dot in by_length(b.column("v").to_pylist()):
                # a near tie may fall to either cell when the product is taken again
                r, c = np.nonzero(dot >= dot.max(axis=1, keepdims=True) - _SLACK)
                wide = np.full(dot.shape[1], -1.0)
                np.maximum.at(wide, c, _angle(dot[r, c]))
                used = np.flatnonzero(wide >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array(wide[used])], ["d", "cell", "wide"])

    # one row a cell
    spans = (classes.select("v").mapInArrow(spread, "d int, cell int, wide double").groupBy("d", "cell").agg(F.max("wide").alias("wide"))
             .collect() if k > 1 else [])
    wide = {d: np.full(len(c), -1.0 if k > 1 else math.pi) for d, c in cells.items()}
    for r in spans:
        wide[r.d][r.cell] = r.wide
    reach = math.acos(max(-1.0, min(1.0, threshold))) + _SLACK
    chord = 2 * math.sin(reach / 2) + _SLACK

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vs = b.column("v").to_pylist()
            home = np.zeros(len(vs), np.int32)
            near = [[0]] * len(vs)
            for d, at, dot in by_length(vs):
                c = cells[d]
                own = np.argmax(dot, axis=1)
                top = dot[np.arange(len(at)), own]
                apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))
                visit = ((_angle(dot) <= wide[d] + reach) & (top[:, None] - dot <= apart[own] * chord + _SLACK)
                         & (np.arange(len(c)) < own[:, None]))
                visit[np.arange(len(at)), own] = True
                home[at] = own
                for i, row in zip(at, visit):
                    near[i] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays(
                [b.column("cid"), b.column("mult"), b.column("label"), b.column("v"), pa.array(home, pa.int32()),
                 pa.array(near, pa.list_(pa.int32()))], ["cid", "mult", "label", "v", "home", "near"])

    kind = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    placed = classes.select("cid", "mult", "label", "v").mapInArrow(
        assign, f"cid {kind['cid']}, mult long, label {kind['label']}, v array<double>, home int, near array<int>")
    placed = (placed.select("cid", "mult", "label", "v", "home", F.size("v").alias("d"), F.explode("near").alias("cell"))
              .withColumn("lives", F.col("home") == F.col("cell")))
    space = ["label", "d", "cell"]
    many = written(placed.groupBy(*space).agg(F.ceil(F.count_if("lives") / block).cast("int").alias("mine"),
                                              F.ceil(F.count_if(~F.col("lives")) / block).cast("int").alias("guests")), "cells")
    deal = F.xxhash64("cid")
    own = F.when(F.col("lives"), F.pmod(deal, F.col("mine"))).otherwise(F.col("mine") + F.pmod(deal, F.col("guests"))).cast("int")
    last = F.when(F.col("lives"), F.col("mine") + F.col("guests")).otherwise(F.col("mine")) - 1
    tasks = (placed.join(many, space).where("mine > 0").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
             .select("cid", "mult", "v", *space, "own", F.least("own", "other").alias("b0"), F.greatest("own", "other").alias("b1")))
    schema = f"cid {kind['cid']}, n long, root {kind['cid']}"
    found = written(tasks.groupBy(*space, "b0", "b1").applyInArrow(_compare(threshold), schema), "vector-links")

    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    of = (classes.select("k0", "k1", "cid", "mult").join(links, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
          .select("k0", "k1", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("links"), F.coalesce("root", "cid").alias("root")))
    out = named.join(of, ["k0", "k1"], "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id").eqNullSafe(component)).alias("kept"))


def _compare(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        order = np.argsort(cid, kind="stable")
        cid, mult, own = cid[order], table.column("mult").to_numpy()[order], table.column("own").to_numpy()[order]
        x = unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(len(cid), -1))[order]
        b0, b1 = table.column("b0")[0].as_py(), table.column("b1")[0].as_py()
        rows, cols = np.flatnonzero(own == b0), np.flatnonzero(own == b1)
        y = x[cols].T
        count, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
        for i in range(0, len(rows), _CHUNK):
            at = rows[i:i + _CHUNK]
            ok = x[at] @ y >= threshold
            if b0 == b1:
                ok[np.arange(len(at)), np.arange(i, i + len(at))] = False
            if not ok.any():
                continue
            r, c = np.nonzero(ok)
            r, c = at[r], cols[c]
            np.add.at(count, r, mult[c])
            if b0 != b1:                                  # inside a block each pair is met from both ends
                np.add.at(count, c, mult[r])
            _merge(label, r, c)
        at = np.flatnonzero(count)
        kind = table.schema.field("cid").type
        return pa.table({"cid": pa.array(cid[at], kind), "n": pa.array(count[at]), "root": pa.array(cid[label[at]], kind)})

    return run


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each a and b in ``label``, where every entry names its component's smallest."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]
