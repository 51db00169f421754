"""Line dedup through levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import SPACES, ascii_lower, written

KEY = ["h1", "h2"]


def line_keys(text: Column) -> Column:
    """The lines' keys, in order; null and empty texts are one empty line."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), lambda l: F.btrim(l, F.lit(SPACES)))


def _hashes(keys: Column, min_chars: int) -> Column:
    """A 96-bit hash of each key of at least ``min_chars`` code points, else null."""
    return F.transform(keys, lambda k: F.when(
        F.char_length(k) >= min_chars,
        F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(k, F.lit(1)).bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("h2"))))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for r in frames[1:]:
        out = out.union(r)
    return out


class LineIndex:
    """Levelled sorted runs of the line hashes seen so far.

    ``split`` merge-anti-joins a batch with every run; what is in none of them is
    fresh and becomes a run of its own through ``add``. When a level holds
    ``fanout`` runs they are compacted into one run of the next level, so a batch
    meets O(fanout * log(batches)) runs, and each hash is rewritten
    O(log(batches)) times. Runs are tables in the shared folder; no hash is in two.
    """

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, []

    def split(self, keys: DataFrame) -> DataFrame:
        """``keys`` (distinct h1, h2, ...) with ``fresh``: in none of the runs.

        An anti-join that keeps both sides: ``keys`` stays partitioned and sorted
        by hash through all of the merge joins."""
        fresh = F.lit(True)
        for i, run in enumerate(r for level in self.levels for r in level):
            keys = keys.join(run.select(*KEY, F.lit(True).alias(f"run{i}")).hint("merge"), KEY, "left")
            fresh = fresh & F.col(f"run{i}").isNull()
        return keys.withColumn("fresh", fresh).drop(*(c for c in keys.columns if c.startswith("run")))

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Add a written run of hashes that no other run holds; compact full levels."""
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = _union([r.select(*KEY) for r in full]).repartition(*KEY).sortWithinPartitions(*KEY)
            self.add(written(merged, f"run-{level + 1}"), level + 1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40,
                min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` (before)
    and ``n_dropped`` (both long; columns of these names are replaced).

    Lines end at \\n; null or empty text is one empty line. A text
    without a dropped line comes back as it is, null too. A line's key is the line with
    ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased. A key of at least
    ``min_chars`` code points held by at least ``min_docs`` rows loses all its lines
    except those of the largest id holding it; the rest stay, joined by \\n. Each row
    counts as a document; rows that repeat the largest id all keep their lines. A
    null id is smaller than any other. Ids may be of any type with an order; those
    that are not whole numbers make one batch. Empty tables give empty tables.

    Method. One pass over the texts writes a (batch, id, hash) table, batches in
    falling order of id. Each batch is reduced to its distinct hashes and
    merge-anti-joined with the levelled runs of :class:`LineIndex`: a hash in no run
    has its largest holder in this batch, all other holders are repeats. Repeats are
    summed over batches, and only the repeats of hashes with enough holders are
    fetched by a join (a hot line's rows can be split there) and grouped by document.
    Texts without a hit are passed on as they are; only the join that brings each
    document its hits shuffles texts.
    """
    spark = docs.sparkSession
    idc = F.col(id_col)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        batches = 1
    span = docs.agg(F.min(id_col), F.max(id_col)).first() if batches > 1 else (None,)
    lines = docs.select(
        idc.alias("id"),
        F.explode(F.array_distinct(F.array_compact(_hashes(line_keys(F.col(text_col)), min_chars)))).alias("h")
    ).select("id", "h.h1", "h.h2")
    if span[0] is None:
        batch = F.lit(0)
    else:
        width = span[1] - span[0] + 1
        batch = F.coalesce(F.floor((F.lit(span[1]).cast("double") - F.col("id")) * batches / width).cast("int"), F.lit(batches - 1))
    lines = written(lines.withColumn("batch", F.least(F.greatest(batch, F.lit(0)), F.lit(batches - 1))), "lines", "batch")

    index, hits = LineIndex(fanout), []
    for b in range(batches):
        keys = lines.where(F.col("batch") == b).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("top"))
        marks = written(index.split(keys).withColumn("hit", F.expr("n > 1 or not fresh")).sortWithinPartitions(*KEY), f"marks-{b}")
        if b + 1 < batches:
            index.add(marks.where("fresh").select(*KEY))
        hits.append(marks.where("hit").select(F.lit(b).alias("batch"), *KEY, "fresh", "n", "top"))
    hits = _union(hits)
    # holders: those of the batch where the hash is fresh (1 if not listed there) and all of later ones
    often = hits.groupBy(*KEY).agg((F.sum("n") + F.when(F.max("fresh"), 0).otherwise(1)).alias("holders")).where(
        F.col("holders") >= min_docs).select(*KEY)
    bad = hits.join(often, KEY).select("batch", *KEY, "fresh", "top")
    gone = (lines.join(bad, ["batch", *KEY]).where(~(F.col("fresh") & F.col("id").eqNullSafe(F.col("top"))))
            .groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct(*KEY)).alias("__gone")))
    plain = docs.drop("n_lines", "n_dropped")
    joined = plain.join(gone, plain[id_col].eqNullSafe(gone["__id"]), "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(text, "\n")
    marked = F.arrays_zip(parts.alias("line"), _hashes(line_keys(text), min_chars).alias("h"))
    kept = F.transform(
        F.filter(marked, lambda x: x["h"].isNull() | ~F.array_contains(F.col("__gone"), x["h"])), lambda x: x["line"])
    out = joined.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    fewer = F.col("__kept").isNotNull() & (F.size("__kept") < n_lines)
    return out.select(
        *(F.when(fewer, F.array_join("__kept", "\n")).otherwise(F.col(c)).alias(c) if c == text_col
          else F.col(c) for c in plain.columns),
        n_lines.alias("n_lines"),
        F.when(fewer, n_lines - F.size("__kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped"))
