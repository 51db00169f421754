"""Source divergence audit: which sources of a language differ, and by which terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgeflow.llm.common import written

#: Lowers A-Z, keeps a-z and all bytes of other code points, blanks the rest of ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_BLOCK = 1 << 20
_FLUSH = 250_000        # sums a task holds before it sends them on
_CELLS = 2_000_000      # numbers of a matrix of terms and sources
_BUCKET = 100_000       # term and source sums a bucket gets, about


def term_counts(data: bytes) -> Counter:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text with A-Z lowered, block by block."""
    seen, rest = Counter(), b""
    for pos in range(0, len(data), _BLOCK):
        head, gap, tail = data[pos:pos + _BLOCK].translate(_TABLE).rpartition(b" ")
        if gap:
            seen.update((rest + head).split())
            rest = tail
        else:
            rest += tail
    seen.update(rest.split())
    return seen


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group and term: occurrences and documents, summed within the task."""
    sums: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in sums.items():
            n = len(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(count), pa.binary()),
                 pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        sums.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
            seen = term_counts(text.as_buffer().to_pybytes())
            if not seen:
                continue
            count, docs = sums.setdefault((lang, source), (Counter(), Counter()))
            held -= len(count)
            count.update(seen)
            docs.update(seen.keys())
            held += len(count)
            if held > _FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def _pair_sums(cells: pa.Table, groups: pa.Table) -> pa.Table:
    """A bucket of a language's terms: the difference of each two of its sources, summed over them."""
    groups = groups.sort_by("source")
    names = groups.column("source").combine_chunks()
    zero = groups.column("zero").to_numpy()
    size = len(names)
    sums = np.zeros((size, size), np.int64)
    if cells.num_rows and size:
        row = cells.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        col = pc.index_in(cells.column("source").combine_chunks(), value_set=names).to_numpy()
        order = np.argsort(row, kind="stable")
        row, col, p = row[order], col[order], cells.column("p").to_numpy()[order]
        step = max(1, _CELLS // size)
        for a in range(0, int(row[-1]) + 1, step):
            cut = slice(*np.searchsorted(row, [a, a + step]))
            m = np.tile(zero, (min(step, int(row[-1]) + 1 - a), 1))
            m[row[cut] - a, col[cut]] = p[cut]
            for i in range(size - 1):
                d, both = m[:, i + 1:] - m[:, i:i + 1], m[:, i + 1:] + m[:, i:i + 1]
                sums[i, i + 1:] += (d * d // both).sum(axis=0)
    i, j = np.triu_indices(size, 1)
    lang = groups.column("lang").combine_chunks().take(pa.array(i, pa.int64())) if size else pa.array([], pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(i, pa.int64())), "item": names.take(pa.array(j, pa.int64())),
                     "value": pa.array(sums[i, j], pa.int64())})


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, min_docs: int = 10,
               smooth: int = 2, scale: int = 10 ** 9, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of the sources of each language.

    Null texts, languages and sources count as ''. A language keeps its V terms in at
    least ``min_docs`` of its rows. A group (lang, source), and each language, gives a
    kept term p = 1 + floor(scale * (count + smooth) / (N + smooth * V)), N being the
    count of all kept terms there. Two such values differ by floor((p - q)^2 / (p + q)).
    Part ``pair``: each other source of the language (item), the difference summed over
    all kept terms, 0 where none is kept. Part ``term``: the ``top`` kept terms a group
    has more of than its language (count > 0, p > q), by difference. Ranks run by value
    descending, then item ascending by bytes. All whole numbers, none rounded.

    Repeated rows each count. Empty texts give no terms, but their group has its pairs.
    An empty table returns no rows. Other columns are ignored, whatever their names.

    Method. Texts are lowered and blanked by one ``bytes.translate`` a block and split;
    a Counter per document gives its terms' occurrences and that it holds them. Tasks
    sum both by group before the shuffle, so a term or source that fills a third of the
    corpus sends one row a task. One exchange by (lang, term) serves the sums, the
    document frequency and the language's count. Pairs are summed in buckets of terms
    over a matrix of terms and sources; a bucket sends one number a pair, as the
    result holds one a pair too.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    spark = docs.sparkSession
    narrow = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    by_term = Window.partitionBy("lang", "term")
    cells = (narrow.mapInArrow(_tally, "lang string, source string, term binary, n long, docs long").repartition("lang", "term")
             .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
             .withColumn("total", F.sum("n").over(by_term)).withColumn("in_docs", F.sum("docs").over(by_term))
             .withColumn("first", F.col("source") == F.min("source").over(by_term)).where(F.col("in_docs") >= min_docs))
    cells = written(cells.select("lang", "source", "term", "n", "total", "first"), "terms")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = cells.groupBy("lang").agg(F.count_if("first").alias("kinds"), F.sum("n").alias("lang_size"))
    groups = written(narrow.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
                     .na.fill(0, ["size", "kinds", "lang_size"]), "groups")

    def share(n: Column, size: str) -> Column:
        """In decimals: scale * n outgrows 64 bits."""
        wide = lambda c: c.cast("decimal(19,0)")
        return F.lit(1) + F.call_function("div", F.lit(scale).cast("decimal(19,0)") * wide(n + smooth), wide(F.col(size) + smooth * F.col("kinds")))

    rated = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), "size"))
    p, q = F.col("p"), F.col("q")
    terms = (rated.withColumn("q", share(F.col("total"), "lang_size")).where(p > q)
             .select("lang", "source", F.lit("term").alias("part"), "term", F.call_function("div", (p - q) * (p - q), p + q).alias("value")))
    by_group = Window.partitionBy("lang", "source")
    terms = (terms.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= top)
             .withColumn("item", F.col("term").cast("string")))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cells.count() // _BUCKET)
    left = rated.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "term", "source", "p")
    right = (groups.where("kinds > 0").withColumn("zero", share(F.lit(0), "size"))
             .select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket"), "source", "zero"))
    sums = (left.groupBy("lang", "bucket").cogroup(right.groupBy("lang", "bucket"))
            .applyInArrow(_pair_sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"),
                       "value").select("lang", "x.source", "x.item", "value")
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = (groups.select("lang", "source").join(other, "lang").where(F.col("source") != F.col("item"))
             .join(both, ["lang", "source", "item"], "left").na.fill(0, ["value"])
             .withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair")))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*cols).union(terms.select(*cols))
