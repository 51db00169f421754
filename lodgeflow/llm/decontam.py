"""Benchmark decontamination: a prefix-filtered set join of item windows against documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.llm.common import ascii_lower, written

BREAK_RE = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
END = ""               # stands behind a document's last word; no word is empty


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null has none."""
    body = F.btrim(ascii_lower(text), F.lit(_BREAKS))
    return F.when(F.octet_length(body) > 0, F.split(body, BREAK_RE)).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str, text_col: str, window: int) -> DataFrame:
    """(item, win, gram, len): each item's windows; ``win`` names equal windows of all items."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    grams = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("gram"))
    return grams.select("item", F.sha2(F.array_join("gram", " "), 256).alias("win"), "gram", F.size("gram").alias("len")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                  item_id: str = "item_id", item_text: str = "text", window: int = 13, share: int = 20,
                  block: int = 20_000) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, item_ids array<string>, contaminated) for every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but
    not none, is one window. A document word inside any occurrence of a window is
    hit; n_items counts the items with occurring windows, item_ids are those, sorted
    as strings. contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty
    texts have no words; items without words have no windows; an item without an id
    counts hits but no item. Repeated rows each return a row. Empty tables: no rows,
    or no hits. Other columns are ignored.

    Method. A window's shingles are its words, ordered by rarity in the documents. As
    containment must be whole, the necessary prefix is the rarest word alone, and a
    document that lacks it cannot hold the window. Documents' words are joined with
    the prefix words; the word's offset in the window bounds the start, the window's
    length must fit, and the words at that place are compared exactly. Windows come
    in blocks of ``block``; a block (one row of at most ``window`` words a window, and
    its name) is what is broadcast, so its size is bounded whatever the benchmark's
    and however many items share a window: their ids meet a document's windows in a
    join afterwards. All documents pass every block; of the documents only hits and
    word counts are shuffled.
    """
    spark = docs.sparkSession
    held = written(item_windows(items, item_id, item_text, window), "windows")
    grams = written(held.select("win", "gram", "len").distinct(), "grams")
    body = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), words(F.col(text_col)).alias("w"))

    # rarity: how often the items' words occur in the documents
    asked = grams.select(F.explode("gram").alias("word")).distinct()
    seen = body.select(F.explode("w").alias("word"))
    small = grams.count() * window <= 2_000_000
    often = seen.join(F.broadcast(asked) if small else asked, "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    often = written(often, "word-counts")              # a row a word of the items: as many as were asked for at most
    ranked = grams.select("win", "gram", "len", F.posexplode("gram").alias("at", "word")).join(F.broadcast(often) if small else often, "word", "left")
    prefix = written(
        ranked.groupBy("win").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "at")).alias("p"), F.first("gram").alias("gram"),
                                  F.first("len").alias("len")).where("p.often > 0").select("win", "gram", "len", "p.word", "p.at"), "prefixes")
    n_blocks = max(1, -(-prefix.count() // block))

    found = None
    for b in range(n_blocks):
        mine = prefix.where(F.pmod(F.xxhash64("win"), F.lit(n_blocks)) == b)
        if b == 0:                                   # each document is found once by its end mark
            mark = spark.range(1).select(F.lit("").alias("win"), F.array().cast("array<string>").alias("gram"), F.lit(0).alias("len"),
                                         F.lit(END).alias("word"), F.lit(0).alias("at"))
            mine = mine.union(mark)
            pos = body.select("id", "t", "w", F.posexplode(F.array_append("w", F.lit(END))).alias("pos", "word"))
        else:
            pos = body.select("id", "t", "w", F.posexplode("w").alias("pos", "word"))
        start = F.col("pos") - F.col("at")
        hit = pos.join(F.broadcast(mine), "word").where(
            (start >= 0) & (start + F.col("len") <= F.size("w"))
            & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("gram")))
        part = hit.select("id", "t", start.cast("long").alias("start"), F.col("len").cast("long").alias("len"), "win")
        found = part if found is None else found.union(part)
    # an end mark has length 0; its start is the number of words
    doc = written(found.groupBy("id", "t").agg(
        F.count_if(F.col("len") == 0).alias("copies"), F.max(F.when(F.col("len") == 0, F.col("start"))).alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("len") > 0, F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("spans"),
        F.collect_set(F.when(F.col("len") > 0, F.col("win"))).alias("wins")), "hits")
    names = (doc.select("id", "t", F.explode("wins").alias("win")).join(held.where("item is not null").select("win", "item"), "win")
             .groupBy(F.col("id").alias("hit_id"), F.col("t").alias("hit_t")).agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    doc = (doc.join(names, F.col("id").eqNullSafe(F.col("hit_id")) & F.col("t").eqNullSafe(F.col("hit_t")), "left")
           .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"),
                              (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")))["n"]
    return (doc.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids",
                    ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the contaminated ones, all columns unchanged. Rows that share
    an id go together; rows without an id stay."""
    gone = decontaminate(docs, items, id_col, **kw).where("contaminated").select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
