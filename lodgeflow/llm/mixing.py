"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodgeflow.llm.common import n_words, written
from lodgeflow.operators.rank import global_rank

#: Base weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: For each base weight, the factor of the weight over training time, as (time, factor)
#: points joined by straight lines: the first sources early, the last ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.2), (0.5, 0.8), (1.0, 2.0)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size, ...) with class and target added.

    Sources take ``weights`` in code point order, null last, repeating; class is
    the index of the weight. All words are shared by weight; a target stops at ``cap``
    times its source's size, and what exceeds it is shared among the others by
    weight until none is above. The rounds work on one level, the words a unit of
    weight gets: a source is full if its cap over its weight is below the level. The
    level rises as long as a round fills a source, so the rounds end.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("class") + 1)
    s = (global_rank(sizes, [F.col("source").asc_nulls_last()], "rank")
         .withColumn("class", F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")).withColumn("weight", weight))
    full = F.col("source_size") * F.lit(float(cap)) / F.col("weight")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        open_w, closed = s.agg(F.sum(F.when(full > level, F.col("weight"))), F.sum(F.when(full <= level, F.col("source_size")))).first()
        new = (total - cap * (closed or 0)) / open_w if open_w else level
        if new <= level:
            break
        level = new
    target = F.when(full <= level, F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * F.lit(level))
    return s.withColumn("target", target.cast("double"))


def position(share: Column, cls: Column, schedules=SCHEDULES) -> Column:
    """Training time in [0, 1] at which a source has spent ``share`` of its target.

    The integral of a class's schedule is its cumulative demand; inside each
    straight piece of the schedule the demand is a parabola, inverted in closed form.
    """
    out = F.lit(None).cast("double")
    for c, points in enumerate(schedules):
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:]))
        spent, time = 0.0, F.lit(float(points[-1][0]))
        pieces = []
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            area = (t1 - t0) * (w0 + w1) / 2
            slope = (w1 - w0) / (t1 - t0)
            rest = share * F.lit(whole) - F.lit(spent)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * slope), F.lit(0.0)))
            pieces.append(((spent + area) / whole, F.lit(t0) + F.least(F.lit(t1 - t0), 2 * rest / (F.lit(w0) + root))))
            spent += area
        for end, value in reversed(pieces):
            time = F.when(share < F.lit(end), value).otherwise(time)
        out = F.when(cls == c, time).otherwise(out)
    return out


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
               weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, cap: int = 3) -> DataFrame:
    """(id_col, size, source, source_size, target, taken, positions array<double>) for every row.

    size is the number of words; ``positions`` has one training time in [0, 1) for
    each time the document is taken, 0 to ``cap`` times; taken = size * times. A
    source is read in a fixed random order of its ids, over and over; a copy is taken
    if its middle word comes before the source's target, so the taken words are within
    half a document of the target. Reruns agree; rows with equal id, source and size
    are interchangeable. Null and empty texts have size 0, take part in their source
    and are never taken; a null source is a source of its own; a row without an id is
    ordered by its text. An empty table returns no rows. Other columns are ignored.

    Method. Sizes sum to one row a source and target weights to its target. A source's
    cumulative token demand is its target times the integral of its weight schedule;
    inverting it at a copy's place in the source's stream gives the copy's training
    position. The places are prefix sums in two levels: sums of hash buckets inside a
    source, then documents inside a bucket, so a source with most rows is spread over
    all buckets.
    """
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("")))
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))     # null is a name too
    d = written(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), name.alias("name"), n_words(F.col(text_col)).alias("size"),
        key.alias("key"), F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("bucket")), "sizes")
    sums = d.groupBy("name", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    targets = written(source_targets(sums.groupBy("name").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")),
                                     weights, cap).select("name", "class", "source_size", "target"), "targets")
    before = F.coalesce(F.sum("bucket_size").over(W.partitionBy("name").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heads = sums.select("name", "bucket", before.alias("before")).join(targets, "name")
    inside = F.coalesce(F.sum("size").over(
        W.partitionBy("name", "bucket").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    j = d.withColumn("inside", inside).join(heads, ["name", "bucket"])
    copies = F.array(*map(F.lit, range(int(cap))))
    middle = lambda e: e * F.col("source_size") + F.col("before") + F.col("inside") + F.col("size") / 2
    times = F.transform(F.filter(copies, lambda e: (F.col("size") > 0) & (middle(e) < F.col("target"))),
                        lambda e: position(middle(e) / F.col("target"), F.col("class"), schedules))
    return j.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target",
                    times.alias("positions")).withColumn("taken", F.col("size") * F.size("positions"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``docs`` in training order: each document as often as it is taken, with
    ``mix_position``, range-sorted by it (ties by id). Rows that share an id and
    a source are one document and come together. A column ``mix_position`` of ``docs`` is
    replaced; all others, whatever their names, come back as they are."""
    plan = curriculum(docs, id_col, text_col, source_col, **kw)
    taken = (plan.where(F.size("positions") > 0).select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "positions")
             .groupBy("id", "source").agg(F.max("positions").alias("positions")))
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("doc_source"), F.struct(*(c for c in docs.columns if c != "mix_position")).alias("doc"))
    same = whole["doc_id"].eqNullSafe(taken["id"]) & whole["doc_source"].eqNullSafe(taken["source"])
    each = whole.join(taken, same).select("doc_id", "doc", F.explode("positions").alias("mix_position"))
    return each.orderBy("mix_position", F.col("doc_id").asc_nulls_last()).select("doc.*", "mix_position")
