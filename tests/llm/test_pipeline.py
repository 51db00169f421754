"""The stages on a small table with planted cases, and the registration."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
import __spark_entry__ as E

WORDS = [f"w{i}" for i in range(400)]


def test_registered():
    names = set(E.queries())
    assert "pipeline" in names and [n for n, _ in P.STAGES] == [
        "quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources"]


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(3)
    clean = lambda n=120: ". ".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n // 8))
    docs = [(i, clean(), "en", f"s{i % 3}", 1) for i in range(60)]
    toxic = [(100 + i, clean() + " vile scum" + clean(), "en", "s0", 1) for i in range(40)]
    items = [(0, clean(40))]
    copy = (200, docs[7][1], "fr", "s1", 1)
    dirty = (201, clean(40) + " " + items[0][1].upper(), "en", "s2", 1)
    line = "a line that many documents of this table hold in common"
    lined = [(300 + i, clean() + "\n" + line, "en", "s1", 1) for i in range(6)]
    odd = [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, clean(), "en", "s0", 1)]
    rows = docs + toxic + [copy, dirty] + lined + odd
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(r[0], 1, int(100 <= r[0] < 140)) for r in docs + toxic if r[0] % 2 == 0]
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == d.columns and out.schema["n_chars"].dataType == d.schema["n_chars"].dataType, name
        out.write.parquet(f"{tmp_path}/out{i}")
        at = spark.read.parquet(f"{tmp_path}/out{i}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    base = {r[0] for r in rows}
    assert base - kept[0] == {r[0] for r in toxic}
    assert kept[1] == kept[0]
    text = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/out1").collect()}
    assert [line in text[300 + i][0] for i in range(6)] == [False] * 5 + [True]
    assert text[300][1] == len(text[300][0]) and text[305][1] == 1
    assert kept[1] - kept[2] == {200, 401}                # a copy; a second blank text
    assert kept[2] - kept[3] == {201}
    assert kept[4] <= kept[3] and 7 in kept[4] and 400 not in kept[4]


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_every_stage_takes_columns_named_like_its_own(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(60)), "en", f"s{i % 2}", 1) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("positions", "mix_position", "id", "fp", "kept", "n_words", "h", "p", "q", "win", "wins", "t", "key", "size", "n_dropped", "n_lines", "component_id"):
        d = d.withColumn(c, F.lit("own"))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, at, str(tmp_path))
        assert out.columns[:5] == d.columns[:5] and (out.columns == d.columns or i == 4), name
        out.write.parquet(f"{tmp_path}/out{i}")
        at = spark.read.parquet(f"{tmp_path}/out{i}")
    assert at.count() > 0 and at.select("positions").distinct().collect() == [("own",)] and at.schema["mix_position"].dataType.typeName() == "double"
