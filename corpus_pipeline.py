"""Training corpus from the documents table: filter, dedup, decontaminate and mix.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; ``run`` writes each result to the shared folder as Parquet and
reads it back as the next stage's ``docs``. All but the last return the columns of
``documents``. Rows without a doc_id pass the filters (nothing names them); rows that
share a doc_id stay or go together; empty tables pass through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow.llm.common import read_table, written
from lodgeflow.llm.decontam import drop_contaminated
from lodgeflow.llm.line_dedup import dedup_lines
from lodgeflow.llm.mixing import mix
from lodgeflow.llm.quality import keep_good
from lodgeflow.llm.simhash import keep_one


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects (junk or toxic)."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated in 5 documents or more stay in the last one only; n_chars follows the text."""
    done = dedup_lines(docs.withColumn("__n", F.col("n_chars")), min_chars=40, min_docs=5)
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("__n"))
    return done.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest doc_id."""
    return keep_one(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which 5 % of the words are benchmark passages."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), window=13, share=20)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, in training order, with ``mix_position``."""
    return mix(docs, weights=(5.0, 2.0, 1.0), cap=3)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixing),
]

#: The classifier and the fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last one's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i + 1}")
    return docs
