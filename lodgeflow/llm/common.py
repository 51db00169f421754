"""Text rules and written intermediate tables shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow.session import scratch_path
from lodgeflow.sources.tables import read_table

SPACES = " \t\n\x0b\f\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = re.compile(rb"[ \t-\r]")

__all__ = ["SPACES", "SPACE_RE", "ascii_lower", "n_words", "read_table", "word_blocks", "written"]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` gives the same on pure ASCII and is faster there."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null and blank texts."""
    body = F.btrim(text, F.lit(SPACES))
    return F.when(F.octet_length(body) > 0, F.size(F.split(body, SPACE_RE)).cast("long")).otherwise(F.lit(0).cast("long"))


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes, so that a very long
    text never stands in memory as one list. Blocks end at white space."""
    pos, end = 0, len(data)
    while pos < end:
        cut = end
        if pos + size < end:
            space = _SPACE.search(data, pos + size)
            cut = space.start() if space else end
        words = data[pos:cut].split()
        if words:
            yield words
        pos = cut


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` and read back: cuts
    lineage, and a lost executor costs no recomputation of what is written. ``by``
    names columns that become folders, for reads of one of their values."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
