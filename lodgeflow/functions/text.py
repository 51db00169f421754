"""String column functions: whitespace, url keys, listing ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgeflow.params import PY_WHITESPACE


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Whitespace strip with Python's definition of whitespace (not just spaces)."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def norm_lower(c) -> Column:
    """lower() then strip: the key used for titles and cities."""
    return py_strip(F.lower(col(c)))


def url_clean(url) -> Column:
    """Dedupe key of a url: trailing slashes removed, lower-cased."""
    return F.lower(F.rtrim(col(url), F.lit("/")))


def listing_id(url="url", title="title", price="price", address="address") -> Column:
    """md5 of lower(url); without a url, md5 of 'title|price|address' (null price prints None)."""
    u = col(url)
    fallback = F.concat_ws("|", F.lower(col(title)),
                           F.coalesce(col(price).cast("string"), F.lit("None")),
                           F.lower(col(address)))
    return F.md5(F.when(u != "", F.lower(u)).otherwise(fallback))


def contains_any(text: Column, needles) -> Column:
    """OR of literal substring tests; stays inside generated code."""
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out
