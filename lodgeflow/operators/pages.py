"""Page-level policies: strategy choice, empty-page cut-off, page cap, fetch errors.

All of them reduce per page or per (source, search city) with aggregates on
small keys and join the verdict back; a window over one page (or over the
few pages of one search) is bounded by the page size or page cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgeflow.operators.markup import fragments

PAGE_KEYS = ("source", "city_ord", "page_no")
SEARCH_KEYS = ("source", "city_ord")

# FIXED VALUES: strategy policies per source.
# "best": richest of script/jsonld/html; "first": first non-empty in the given order;
# "union": all listed strategies (of search pages; other kinds of page take the first).
STRATEGY_POLICY = {
    "nchousingsearch.org": ("first", ("html", "jsonld")),
    "affordablehousing.com": ("first", ("html", "jsonld")),
    "gosection8.com": ("first", ("jsonld", "html")),
    "hud.gov": ("union", ("jsonld", "html")),
    "craigslist": ("first", ("html",)),
    "apartments.com": ("best", ("script", "jsonld", "html")),
    "zillow": ("best", ("script", "jsonld", "html")),
    "rent.com": ("best", ("script", "jsonld", "html")),
}
QUALITY_FIELDS = ("price", "bedrooms")   # what the choice of a strategy reads of a listing
# How a fetch error ends a source: "source" loses every page of the source,
# "stop" keeps the pages before the failing one of that search.
ERROR_POLICY = {
    "nchousingsearch.org": "source", "apartments.com": "source", "zillow": "source", "rent.com": "source",
    "craigslist": "source", "affordablehousing.com": "stop", "gosection8.com": "stop", "hud.gov": "stop",
}
# Pages of these kinds lie outside a search's page sequence: if one fails, only it is lost.
SINGLE_KINDS = ("locator", "senior")
PAGE_CAP_OVERRIDE = {"hud.gov": 3}   # min(cap, 3)
# Where a source's paging ends: by a link to a next page, or by a stated total of listings, so many a page.
NEXT_LINK_SOURCES = ("apartments.com", "craigslist")
TOTAL_RE = r"of\s+([\d,]+)"
TOTAL_PAGE_SIZE = {"craigslist": 120}


def with_kind(pages: DataFrame) -> DataFrame:
    """Pages with their kind: search (also where it is not told), locator or senior."""
    kind = F.coalesce(F.col("kind"), F.lit("search")) if "kind" in pages.columns else F.lit("search")
    return pages.withColumn("kind", kind)


def _searched():
    return ~F.col("kind").isin(*SINGLE_KINDS)


def strategy_rank(source, strategy):
    """Order of a strategy inside its source's policy (0 first); null when not used."""
    out = None
    for src, (_, order) in STRATEGY_POLICY.items():
        for i, s in enumerate(order):
            cond = (source == src) & (strategy == s)
            out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def strategy_quality(listings: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """(priced rows, rows with bedrooms, rows) per page and strategy."""
    return listings.groupBy(*keys, "strategy").agg(
        F.count_if(F.col("price").isNotNull()).alias("priced"),
        F.count_if(F.col("bedrooms") != "").alias("bedded"),
        F.count(F.lit(1)).alias("rows"))


def best_strategy(listings: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """Per page, the strategy with the greatest (priced, bedded, rows); ties by policy order."""
    q = strategy_quality(listings, keys).withColumn("_ord", strategy_rank(F.col("source"), F.col("strategy")))
    w = Window.partitionBy(*keys).orderBy(F.desc("priced"), F.desc("bedded"), F.desc("rows"), "_ord")
    pick = q.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*keys, "strategy")
    return listings.join(pick, [*keys, "strategy"], "left_semi")


def fallback_strategy(listings: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """Per page, rows of the first non-empty strategy in policy order ('union' keeps all).

    Joined by sorting: a page's listings repeat their keys, so written ones fill few bytes of a file,
    and by its size Spark would broadcast all of them.
    """
    ranked = with_kind(listings).withColumn("_ord", strategy_rank(F.col("source"), F.col("strategy")))
    first = ranked.groupBy(*keys).agg(F.min("_ord").alias("_first"))
    union = F.col("source").isin(*[s for s, (p, _) in STRATEGY_POLICY.items() if p == "union"]) & _searched()
    out = ranked.join(first.hint("merge"), list(keys)).where(union | (F.col("_ord") == F.col("_first")))
    return out.select(*listings.columns)


def choose_strategy(listings: DataFrame, keys=PAGE_KEYS) -> DataFrame:
    """Apply each source's policy: best-of for market sources, fallback or union otherwise."""
    listings = listings.where(strategy_rank(F.col("source"), F.col("strategy")).isNotNull())
    best_src = [s for s, (p, _) in STRATEGY_POLICY.items() if p == "best"]
    best = best_strategy(listings.where(F.col("source").isin(*best_src)), keys)
    rest = fallback_strategy(listings.where(~F.col("source").isin(*best_src)), keys)
    return best.unionByName(rest)


def page_limit(pages: DataFrame, cap: int = 5) -> DataFrame:
    """Search pages beyond the per-source page cap are not read."""
    lim = F.lit(cap)
    for src, c in PAGE_CAP_OVERRIDE.items():
        lim = F.when(F.col("source") == src, F.lit(min(cap, c))).otherwise(lim)
    return with_kind(pages).where(~_searched() | (F.col("page_no") <= lim)).select(*pages.columns)


def error_policy(pages: DataFrame) -> DataFrame:
    """Fetch errors: some sources lose everything, others keep the pages of that search before
    the error; a page outside the sequence is lost alone."""
    cols, pages = pages.columns, with_kind(pages)
    failed = pages.where(F.col("error").isNotNull())
    lost = failed.where(F.col("source").isin(*[s for s, p in ERROR_POLICY.items() if p == "source"])).select("source").distinct()
    first = failed.where(_searched()).groupBy(*SEARCH_KEYS).agg(F.min("page_no").alias("_err"))
    out = pages.join(lost, "source", "left_anti").join(first, list(SEARCH_KEYS), "left")
    before = ~_searched() | F.col("_err").isNull() | (F.col("page_no") < F.col("_err"))
    return out.where(before & F.col("error").isNull()).select(*cols)


def page_prefix(listings: DataFrame, pages: DataFrame) -> DataFrame:
    """Search pages after the first page of a search that yielded nothing do not count."""
    cols, listings = listings.columns, with_kind(listings)
    counts = listings.groupBy(*PAGE_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    stops = F.col("source") != "hud.gov"                       # reads all its pages, empty or not
    empties = (with_kind(pages).where(_searched() & stops).select(*PAGE_KEYS).join(counts, list(PAGE_KEYS), "left").where(F.col("_n").isNull())
               .groupBy(*SEARCH_KEYS).agg(F.min("page_no").alias("_empty")))
    return (listings.join(empties, list(SEARCH_KEYS), "left")
            .where(~_searched() | F.col("_empty").isNull() | (F.col("page_no") < F.col("_empty"))).select(*cols))


def paging_stops(pages: DataFrame) -> DataFrame:
    """Search pages after the one that says there are no more: it states a total that its own
    listings reach, or (no total stated) it has no link to a next page."""
    cols, pages = pages.columns, with_kind(pages)
    marks = fragments(pages.where(F.col("source").isin(*NEXT_LINK_SOURCES) & _searched()), [*PAGE_KEYS, "kind"], ("page",))
    size = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in TOTAL_PAGE_SIZE.items()])
    said = F.col("parts").getItem("total")
    total = F.replace(F.regexp_extract(said, TOTAL_RE, 1), F.lit(","), F.lit("")).try_cast("bigint")
    over = F.when(said.isNotNull(), F.col("page_no") * size >= total).otherwise(F.col("parts").getItem("next").isNull())
    last = marks.where(over).groupBy(*SEARCH_KEYS).agg(F.min("page_no").alias("_last"))
    return (pages.join(last, list(SEARCH_KEYS), "left").where(~_searched() | F.col("_last").isNull() | (F.col("page_no") <= F.col("_last")))
            .select(*cols))
