"""Pages -> listings: all strategies, page policies, one listing frame.

One pass over each page's html gives its fragments (cards, JSON-LD scripts,
listing objects of data scripts), written once; the strategies read them, and
each source's policy picks among their listings per page (an aggregate per page
+ semi join).  Pages after a search's first empty page, pages beyond the cap and
failed fetches are removed by aggregates on (source, search) keys.  ``seq`` numbers
listings as the sequential crawl would meet them: source registry order, search
city, page, strategy append order, position in the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow import schema
from lodgeflow.operators import extract as EX
from lodgeflow.operators import json_extract as JX
from lodgeflow.operators import markup as MU
from lodgeflow.operators import pages as PG
from lodgeflow.operators.rank import global_rank
from lodgeflow.session import scratch_path

PAGE_COLS = ["source", "search_city", "city_ord", "page_no"]
PAGE_KIND = [*PAGE_COLS, "kind"]
MARKET = ("apartments.com", "zillow", "rent.com")


def page_fragments(pages: DataFrame, want=("card", "jsonld", "script")) -> DataFrame:
    """Fragments of all pages with their page keys and kind."""
    return MU.fragments(PG.with_kind(pages), PAGE_KIND, want)


def _html(found: DataFrame, params: P.SearchParams) -> DataFrame:
    """Card listings. One source's two page kinds gate their cards by words."""
    cards = found.where(F.col("what") == "card").select(*PAGE_KIND, "pos", "text", "parts", "details")
    hud = F.col("source") == "hud.gov"
    gate = F.when(F.col("kind") == "locator", EX.housing_gate("text")).otherwise(EX.state_gate("text"))
    out = EX.html_listings(cards.where(~hud | gate), params.city, params.state)
    return EX.admit(out).withColumns({"strategy": F.lit("html"), "item_pos": F.struct(F.col("pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))})


def _jsonld(found: DataFrame, params: P.SearchParams) -> DataFrame:
    objects = JX.jsonld_objects(found.where(F.col("what") == "jsonld"), PAGE_KIND)
    out = JX.jsonld_to_listing(JX.jsonld_admit(JX.expand_graph(objects, PAGE_KIND)), params.city, params.state)
    htype = JX.jsonld_housing_type(F.col("source"), F.col("senior_hint"), F.col("kind"))
    return EX.admit(out.withColumn("housing_type", htype)).withColumns({
        "strategy": F.lit("jsonld"), "item_pos": F.struct(F.col("block_no").alias("a"), F.col("item_no").alias("b"), F.col("node_no").alias("c"))})


def _script(found: DataFrame, params: P.SearchParams) -> DataFrame:
    hits = found.where(F.col("what") == "script").select(*PAGE_KIND, "pos", F.try_parse_json("item").alias("item"))
    out = JX.script_to_listing(hits, params.city, params.state).withColumn("housing_type", F.lit(P.TYPE_MARKET))
    # only one source asks its script rows for a title or url
    admitted = out.where((F.col("source") != "apartments.com") | (F.col("title") != "") | (F.col("url") != ""))
    return admitted.withColumns({"strategy": F.lit("script"), "item_pos": F.struct(F.col("pos").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))})


def html_strategy(pages: DataFrame, params: P.SearchParams) -> DataFrame:
    """Listings of cards, of containers where a page of some sources has none."""
    return _html(page_fragments(pages, ("card",)), params)


def jsonld_strategy(pages: DataFrame, params: P.SearchParams) -> DataFrame:
    """Listings of JSON-LD objects."""
    return _jsonld(page_fragments(pages, ("jsonld",)), params)


def script_strategy(pages: DataFrame, params: P.SearchParams) -> DataFrame:
    """Listings of the objects in script data (market sources)."""
    return _script(page_fragments(pages.where(F.col("source").isin(*MARKET)), ("script",)), params)


LISTING_FIELDS = ["title", "price", "bedrooms", "bathrooms", "sqft", "address", "city", "state", "zip_code",
                  "neighborhood", "url", "date_posted", "phone", "amenities", "pet_policy", "housing_type"]


def _conform(df: DataFrame, fields) -> DataFrame:
    numeric = ("price", "bathrooms", "sqft")
    cols = [F.col(c) if c in df.columns else (F.lit(None) if c in numeric else F.lit("")) for c in fields]
    return df.select(*PAGE_KIND, "strategy", "item_pos",
                     *[c.alias(n) for c, n in zip(cols, fields)])


def all_strategies(found: DataFrame, params: P.SearchParams = P.DEFAULT, fields=LISTING_FIELDS) -> DataFrame:
    """Every strategy's listings of every page, unioned (before the per-page choice)."""
    return (_conform(_html(found, params), fields).unionByName(_conform(_jsonld(found, params), fields))
            .unionByName(_conform(_script(found, params), fields)))


def _written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """A frame written to the shared checkpoint folder by columns, and read back; in folders by one of them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def candidates(pages: DataFrame, params: P.SearchParams = P.DEFAULT, fields=LISTING_FIELDS) -> DataFrame:
    """All strategies' listings (page keys, strategy, position, ``fields``), written to the shared checkpoint folder
    as the fragments are, those by kind.

    They feed several aggregates and joins (quality, choice, page prefix);
    the stored rows hold no html, so these are the natural stage cuts. A strategy reads its own kind of fragments;
    fields that are not asked for are not computed.
    """
    return _written(all_strategies(_written(page_fragments(pages), "fragments", "what"), params, fields), "candidates")


def _order_columns() -> list[F.Column]:
    """Crawl order: source, search city, page, strategy, position."""
    src_ord = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, (_, s, _, _) in enumerate(P.SOURCES)],
                         F.lit(len(P.SOURCES)))
    strat = PG.strategy_rank(F.col("source"), F.col("strategy"))
    return [src_ord, F.col("city_ord"), F.col("page_no"), strat, F.col("item_pos")]


def number(listings: DataFrame) -> DataFrame:
    """``seq`` from 1 in crawl order, by a distributed rank."""
    keys = [f"_o{i}" for i in range(5)]
    return global_rank(listings.withColumns(dict(zip(keys, _order_columns()))), keys, "seq").drop(*keys)


def extract_listings(pages: DataFrame, params: P.SearchParams = P.DEFAULT, cap: int | None = None,
                     stop_at_errors: bool = False, stop_at_empty: bool = False, stop_at_end: bool = False) -> DataFrame:
    """Listings of all pages: LISTING columns plus page coordinates and strategy.

    Every page that was fetched counts; one that failed has no listings. The crawl's
    own cuts are offered for comparison with it: ``cap`` pages a search,
    ``stop_at_errors`` (see error_policy), ``stop_at_empty`` (see page_prefix) and
    ``stop_at_end`` (see paging_stops).
    """
    pages = PG.with_kind(pages)
    if cap is not None:
        pages = PG.page_limit(pages, cap)
    pages = PG.error_policy(pages) if stop_at_errors else pages.where(F.col("error").isNull())
    if stop_at_end:
        pages = PG.paging_stops(pages)
    chosen = PG.choose_strategy(candidates(pages, params))
    if stop_at_empty:
        chosen = PG.page_prefix(chosen, pages)
    market = F.col("source").isin(*MARKET)
    tagged = EX.tag_search_city(chosen.where(market), params.city).unionByName(chosen.where(~market))
    return schema.normalize(number(tagged))
