"""Registered queries: one per operator of the inventory, each paired with SQL.

Every query reads the driver tables (through the listings fixture or the
pages/documents tables) over their whole extent.  ``QUERIES`` maps a name to
``fn(spark, sf_dir) -> DataFrame``; ``SQL`` maps the same name to DuckDB SQL
over the same tables (absent only where SQL cannot express the operator).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions import labels as LB
from lodgeflow.functions.dates import posted_ts
from lodgeflow.functions.text import listing_id, norm_lower, url_clean
from lodgeflow.operators import classify as CL
from lodgeflow.operators import dedupe as DD
from lodgeflow.operators import facets as AG
from lodgeflow.operators import filters as FL
from lodgeflow.operators import joins as JN
from lodgeflow.operators import rank as RK
from lodgeflow.plans import oracle as O
from lodgeflow.plans.search import prepare
from lodgeflow.schema import LISTING
from lodgeflow.sources.fixture import fixture_listings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PR = P.ORACLE
LISTING_COLS = LISTING.fieldNames()
SEARCH_COLS = LISTING_COLS + ["full_address", "directions_url", "location_tier", "is_recent", "date_scraped",
                              "priority_group", "type_ord", "tier_ord", "recent_ord", "price_key"]
SEEN_BEFORE = "1998-01-01 00:00:00"   # crawls before this were already processed
CURRENT_BATCH = 1998


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- building blocks

def fx(spark, sf) -> DataFrame:
    return fixture_listings(spark, sf)


def classified(spark, sf) -> DataFrame:
    """The whole fixture classified, with group and sort keys (no filter, no dedupe)."""
    out = CL.classify(fx(spark, sf), PR).withColumn("priority_group", CL.priority_group())
    return RK.with_sort_keys(out)


def searched(spark, sf) -> DataFrame:
    return prepare(fx(spark, sf), PR)


def seen_fixture(spark, sf) -> DataFrame:
    """Seen store as left by earlier crawls: every listing crawled before SEEN_BEFORE."""
    f = fx(spark, sf).where(F.col("crawled_at") < F.lit(SEEN_BEFORE).cast("timestamp_ntz"))
    return f.select(listing_id().alias("listing_id"), "title", "price", "url", "source",
                    F.col("crawled_at").cast("timestamp").alias("first_seen"),
                    F.year("crawled_at").cast("bigint").alias("batch_id"))


SEEN_SQL = (f"seen AS (SELECT {O.listing_id_sql()} AS listing_id, title, price, url, source, "
            f"crawled_at AS first_seen, CAST(year(crawled_at) AS BIGINT) AS batch_id FROM fx "
            f"WHERE crawled_at < TIMESTAMP '{SEEN_BEFORE}')")


def _ts_text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


def _sel(cols) -> str:
    return ", ".join(cols)


# ---------------------------------------------------------------- flagship

@query("search", O.with_(O.ctes_search(), f"SELECT {_sel(SEARCH_COLS)}, {O.RANK_SQL} FROM s"))
def q_search(spark, sf):
    """Filter, dedupe, classify and rank the whole fixture (the flagship)."""
    return RK.rank_listings(searched(spark, sf)).select(*SEARCH_COLS, "rank")


# ---------------------------------------------------------------- sources

@query("scan_listings", O.with_(O.ctes_fixture(), f"""SELECT row_number() OVER (ORDER BY s.priority, s.source_ord, seq) AS seq,
  {_sel(c for c in LISTING_COLS if c not in ("seq", "neighborhood", "phone"))},
  CASE WHEN source = 'hud.gov' THEN '' ELSE neighborhood END AS neighborhood, CASE WHEN source = 'zillow' THEN '' ELSE phone END AS phone,
  s.source_key, s.priority, s.source_ord FROM fx JOIN (VALUES {", ".join(f"('{k}', '{n}', {p}, {i})" for i, (k, n, p, _) in enumerate(P.SOURCES))})
  AS s(source_key, src, priority, source_ord) ON fx.source = s.src"""))
def q_scan_listings(spark, sf):
    """All sources as one listing set in crawl order: one input a source, two of them without a column the others have."""
    lacks = {"hud.gov": ["neighborhood"], "zillow": ["phone"]}
    f = fx(spark, sf).select(*LISTING_COLS)
    inputs = [f.where(F.col("source") == s).drop(*lacks.get(s, [])) for _, s, _, _ in reversed(P.SOURCES)]
    return JN.union_sources(inputs, JN.sources_dim(spark)).select(*LISTING_COLS, "source_key", "priority", "source_ord")


SOURCE_CONFIG = P.SourceConfig({
    "socialserve": True, "hud": {"enabled": True}, "affordablehousing": {"enabled": False},
    "gosection8": {}, "apartments_com": {"enabled": True}, "craigslist": True,
    "zillow": "yes", "rent_com": {"enabled": True, "priority": 2},
})


@query("source_select", O.with_(O.ctes_fixture(), f"""SELECT seq, source, housing_type FROM fx
  WHERE source IN ('apartments.com', 'craigslist', 'rent.com')"""))
def q_source_select(spark, sf):
    """Enabled sources only (bool, dict or missing config), market priority (2) only."""
    dim = JN.sources_dim(spark, SOURCE_CONFIG)
    return JN.select_sources(fx(spark, sf), dim, priority=2).select("seq", "source", "housing_type")


# ---------------------------------------------------------------- filters

@query("filter_rent_market", O.with_(O.ctes_fixture(), f"""SELECT seq, price, housing_type FROM fx
  WHERE NOT ({O.SUB}) AND (price IS NULL OR price BETWEEN {PR.min_rent} AND {PR.max_rent})"""))
def q_filter_rent_market(spark, sf):
    f = fx(spark, sf).where(~LB.is_subsidized())
    return FL.rent_filter(f, PR.min_rent, PR.max_rent).select("seq", "price", "housing_type")


@query("filter_rent_subsidized", O.with_(O.ctes_fixture(), f"""SELECT seq, price, housing_type FROM fx
  WHERE {O.SUB} AND (price IS NULL OR price <= {PR.max_rent * 1.5})"""))
def q_filter_rent_subsidized(spark, sf):
    f = fx(spark, sf).where(LB.is_subsidized())
    return FL.rent_filter(f, PR.min_rent, PR.max_rent).select("seq", "price", "housing_type")


@query("filter_bedrooms", O.with_(O.ctes_fixture(), f"""SELECT seq, bedrooms FROM fx
  WHERE {O.strip('lower(bedrooms)')} = '' OR {O.strip('lower(bedrooms)')} IN ({O._lst(PR.bedroom_labels())})"""))
def q_filter_bedrooms(spark, sf):
    return FL.bedroom_filter(fx(spark, sf), PR.bedroom_labels()).select("seq", "bedrooms")


@query("filter_state", O.with_(O.ctes_fixture(), """SELECT seq, state FROM fx
  WHERE state = '' OR upper(state) = 'NC'"""))
def q_filter_state(spark, sf):
    return FL.state_filter(fx(spark, sf), PR.state, PR.restrict_to_state).select("seq", "state")


@query("filter_all", O.with_(O.ctes_fixture() + O.ctes_filter("fx", "f"), f"SELECT {_sel(LISTING_COLS)} FROM f"))
def q_filter_all(spark, sf):
    return FL.filter_listings(fx(spark, sf), PR).select(*LISTING_COLS)


OVERRIDE = PR.override(min_rent=0, max_rent=700, bedrooms=["0", "1"])


@query("param_override", O.with_(O.ctes_fixture() + O.ctes_filter("fx", "f", OVERRIDE),
                                 "SELECT seq, price, bedrooms, state, housing_type FROM f"))
def q_param_override(spark, sf):
    """min 0 (zero counts as an override), max 700, bedrooms 0/1 (studio implied)."""
    return FL.filter_listings(fx(spark, sf), OVERRIDE).select("seq", "price", "bedrooms", "state", "housing_type")


def _age_sql() -> str:
    from datetime import datetime, timedelta
    now = datetime.strptime(PR.as_of, "%Y-%m-%d %H:%M:%S")
    sub, mkt = (now - timedelta(days=90)), (now - timedelta(days=7))
    return O.with_(O.ctes_fixture() + [
        r"a AS (SELECT *, regexp_replace(substr(date_posted, 1, 19), '\s+', ' ', 'g') AS _s FROM fx)",
        f"b AS (SELECT *, {O.POSTED_SQL} AS _posted FROM a)"],
        f"""SELECT seq, housing_type, date_posted FROM b WHERE _posted IS NULL OR _posted >= CASE WHEN {O.SUB}
  THEN TIMESTAMP '{sub:%Y-%m-%d %H:%M:%S}' ELSE TIMESTAMP '{mkt:%Y-%m-%d %H:%M:%S}' END""")


@query("filter_listing_age", _age_sql())
def q_filter_listing_age(spark, sf):
    """Opt-in age window: 90 days subsidized, 7 days market; undated rows kept."""
    return FL.age_filter(fx(spark, sf), PR.as_of, 90, 7).select("seq", "housing_type", "date_posted")


SEARCH_Q = "monroe"


@query("search_text", O.with_(O.ctes_search(), "SELECT seq, title, address, city, neighborhood FROM s WHERE "
                              + " OR ".join(f"contains(lower({c}), '{SEARCH_Q}')" for c in FL.SEARCH_COLUMNS)))
def q_search_text(spark, sf):
    return FL.search_text(searched(spark, sf), SEARCH_Q).select("seq", "title", "address", "city", "neighborhood")


@query("search_facets", O.with_(O.ctes_search(), """SELECT seq, housing_type, bedrooms, price FROM s
  WHERE housing_type = 'market' AND lower(bedrooms) IN ('studio', '0') AND (price IS NULL OR price <= 800)"""))
def q_search_facets(spark, sf):
    return FL.facet_filter(searched(spark, sf), housing_type="market", bedrooms="Studio", max_price=800) \
        .select("seq", "housing_type", "bedrooms", "price")


# ---------------------------------------------------------------- projections

K = O.ctes_classified_fixture()


@query("is_subsidized", O.with_(O.ctes_fixture(), f"SELECT seq, housing_type, {O.SUB} AS is_subsidized FROM fx"))
def q_is_subsidized(spark, sf):
    return fx(spark, sf).select("seq", "housing_type", LB.is_subsidized().alias("is_subsidized"))


@query("price_label", O.with_(O.ctes_fixture(), f"""SELECT seq, {O.price_label_sql('N/A')} AS price_csv,
  {O.price_label_sql('Call')} AS price_markdown FROM fx"""))
def q_price_label(spark, sf):
    return fx(spark, sf).select("seq", LB.price_label().alias("price_csv"),
                                LB.price_label(missing=P.MISSING_PRICE_MARKDOWN).alias("price_markdown"))


@query("type_label", O.with_(O.ctes_fixture(), f"SELECT seq, {O.TYPE_LABEL_SQL} AS type_label FROM fx"))
def q_type_label(spark, sf):
    return fx(spark, sf).select("seq", LB.type_label().alias("type_label"))


@query("tier_label", O.with_(K, f"SELECT seq, {O.TIER_LABEL_SQL} AS tier_label FROM k"))
def q_tier_label(spark, sf):
    return classified(spark, sf).select("seq", LB.tier_label().alias("tier_label"))


@query("full_address", O.with_(K, "SELECT seq, full_address FROM k"))
def q_full_address(spark, sf):
    return classified(spark, sf).select("seq", "full_address")


@query("directions_url", O.with_(K, "SELECT seq, directions_url FROM k"))
def q_directions_url(spark, sf):
    return classified(spark, sf).select("seq", "directions_url")


@query("display_row", O.with_(K, f"SELECT seq, {O.BEDS_BATHS_SQL} AS beds_baths, {O.MD_ROW_SQL} AS md_row FROM k"))
def q_display_row(spark, sf):
    return classified(spark, sf).select("seq", LB.beds_baths().alias("beds_baths"), LB.markdown_row().alias("md_row"))


@query("phone_link", O.with_(O.ctes_fixture(), f"SELECT seq, {O.PHONE_LINK_SQL} AS phone_cell FROM fx"))
def q_phone_link(spark, sf):
    return fx(spark, sf).select("seq", LB.phone_link().alias("phone_cell"))


@query("recent_label", O.with_(K, "SELECT seq, CASE WHEN is_recent THEN 'NEW (48h)' ELSE '' END AS recent_label FROM k"))
def q_recent_label(spark, sf):
    return classified(spark, sf).select("seq", LB.recent_label().alias("recent_label"))


# ---------------------------------------------------------------- classification

@query("zip_backfill", O.with_(K, "SELECT seq, zip_code FROM k"))
def q_zip_backfill(spark, sf):
    df = CL.with_full_address(fx(spark, sf))
    return df.select("seq", CL.backfilled_zip().alias("zip_code"))


def _tier_flag_sql(expr: str, alias: str) -> str:
    return O.with_(O.ctes_fixture() + [
        "a AS (SELECT *, concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), "
        "nullif(zip_code, '')) AS full_address FROM fx)",
        f"b AS (SELECT *, {O.strip('zip_code')} AS _zs, "
        f"CASE WHEN full_address <> '' THEN regexp_extract(full_address, '{O.ZIP_RE}', 1) ELSE '' END AS _z1, "
        f"CASE WHEN address <> '' THEN regexp_extract(address, '{O.ZIP_RE}', 1) ELSE '' END AS _z2, "
        f"{O.strip('lower(city)')} AS _city, lower(address || ' ' || neighborhood || ' ' || full_address) AS _text "
        f"FROM a)",
        "c AS (SELECT *, CASE WHEN _zs <> '' THEN _zs WHEN _z1 <> '' THEN _z1 WHEN _z2 <> '' THEN _z2 "
        "ELSE '' END AS _zip FROM b)"], f"SELECT seq, {expr} AS {alias} FROM c")


_PREF = O._lst([a.lower() for a in PR.preferred_areas])
_EXP = O._lst([a.lower() for a in PR.expanded_areas])
_PREF_TXT = " OR ".join(f"contains(_text, '{a.lower()}')" for a in PR.preferred_areas)
_EXP_TXT = " OR ".join(f"contains(_text, '{a.lower()}')" for a in PR.expanded_areas)


@query("tier_exact", _tier_flag_sql(f"(_city IN ({_PREF}) OR _zip IN ({O._lst(PR.preferred_zips)}))", "tier_exact"))
def q_tier_exact(spark, sf):
    return CL.with_full_address(fx(spark, sf)).select("seq", CL.tier_exact(PR).alias("tier_exact"))


@query("tier_contains", _tier_flag_sql(f"({_PREF_TXT})", "tier_contains"))
def q_tier_contains(spark, sf):
    return CL.with_full_address(fx(spark, sf)).select("seq", CL.tier_contains(PR).alias("tier_contains"))


@query("tier_expanded", _tier_flag_sql(f"(_city IN ({_EXP}) OR {_EXP_TXT})", "tier_expanded"))
def q_tier_expanded(spark, sf):
    return CL.with_full_address(fx(spark, sf)).select("seq", CL.tier_expanded(PR).alias("tier_expanded"))


@query("classify_tier", O.with_(K, "SELECT seq, location_tier, zip_code FROM k"))
def q_classify_tier(spark, sf):
    return CL.classify_tier(CL.with_full_address(fx(spark, sf)), PR).select("seq", "location_tier", "zip_code")


@query("posted_ts", O.with_(O.ctes_fixture() + [
    r"a AS (SELECT *, regexp_replace(substr(date_posted, 1, 19), '\s+', ' ', 'g') AS _s FROM fx)"],
    f"SELECT seq, date_posted, strftime({O.POSTED_SQL}, '%Y-%m-%d %H:%M:%S') AS posted_at FROM a"))
def q_posted_ts(spark, sf):
    f = fx(spark, sf)
    return f.select("seq", "date_posted", F.date_format(posted_ts(), "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


@query("classify_recency", O.with_(K, "SELECT seq, date_posted, is_recent FROM k"))
def q_classify_recency(spark, sf):
    return fx(spark, sf).select("seq", "date_posted", CL.recency(PR.as_of, PR.recent_hours).alias("is_recent"))


CLASSIFIED_COLS = LISTING_COLS + ["full_address", "directions_url", "location_tier", "is_recent", "date_scraped"]


@query("classify_all", O.with_(K, f"SELECT {_sel(CLASSIFIED_COLS)} FROM k"))
def q_classify_all(spark, sf):
    return CL.classify(fx(spark, sf), PR).select(*CLASSIFIED_COLS)


@query("priority_group", O.with_(K, "SELECT seq, priority_group FROM k"))
def q_priority_group(spark, sf):
    return classified(spark, sf).select("seq", "priority_group")


# ---------------------------------------------------------------- dedupe

@query("dedupe_url", O.with_(O.ctes_fixture(), """SELECT seq, url FROM fx QUALIFY url = '' OR
  row_number() OVER (PARTITION BY url = '', lower(rtrim(url, '/')) ORDER BY seq) = 1"""))
def q_dedupe_url(spark, sf):
    return DD.dedupe_url(fx(spark, sf)).select("seq", "url")


@query("dedupe_title_price", O.with_(O.ctes_fixture(), f"""SELECT seq, title, price FROM fx QUALIFY title = '' OR
  row_number() OVER (PARTITION BY {O.strip('lower(title)')}, price ORDER BY seq) = 1"""))
def q_dedupe_title_price(spark, sf):
    return DD.dedupe_title_price(fx(spark, sf)).select("seq", "title", "price")


@query("dedupe_all", O.with_(O.ctes_fixture() + O.ctes_dedupe("fx", "d"), "SELECT seq, url, title, price FROM d"))
def q_dedupe_all(spark, sf):
    return DD.dedupe(fx(spark, sf)).select("seq", "url", "title", "price")


# ---------------------------------------------------------------- ranking

@query("rank_listings", O.with_(O.ctes_search(), f"""SELECT seq, type_ord, tier_ord, recent_ord, price_key,
  {O.RANK_SQL} FROM s"""))
def q_rank_listings(spark, sf):
    return RK.rank_listings(searched(spark, sf)) \
        .select("seq", "type_ord", "tier_ord", "recent_ord", "price_key", "rank")


@query("top_n_per_group", O.with_(O.ctes_search() + [
    "t AS (SELECT seq, priority_group, row_number() OVER (PARTITION BY priority_group ORDER BY type_ord, tier_ord, "
    "recent_ord, price_key, seq) AS group_pos, count(*) OVER (PARTITION BY priority_group) AS group_size FROM s)"],
    "SELECT seq, priority_group, group_pos, group_size, greatest(group_size - 30, 0) AS left_out FROM t "
    "WHERE group_pos <= 30"))
def q_top_n_per_group(spark, sf):
    return RK.top_n(searched(spark, sf), "priority_group", 30) \
        .select("seq", "priority_group", "group_pos", "group_size", "left_out")


@query("sort_by", O.with_(O.ctes_search(), """SELECT seq, city, row_number() OVER (ORDER BY lower(coalesce(city, '')),
  type_ord, tier_ord, recent_ord, price_key, seq) AS pos FROM s"""))
def q_sort_by(spark, sf):
    return RK.sort_by(searched(spark, sf), "city", True).select("seq", "city", "pos")


# ---------------------------------------------------------------- aggregation

@query("count_by_source", O.with_(O.ctes_search(), """SELECT coalesce(nullif(source, ''), 'unknown') AS source,
  count(*) AS n FROM s GROUP BY 1"""))
def q_count_by_source(spark, sf):
    return AG.count_by_source(searched(spark, sf))


@query("count_by_group", O.with_(O.ctes_search() + [
    "g AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, '{k}', '{lab}')" for g, k, lab in P.PRIORITY_GROUPS)
    + ") AS g(priority_group, group_key, group_label))"],
    """SELECT g.priority_group, g.group_key, g.group_label, count(s.seq) AS n FROM g LEFT JOIN s
  ON s.priority_group = g.priority_group GROUP BY ALL"""))
def q_count_by_group(spark, sf):
    return AG.count_by_group(searched(spark, sf))


@query("run_totals", O.with_(O.ctes_search(), f"""SELECT count(*) AS total, count(*) FILTER (WHERE {O.SUB})
  AS subsidized, count(*) FILTER (WHERE is_recent) AS recent FROM s"""))
def q_run_totals(spark, sf):
    return AG.run_totals(searched(spark, sf))


@query("facet_stats", O.with_(O.ctes_search(), f"""SELECT count(*) AS total, count(price) AS priced,
  count(*) FILTER (WHERE {O.SUB}) AS subsidized, count(DISTINCT source) AS sources,
  count(DISTINCT nullif(city, '')) AS cities FROM s"""))
def q_facet_stats(spark, sf):
    return AG.facet_stats(searched(spark, sf))


@query("facet_values", O.with_(O.ctes_search(), """SELECT DISTINCT 'source' AS facet, source AS value FROM s
  WHERE source <> '' UNION ALL SELECT DISTINCT 'city', city FROM s WHERE city <> ''"""))
def q_facet_values(spark, sf):
    return AG.facet_values(searched(spark, sf))


@query("seen_last_check", O.with_(O.ctes_fixture() + [SEEN_SQL],
                                  "SELECT strftime(max(first_seen), '%Y-%m-%d %H:%M:%S') AS last_check FROM seen"))
def q_seen_last_check(spark, sf):
    return AG.last_check(seen_fixture(spark, sf)).select(_ts_text("last_check").alias("last_check"))


# ---------------------------------------------------------------- joins

NEW_SQL = O.with_(O.ctes_search() + [SEEN_SQL],
                  f"SELECT {_sel(SEARCH_COLS)}, {O.listing_id_sql()} AS listing_id FROM s "
                  f"WHERE {O.listing_id_sql()} NOT IN (SELECT listing_id FROM seen)")


def _new(spark, sf) -> DataFrame:
    return JN.new_listings(searched(spark, sf), seen_fixture(spark, sf))


@query("new_listings", NEW_SQL)
def q_new_listings(spark, sf):
    """Search results whose id the seen store does not hold (left anti join)."""
    return _new(spark, sf).select(*SEARCH_COLS, "listing_id")


@query("new_minus_seen", NEW_SQL)
def q_new_minus_seen(spark, sf):
    """Set difference new - seen by id, against a seen store of one run a crawl year, its runs merged in pairs."""
    store = SeenStore(spark, scratch_path(spark, "store"), digits=1, fanout=2)
    seen = seen_fixture(spark, sf)
    for n, year in enumerate(("batch_id <= 1995", "batch_id = 1996", "batch_id >= 1997")):
        store.append(seen.where(year), n)
    result = searched(spark, sf).withColumn("listing_id", listing_id())
    return result.join(store.rows(near=result).select("listing_id"), "listing_id", "left_anti").select(*SEARCH_COLS, "listing_id")


@query("tier_join", O.with_(K, "SELECT seq, location_tier FROM k"))
def q_tier_join(spark, sf):
    df = CL.with_full_address(fx(spark, sf))
    return JN.tier_join(df, JN.areas_dim(spark, PR), JN.zips_dim(spark)).select("seq", "location_tier")


@query("source_dim_join", O.with_(O.ctes_fixture(), f"""SELECT seq, fx.source, s.source_key, s.priority,
  s.source_ord FROM fx LEFT JOIN (VALUES {", ".join(f"('{k}', '{n}', {p}, {i})" for i, (k, n, p, _) in enumerate(P.SOURCES))})
  AS s(source_key, src, priority, source_ord) ON fx.source = s.src"""))
def q_source_dim_join(spark, sf):
    return JN.with_source(fx(spark, sf), JN.sources_dim(spark)) \
        .select("seq", "source", "source_key", "priority", "source_ord")


@query("zip_semi", _tier_flag_sql("_zip", "zip").replace(
    "SELECT seq, _zip AS zip FROM c", f"SELECT seq, _zip AS zip FROM c WHERE _zip IN ({O._lst(PR.preferred_zips)})"))
def q_zip_semi(spark, sf):
    df = CL.with_full_address(fx(spark, sf))
    return JN.zip_semi(df, JN.zips_dim(spark)).select("seq", CL.effective_zip().alias("zip"))


# ---------------------------------------------------------------- scalar functions

@query("listing_id", O.with_(O.ctes_fixture(), f"SELECT seq, {O.listing_id_sql()} AS listing_id FROM fx"))
def q_listing_id(spark, sf):
    return fx(spark, sf).select("seq", listing_id().alias("listing_id"))


@query("url_clean", O.with_(O.ctes_fixture(), "SELECT seq, lower(rtrim(url, '/')) AS url_clean FROM fx"))
def q_url_clean(spark, sf):
    return fx(spark, sf).select("seq", url_clean("url").alias("url_clean"))


@query("py_strip", O.with_(O.ctes_fixture(), f"""SELECT seq, {O.strip('lower(title)')} AS title_key,
  {O.strip('lower(city)')} AS city_key FROM fx"""))
def q_py_strip(spark, sf):
    return fx(spark, sf).select("seq", norm_lower("title").alias("title_key"), norm_lower("city").alias("city_key"))


# ---------------------------------------------------------------- sinks and the seen store

from lodgeflow.plans import publish as PB  # noqa: E402
from lodgeflow.session import scratch_path  # noqa: E402
from lodgeflow.sources.seen_store import SeenStore  # noqa: E402
from lodgeflow.sources.tables import read_seen  # noqa: E402
from lodgeflow.streaming import monitor as MN  # noqa: E402

CSV_SQL_COLS = {
    "housing_type": f"{O.TYPE_LABEL_SQL} AS housing_type",
    "location_tier": f"{O.TIER_LABEL_SQL} AS location_tier",
    "is_recent": "CASE WHEN is_recent THEN 'NEW (48h)' ELSE '' END AS is_recent",
    "price": f"{O.price_label_sql('N/A')} AS price",
}


@query("export_csv", O.with_(O.ctes_search(), "SELECT " + ", ".join(CSV_SQL_COLS.get(c, c) for c in P.CSV_COLUMNS)
                             + " FROM s"))
def q_export_csv(spark, sf):
    """The CSV rows, 23 columns in export order with display labels, written in rank order and read back."""
    path = scratch_path(spark, "csv")
    PB.write_csv(RK.rank_listings(searched(spark, sf)), path)
    return PB.read_csv(spark, path)


_GROUP_KEY_SQL = "CASE priority_group " + " ".join(f"WHEN {g} THEN '{k}'" for g, k, _ in P.PRIORITY_GROUPS) + " END"


@query("export_json_groups", O.with_(O.ctes_search(), f"SELECT {_sel(SEARCH_COLS)}, {_GROUP_KEY_SQL} AS group_key, {O.RANK_SQL} FROM s"))
def q_export_json_groups(spark, sf):
    """Listings with the export group and rank they were written under, read back from the groups' folders."""
    path = scratch_path(spark, "groups")
    ranked = RK.rank_listings(searched(spark, sf))
    PB.write_grouped_json(ranked, path)
    schema = ranked.select(*SEARCH_COLS, "rank").withColumn("group_key", F.lit("")).schema
    return PB.read_grouped_json(spark, path, schema).select(*SEARCH_COLS, "group_key", "rank")


@query("export_metadata", O.with_(O.ctes_search(), f"""SELECT 'R. Example' AS resident, CAST(71 AS BIGINT) AS resident_age,
  CAST(2050 AS BIGINT) AS monthly_income, '{PR.state}' AS search_state, '${PR.min_rent}-${PR.max_rent}' AS rent_range,
  '{", ".join(PR.bedrooms)}' AS bedrooms, count(*) AS total_results, '{PR.as_of.replace(" ", "T")}' AS scraped_at
  FROM s"""))
def q_export_metadata(spark, sf):
    return PB.run_metadata(searched(spark, sf), PR, resident={"name": "R. Example", "age": 71, "monthly_income": 2050})


STORE_COLS = ["listing_id", "title", "price", "url", "source", "first_seen", "batch_id"]


def _store_out(df: DataFrame) -> DataFrame:
    return df.select(*[_ts_text(c).alias(c) if c == "first_seen" else F.col(c) for c in STORE_COLS])


def _written_seen(spark, sf) -> str:
    path = scratch_path(spark, "seen")
    PB.append_seen(seen_fixture(spark, sf), path)
    return path


@query("seen_scan", O.with_(O.ctes_fixture() + [SEEN_SQL], """SELECT listing_id, title, price, url, source,
  strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, batch_id FROM seen"""))
def q_seen_scan(spark, sf):
    """The seen store read back from its partitioned folder."""
    return _store_out(read_seen(spark, _written_seen(spark, sf)))


APPEND_SQL = O.with_(O.ctes_search() + [SEEN_SQL, f"""store AS (
  SELECT listing_id, title, price, url, source, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, batch_id
  FROM seen UNION ALL
  SELECT {O.listing_id_sql()}, title, price, url, source, '{PR.as_of}', CAST({CURRENT_BATCH} AS BIGINT) FROM s
  WHERE {O.listing_id_sql()} NOT IN (SELECT listing_id FROM seen))"""], "SELECT * FROM store")


def _appended_store(spark, sf) -> str:
    path = _written_seen(spark, sf)
    new = JN.new_listings(searched(spark, sf), read_seen(spark, path))
    PB.append_seen(PB.seen_rows(new, CURRENT_BATCH, F.to_timestamp(F.lit(PR.as_of))), path)
    return path


@query("seen_append", APPEND_SQL)
def q_seen_append(spark, sf):
    """The store after this run's new listings were appended as batch 1998."""
    return _store_out(read_seen(spark, _appended_store(spark, sf)))


@query("seen_registry", APPEND_SQL.replace("SELECT * FROM store", """SELECT listing_id, title, price, url, source, first_seen,
  count(*) OVER (PARTITION BY listing_id) AS sightings FROM store QUALIFY row_number() OVER (PARTITION BY listing_id
  ORDER BY first_seen, batch_id, title, price NULLS FIRST, url, source) = 1"""))
def q_seen_registry(spark, sf):
    """One row per id of the store: its first record and number of sightings."""
    reg = MN.seen_registry(spark, _appended_store(spark, sf))
    return reg.select("listing_id", *MN.FIRST, _ts_text("first_seen").alias("first_seen"), "sightings")


@query("alert_text", O.with_(O.ctes_search() + [SEEN_SQL, f"""n AS (SELECT *, row_number() OVER (ORDER BY type_ord,
  tier_ord, recent_ord, price_key, seq) AS alert_no FROM s WHERE {O.listing_id_sql()} NOT IN
  (SELECT listing_id FROM seen))"""], f"SELECT seq, alert_no, {O.alert_sql('alert_no')} AS alert, {O.mail_sql('alert_no')} AS mail FROM n"))
def q_alert_text(spark, sf):
    """Numbered alert blocks for this run's new listings, in rank order: as the console and as a mail show them."""
    ranked = RK.rank_listings(_new(spark, sf), "alert_no")
    return ranked.select("seq", "alert_no", LB.alert_block(F.col("alert_no")).alias("alert"),
                         LB.alert_block(F.col("alert_no"), "mail").alias("mail"))


# ---------------------------------------------------------------- streaming

ALERT_COLS = ["seq", "snapshot", "listing_id", "title", "price", "location_tier", "is_recent", "priority_group"]


def _snapshots(spark, sf) -> DataFrame:
    return fx(spark, sf).withColumn("snapshot", F.year("crawled_at").cast("bigint"))


def _stage(spark, sf, where: str) -> str:
    """Write crawl snapshots (one folder per snapshot) as the stream's input files."""
    path = scratch_path(spark, "snapshots")
    (_snapshots(spark, sf).where(where).select(*MN.SNAPSHOT_SCHEMA.fieldNames())
     .write.mode("append").partitionBy("snapshot").parquet(path))
    return path


def _stream_sql(where: str, seen: bool) -> str:
    ctes = O.ctes_fixture() + [f"fs AS (SELECT *, CAST(year(crawled_at) AS BIGINT) AS snapshot FROM fx WHERE {where})"]
    ctes += O.ctes_filter("fs", "f")
    ctes += [
        "d_u AS (SELECT * FROM f QUALIFY url = '' OR row_number() OVER "
        "(PARTITION BY snapshot, url = '', lower(rtrim(url, '/')) ORDER BY seq) = 1)",
        f"d AS (SELECT * FROM d_u QUALIFY title = '' OR row_number() OVER "
        f"(PARTITION BY snapshot, {O.strip('lower(title)')}, price ORDER BY seq) = 1)",
    ]
    ctes += O.ctes_classify("d", "c") + O.ctes_keys("c", "k")
    if seen:
        ctes += [SEEN_SQL]
    filt = "WHERE listing_id NOT IN (SELECT listing_id FROM seen)" if seen else ""
    ctes += [f"i AS (SELECT *, {O.listing_id_sql()} AS listing_id FROM k)",
             f"n AS (SELECT * FROM i {filt} QUALIFY snapshot = min(snapshot) OVER (PARTITION BY listing_id))"]
    return O.with_(ctes, f"SELECT {_sel(ALERT_COLS)} FROM n")


def _run(query_handle) -> None:
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise RuntimeError(str(query_handle.exception()))


@query("stream_monitor", _stream_sql("TRUE", seen=False))
def q_stream_monitor(spark, sf):
    """Two polls of the monitor over the crawl snapshots (to 1997, then the rest).

    The second poll restarts from the first one's checkpoint; alerts are
    read back from the partitioned alert folder.
    """
    src = scratch_path(spark, "snapshots")
    out, ckpt = scratch_path(spark, "monitor"), scratch_path(spark, "monitor-ckpt")
    snaps = _snapshots(spark, sf).select(*MN.SNAPSHOT_SCHEMA.fieldNames())
    for cond in ("snapshot <= 1997", "snapshot > 1997"):
        snaps.where(cond).write.mode("append").partitionBy("snapshot").parquet(src)
        _run(MN.monitor(spark, src, out, ckpt, PR, available_now=True, digits=1))
    return spark.read.parquet(f"{out}/alerts").select(*ALERT_COLS)


@query("monitor_once", _stream_sql("crawled_at >= TIMESTAMP '1998-01-01 00:00:00'", seen=True))
def q_monitor_once(spark, sf):
    """One cycle over the crawls from 1998 on, against the store of earlier crawls."""
    src = _stage(spark, sf, "snapshot >= 1998")
    out, ckpt = scratch_path(spark, "monitor"), scratch_path(spark, "monitor-ckpt")
    _run(MN.monitor(spark, src, out, ckpt, PR, available_now=True, seed_store=_written_seen(spark, sf), digits=1))
    return spark.read.parquet(f"{out}/alerts").select(*ALERT_COLS)


@query("stream_first_seen", O.with_(O.ctes_fixture(), f"SELECT DISTINCT {O.listing_id_sql()} AS listing_id FROM fx"))
def q_stream_first_seen(spark, sf):
    """Each listing id once, the first time the stream carries it (stateful dedupe)."""
    src = _stage(spark, sf, "true")
    out, ckpt = scratch_path(spark, "first-seen"), scratch_path(spark, "first-seen-ckpt")
    _run(MN.first_seen(spark, src, out, ckpt))
    return spark.read.parquet(out).select("listing_id")


@query("stream_registry", O.with_(O.ctes_fixture(), f"""SELECT listing_id, title, price, url, source, snapshot AS first_snapshot,
  max(snapshot) OVER (PARTITION BY listing_id) AS last_snapshot, count(*) OVER (PARTITION BY listing_id) AS sightings
  FROM (SELECT *, {O.listing_id_sql()} AS listing_id, CAST(year(crawled_at) AS BIGINT) AS snapshot FROM fx)
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY snapshot, seq) = 1"""))
def q_stream_registry(spark, sf):
    """The registry after two polls of the crawl snapshots (to 1997, then the rest), the second from the first one's state."""
    src, out, ckpt = (scratch_path(spark, n) for n in ("snapshots", "registry", "registry-ckpt"))
    snaps = _snapshots(spark, sf).select(*MN.SNAPSHOT_SCHEMA.fieldNames())
    for cond in ("snapshot <= 1997", "snapshot > 1997"):
        snaps.where(cond).write.mode("append").partitionBy("snapshot").parquet(src)
        _run(MN.registry(spark, src, out, ckpt))
    return MN.read_registry(spark, out)


# extraction queries register themselves into QUERIES / SQL on import
from lodgeflow.plans import catalog_extract  # noqa: E402,F401


@query("group_arrays", O.with_(O.ctes_search() + [
    "r AS (SELECT *, row_number() OVER (PARTITION BY priority_group ORDER BY type_ord, tier_ord, recent_ord, "
    "price_key, seq) AS group_pos FROM s)"],
    """SELECT priority_group, CAST((group_pos - 1) // 500 AS BIGINT) AS chunk_no, count(*) AS n,
  list(seq ORDER BY group_pos) AS seqs, list(title ORDER BY group_pos) AS titles FROM r GROUP BY ALL"""))
def q_group_arrays(spark, sf):
    """Each priority group's listings as rank-ordered arrays of at most 500 entries."""
    return AG.group_arrays(searched(spark, sf), 500)
