"""Registered extraction queries (pages -> listings) with their reference SQL.

Driver ``pages`` and ``documents`` feed the generic rules (cards, text,
links, phones); round-trip pages rendered from the listings fixture feed the
listing rules, strategies and page policies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.operators import extract as EX
from lodgeflow.operators import json_extract as JX
from lodgeflow.operators import pages as PG
from lodgeflow.plans import extract_plan as XP
from lodgeflow.plans import oracle as O
from lodgeflow.plans import oracle_extract as OX
from lodgeflow.plans.catalog import fx, query
from lodgeflow.sources import roundtrip as RT
from lodgeflow.sources.tables import read_table

PR = P.DEFAULT
PK = ["source", "search_city", "city_ord", "page_no"]
PKS = ", ".join(PK)


def driver_pages(spark, sf) -> DataFrame:
    return read_table(spark, sf, "pages")


def rt_pages(spark, sf, general: bool = False) -> DataFrame:
    return RT.roundtrip_pages(spark, sf, PR, general)


def _pos():
    """A listing's place in its page: on these pages one part of it at most differs from 0."""
    return (F.col("item_pos.a") + F.col("item_pos.b") + F.col("item_pos.c")).cast("int").alias("item_pos")


def rt_cards(spark, sf) -> DataFrame:
    """One rendered card per fixture listing, with its source (no page assembly)."""
    return fx(spark, sf).select("seq", "source", RT.card_html().alias("card")) \
        .withColumn("_t", EX.text_of(F.col("card")))


def _w(ctes, sql):
    return O.with_(ctes, sql)


# ---------------------------------------------------------------- driver pages and documents

@query("scan_pages", """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, url,
  length(html) AS n_chars FROM pages""")
def q_scan_pages(spark, sf):
    """Crawled pages with the site they came from (host of the url)."""
    return driver_pages(spark, sf).select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
                                          .alias("source"), "url", F.length("html").cast("bigint").alias("n_chars"))


_CARDS_SQL = ["c0 AS (SELECT page_id, regexp_extract_all(html, " + OX.q(EX.CARD_RE) + ") AS m, "
              "regexp_extract_all(html, " + OX.q(EX.CARD_FALLBACK_RE) + ") AS fb FROM pages)",
              "c1 AS (SELECT page_id, CASE WHEN len(m) > 0 THEN m ELSE fb END AS arr FROM c0)",
              "c2 AS (SELECT page_id, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS card "
              "FROM c1)"]


@query("ext_cards", _w(_CARDS_SQL, "SELECT page_id, pos, card FROM c2"))
def q_ext_cards(spark, sf):
    """Pages split into cards (main pattern, fallback patterns only when none matched)."""
    return EX.cards(driver_pages(spark, sf), ["page_id"]).select("page_id", "pos", "card")


@query("ext_text", _w(_CARDS_SQL, f"SELECT page_id, pos, {OX.text_of('card')} AS text FROM c2"))
def q_ext_text(spark, sf):
    return EX.cards(driver_pages(spark, sf), ["page_id"]).select("page_id", "pos", EX.text_of("card").alias("text"))


@query("ext_card_gate", _w(_CARDS_SQL + [f"c3 AS (SELECT page_id, pos, {OX.text_of('card')} AS t FROM c2)"],
                           "SELECT page_id, pos, (" + " OR ".join(f"contains(lower(t), {OX.q(k)})"
                                                                 for k in P.HOUSING_GATE_KEYWORDS)
                           + f") AS housing_gate, {OX.state_gate('t')} AS state_gate FROM c3"))
def q_ext_card_gate(spark, sf):
    """Card gates: housing keywords (locator) and state name with length > 20 (section 8 search)."""
    c = EX.cards(driver_pages(spark, sf), ["page_id"]).withColumn("t", EX.text_of("card"))
    return c.select("page_id", "pos", EX.housing_gate("t").alias("housing_gate"), EX.state_gate("t").alias("state_gate"))


_CONT_SQL = OX.ctes_cards() + [
    f"pg AS (SELECT {PKS}, string_agg(card, chr(10) ORDER BY seq) AS html FROM rc GROUP BY ALL)",
    f"k0 AS (SELECT {PKS}, " + " || ".join(
        f"regexp_extract_all(html, {OX.q(rf'(?s)<{t}\b[^>]*>.*?</{t}>')})" for t in EX.CONTAINER_TAGS)
    + " AS arr FROM pg)",
    f"k1 AS (SELECT {PKS}, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS pos, unnest(arr) AS card FROM k0)",
    f"k2 AS (SELECT *, {OX.text_of('card')} AS t FROM k1)"]


@query("ext_container_fallback", _w(_CONT_SQL, f"""SELECT {PKS}, pos, card FROM k2
  WHERE length({OX.strip('t')}) > 30 AND regexp_matches(t, '\\$\\d+')
  AND regexp_matches(t, '(?i)(?:bed|br|studio|apartment|housing)')"""))
def q_ext_container_fallback(spark, sf):
    """Listing-like containers (over 30 characters, a $ amount and a housing word): the card-less fallback."""
    return EX.container_fallback(rt_pages(spark, sf, general=True), PK).select(*PK, "pos", "card")


@query("ext_links_title", f"""WITH a0 AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base,
  regexp_extract_all(html, {OX.q(EX.ANCHOR_RE)}, 1) AS h, regexp_extract_all(html, {OX.q(EX.ANCHOR_RE)}, 2) AS t
  FROM pages),
a1 AS (SELECT page_id, base, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS pos, unnest(h) AS href,
  unnest(t) AS inner_html FROM a0)
SELECT page_id, pos, {OX.absolute_url('href', 'base')} AS href, {OX.strip(OX.text_of('inner_html'))} AS text FROM a1""")
def q_ext_links_title(spark, sf):
    """Every anchor: absolute href (relative ones joined to the site) and its text."""
    return EX.links(driver_pages(spark, sf), ["page_id"]).select("page_id", "pos", "href", "text")


@query("ext_phone", f"SELECT doc_id, {OX.phone('text')} AS phone FROM documents")
def q_ext_phone(spark, sf):
    """First US phone number of each document (whole texts)."""
    return read_table(spark, sf, "documents").select("doc_id", EX.phone(F.col("text")).alias("phone"))


# ---------------------------------------------------------------- field rules on rendered cards

CARD_CTES = O.ctes_fixture() + [f"rc AS (SELECT seq, source, {OX.CARD} AS card FROM fx)",
                                f"rt AS (SELECT *, {OX.text_of('card')} AS _t FROM rc)"]


def _card_q(name: str, sql_cols: str, spark_cols):
    def fn(spark, sf):
        return rt_cards(spark, sf).select("seq", *spark_cols())
    fn.__name__ = f"q_{name}"
    query(name, _w(CARD_CTES, f"SELECT seq, {sql_cols} FROM rt"))(fn)


PRICE_EL = OX.element_text("card", "span", "price")
_card_q("ext_price_first", f"{OX.price_first(PRICE_EL)} AS price_first",
        lambda: [EX.price_first(EX.element_text("card", "span", "price")).alias("price_first")])
_card_q("ext_price_min", f"{OX.price_min('_t', 0, 2000, False)} AS price_subsidized, "
        f"{OX.price_min('_t', 50, 3000, True)} AS price_enrich, {OX.price_min(PRICE_EL)} AS price_any",
        lambda: [EX.price_min("_t", 0, 2000, False).alias("price_subsidized"),
                 EX.price_min("_t", 50, 3000, True).alias("price_enrich"),
                 EX.price_min(EX.element_text("card", "span", "price")).alias("price_any")])
_card_q("ext_income_based", f"{OX.income_based(OX.price_min('_t', 0, 2000, False), '_t', EX.INCOME_OR_CALL_RE)} "
        f"AS price",
        lambda: [EX.income_based(EX.price_min("_t", 0, 2000, False), "_t", EX.INCOME_OR_CALL_RE).alias("price")])
_card_q("ext_bedrooms", ", ".join(f"{OX.bedrooms('_t', p)} AS beds_{k}" for k, p in EX.BEDS_RE.items())
        + f", {OX.bedrooms(OX.element_text('card', 'span', 'beds'), EX.BEDS_RE['bed_br_bd'], True)} AS beds_studio_first",
        lambda: [EX.bedrooms("_t", p).alias(f"beds_{k}") for k, p in EX.BEDS_RE.items()]
        + [EX.bedrooms(EX.element_text("card", "span", "beds"), EX.BEDS_RE["bed_br_bd"], True)
           .alias("beds_studio_first")])
_card_q("ext_bathrooms", ", ".join(f"{OX.bathrooms('_t', p)} AS baths_{k}" for k, p in EX.BATHS_RE.items()),
        lambda: [EX.bathrooms("_t", p).alias(f"baths_{k}") for k, p in EX.BATHS_RE.items()])
_card_q("ext_sqft", ", ".join(f"{OX.sqft('_t', p)} AS sqft_{k}" for k, p in EX.SQFT_RE.items()),
        lambda: [EX.sqft("_t", p).alias(f"sqft_{k}") for k, p in EX.SQFT_RE.items()])
_card_q("ext_date", f"{OX.posted('_t')} AS date_posted", lambda: [EX.posted("_t").alias("date_posted")])
_CSZ = OX.csz_parts("_t", PR.city, PR.state)
_card_q("ext_city_state_zip", f"{_CSZ[0]} AS city, {_CSZ[1]} AS state, {_CSZ[2]} AS zip_code",
        lambda: [EX.city_state_zip("_t", PR.city, PR.state).alias("c").getField(k).alias(k)
                 for k in ("city", "state", "zip_code")])
_card_q("ext_street", f"{OX.street('_t')} AS street", lambda: [EX.street("_t").alias("street")])
_LOC = "regexp_replace(" + OX.element_text("card", "div", "location") + ", '^Location: ', '')"
_ADDR_LINE = f"concat_ws(', ', {OX.element_text('card', 'div', 'address')}, {_LOC})"
_SPLIT = OX.split_address(_ADDR_LINE, PR.city)
_card_q("ext_address_split", f"{_SPLIT[0]} AS city, {_SPLIT[1]} AS state, {_SPLIT[2]} AS zip_code",
        lambda: [EX.split_address(F.concat_ws(", ", EX.element_text("card", "div", "address"),
                                              F.regexp_replace(EX.element_text("card", "div", "location"),
                                                               "^Location: ", "")), PR.city)
                 .getField(k).alias(k) for k in ("city", "state", "zip_code")])
_card_q("ext_amenities", f"{OX.amenities('_t')} AS amenities", lambda: [EX.amenities("_t").alias("amenities")])
_DEFAULT_TYPE = ("CASE source WHEN 'gosection8.com' THEN 'section8' WHEN 'nchousingsearch.org' THEN 'subsidized' WHEN 'hud.gov' THEN "
                 "'subsidized' WHEN 'affordablehousing.com' THEN 'subsidized' ELSE 'market' END")
_card_q("ext_housing_type", f"{OX.senior_type('_t', _DEFAULT_TYPE)} AS housing_type",
        lambda: [EX.senior_type("_t", F.col("source"), F.coalesce(*[F.when(F.col("source") == k, F.lit(t))
                                                                    for k, t in EX.DEFAULT_TYPES.items()], F.lit("market")))
                 .alias("housing_type")])


@query("ext_enrich", _w(CARD_CTES, f"""SELECT seq, CASE WHEN seq % 3 = 0 THEN 77 ELSE {OX.price_min('_t', 50, 3000, True)} END AS price,
  CASE WHEN seq % 4 = 0 THEN '9' ELSE {OX.bedrooms('_t')} END AS bedrooms,
  CASE WHEN seq % 5 = 0 THEN 7.5 ELSE {OX.bathrooms('_t')} END AS bathrooms,
  CASE WHEN seq % 6 = 0 THEN '1-800' ELSE {OX.phone('_t')} END AS phone,
  CASE WHEN seq % 7 = 0 THEN 'today' ELSE {OX.posted('_t')} END AS date_posted FROM rt"""))
def q_ext_enrich(spark, sf):
    """Fill-only-if-missing pass over listings that have some of their fields already."""
    have = lambda n, v: F.when(F.col("seq") % n == 0, F.lit(v))
    some = rt_cards(spark, sf).select("seq", "_t", have(3, 77).cast("bigint").alias("price"), F.coalesce(have(4, "9"), F.lit("")).alias("bedrooms"),
                                      have(5, 7.5).alias("bathrooms"), F.coalesce(have(6, "1-800"), F.lit("")).alias("phone"),
                                      F.coalesce(have(7, "today"), F.lit("")).alias("date_posted"))
    return EX.enrich(some, "_t").select("seq", "price", "bedrooms", "bathrooms", "phone", "date_posted")


@query("ext_default_city", _w(O.ctes_fixture(), f"""SELECT seq, CASE WHEN city <> '' THEN city ELSE
  {OX.q(PR.city)} END AS city, CASE WHEN state <> '' THEN state ELSE {OX.q(PR.state)} END AS state FROM fx"""))
def q_ext_default_city(spark, sf):
    return EX.default_city(fx(spark, sf), PR.city, PR.state).select("seq", "city", "state")


# ---------------------------------------------------------------- strategies on round-trip pages

@query("ext_listings_html", _w(OX.ctes_html_listings(), f"SELECT {OX.HTML_COLS} FROM hl"))
def q_ext_listings_html(spark, sf):
    """Listings read from the HTML cards of every page, each in its source's own markup."""
    out = XP.html_strategy(rt_pages(spark, sf), PR)
    return out.select(*[c.strip() for c in OX.HTML_COLS.split(",")])


@query("ext_admit", _w(OX.ctes_html_listings(), f"SELECT {PKS}, pos, title, url FROM hl"))
def q_ext_admit(spark, sf):
    """Extracted cards that carry a title or a url."""
    return XP.html_strategy(rt_pages(spark, sf), PR).select(*PK, "pos", "title", "url")


_LD_ALL = OX.ctes_cards() + [
    "lb AS (SELECT source, search_city, city_ord, page_no, CASE WHEN source IN ('apartments.com', 'zillow', 'rent.com') "
    "THEN 0 ELSE pos END AS block_no, CASE WHEN source IN ('apartments.com', 'zillow', 'rent.com') THEN pos ELSE 0 END "
    "AS node_no, title AS name FROM rc)"]


@query("json_ld_blocks", _w(_LD_ALL, f"""SELECT DISTINCT {PKS}, block_no, 0 AS item_no,
  CASE WHEN source IN ('apartments.com', 'zillow', 'rent.com') THEN '' ELSE name END AS name FROM lb"""))
def q_json_ld_blocks(spark, sf):
    """JSON-LD objects per page (arrays flattened, bad JSON skipped); name of each object."""
    b = JX.jsonld_blocks(rt_pages(spark, sf), PK)
    return b.select(*PK, "block_no", "item_no", JX.vstr(JX.vget("item", "$.name")).alias("name"))


@query("json_ld_graph", _w(_LD_ALL, f"SELECT {PKS}, block_no, node_no, name FROM lb"))
def q_json_ld_graph(spark, sf):
    """Objects after expanding @graph (market sources)."""
    g = JX.expand_graph(JX.jsonld_blocks(rt_pages(spark, sf), PK), PK)
    return g.select(*PK, "block_no", "node_no", JX.vstr(JX.vget("item", "$.name")).alias("name"))


_ADMIT = f"""o AS (SELECT {PKS}, pos, CAST(count(*) OVER (PARTITION BY {PKS}) AS INTEGER) AS n, source IN ('apartments.com', 'zillow', 'rent.com') AS market,
  seq % 5 = 1 AS typed, seq % 7 IN (1, 2) AS named, seq % 11 < 4 AS placed FROM rc),
p AS (SELECT *, market AS from_graph, CASE WHEN market THEN 0 ELSE n + pos END AS block_no, CASE WHEN market THEN n + pos ELSE 0 END AS node_no FROM o
  UNION ALL SELECT *, FALSE, 1 + pos, 0 FROM o WHERE market)"""


@query("json_ld_admit", _w(_LD_ALL + [_ADMIT], f"""SELECT {PKS}, block_no, node_no FROM lb
  UNION ALL SELECT {PKS}, block_no, node_no FROM p WHERE CASE source WHEN 'apartments.com' THEN typed OR named OR placed
    WHEN 'zillow' THEN placed OR (named AND NOT from_graph) WHEN 'rent.com' THEN placed OR (named AND NOT from_graph) ELSE TRUE END"""))
def q_json_ld_admit(spark, sf):
    """Objects of all pages admitted as listings by each source's @type / address / name test; beside each listing's own object
    the pages hold sparse ones, some to be rejected."""
    pages = RT.roundtrip_pages(spark, sf, PR, sparse=True)
    a = JX.jsonld_admit(JX.expand_graph(JX.jsonld_blocks(pages, PK), PK))
    return a.select(*PK, "block_no", "node_no")


@query("json_ld_to_listing", _w(OX.ctes_jsonld_listings(), f"SELECT {OX.JSONLD_COLS} FROM jl"))
def q_json_ld_to_listing(spark, sf):
    """Listing fields mapped from schema.org objects."""
    out = XP.jsonld_strategy(rt_pages(spark, sf), PR).withColumn("item_pos", _pos())
    return out.select(*[c.strip() for c in OX.JSONLD_COLS.split(",")])


@query("ext_housing_type_jsonld", _w(OX.ctes_jsonld_listings(), f"SELECT {PKS}, item_pos, housing_type FROM jl"))
def q_ext_housing_type_jsonld(spark, sf):
    """Housing type of JSON-LD listings: source default, senior on name+description keywords."""
    return XP.jsonld_strategy(rt_pages(spark, sf), PR).select(*PK, _pos(), "housing_type")


_MARKET = "('apartments.com', 'zillow', 'rent.com')"


@query("script_json_blocks", _w(OX.ctes_cards(), f"""SELECT {PKS}, 1 AS script_no, 0 AS part,
  CAST(count(*) AS INTEGER) AS n_results FROM rc WHERE source IN {_MARKET} GROUP BY ALL"""))
def q_script_json_blocks(spark, sf):
    """Script data blocks of market pages and how many results each carries."""
    pages = rt_pages(spark, sf).where(F.col("source").isin(*XP.MARKET))
    b = JX.script_blocks(pages, PK)
    n = F.size(JX.vget("v", "$.props.pageProps.searchResults.listResults", "array<variant>"))
    return b.select(*PK, F.col("script_no").cast("int").alias("script_no"), F.col("part").cast("int").alias("part"),
                    n.cast("int").alias("n_results"))


@query("json_listing_walk", _w(OX.ctes_cards(), f"""SELECT {PKS}, 1 AS script_no, 0 AS part, pos,
  '/props/pageProps/searchResults/listResults/' || lpad(pos::VARCHAR, 10, '0') AS hit_path FROM rc WHERE source IN {_MARKET}"""))
def q_json_listing_walk(spark, sf):
    """Listing objects found in script data, with their paths."""
    pages = rt_pages(spark, sf).where(F.col("source").isin(*XP.MARKET))
    return JX.json_walk(JX.script_blocks(pages, PK), PK).select(*PK, "script_no", "part", "pos", "hit_path")


@query("script_json_to_listing", _w(OX.ctes_script_listings(), f"SELECT {OX.SCRIPT_COLS} FROM sl"))
def q_script_json_to_listing(spark, sf):
    """Listing fields mapped from script data objects by each source's alias chains."""
    out = XP.script_strategy(rt_pages(spark, sf), PR).withColumn("item_pos", _pos())
    return out.select(*[c.strip() for c in OX.SCRIPT_COLS.split(",")])


# ---------------------------------------------------------------- page policies

def _cands_sql() -> list[str]:
    ctes = OX.ctes_html_listings()
    ctes += OX.ctes_jsonld_listings()[len(OX.ctes_cards()):]
    ctes += OX.ctes_script_listings()[len(OX.ctes_cards()):]
    ctes += [
        f"cand AS (SELECT {PKS}, kind, 'html' AS strategy, pos AS item_pos, title, url, price, bedrooms, city, state, "
        f"zip_code, neighborhood, housing_type FROM hl UNION ALL "
        f"SELECT {PKS}, kind, 'jsonld', item_pos, title, url, price, bedrooms, city, state, zip_code, '', housing_type "
        f"FROM jl UNION ALL "
        f"SELECT {PKS}, kind, 'script', item_pos, title, url, price, bedrooms, city, state, zip_code, '', 'market' FROM sl)",
        f"qual AS (SELECT {PKS}, kind, strategy, count(price) AS priced, count(*) FILTER (WHERE bedrooms <> '') AS bedded, "
        f"count(*) AS rows FROM cand GROUP BY ALL)",
    ]
    order = " ".join(f"WHEN source = {OX.q(s)} AND strategy = {OX.q(st)} THEN {i}"
                     for s, (_, sts) in PG.STRATEGY_POLICY.items() for i, st in enumerate(sts))
    ctes += [
        f"qo AS (SELECT *, CASE {order} END AS _ord FROM qual)",
        f"best AS (SELECT {PKS}, strategy FROM qo WHERE source IN {_MARKET} QUALIFY row_number() OVER "
        f"(PARTITION BY {PKS} ORDER BY priced DESC, bedded DESC, rows DESC, _ord) = 1)",
        f"fbm AS (SELECT *, min(_ord) OVER (PARTITION BY {PKS}) AS _min FROM qo "
        f"WHERE source NOT IN {_MARKET} AND _ord IS NOT NULL)",
        f"fb AS (SELECT {PKS}, strategy FROM fbm WHERE source = 'hud.gov' AND kind = 'search' OR _ord = _min)",
        f"chosen AS (SELECT c.* FROM cand c JOIN (SELECT * FROM best UNION ALL SELECT * FROM fb) k "
        f"USING ({PKS}, strategy))",
    ]
    return ctes


@query("union_all_cities", _w(_cands_sql(), f"SELECT {PKS}, strategy, item_pos, title FROM cand"))
def q_union_all_cities(spark, sf):
    """All strategies' listings across sources, cities and pages (union all)."""
    return XP.candidates(rt_pages(spark, sf), PR, ("title",)).select(*PK, "strategy", _pos(), "title")


@query("strategy_quality", _w(_cands_sql(), f"SELECT {PKS}, strategy, priced, bedded, rows FROM qual"))
def q_strategy_quality(spark, sf):
    """Completeness of each strategy on each page: priced rows, rows with bedrooms, rows."""
    return PG.strategy_quality(XP.candidates(rt_pages(spark, sf), PR, PG.QUALITY_FIELDS), PK)


@query("page_best_strategy", _w(_cands_sql(), f"SELECT {PKS}, strategy FROM best"))
def q_page_best_strategy(spark, sf):
    """Market pages: the strategy with the richest data."""
    c = XP.candidates(rt_pages(spark, sf).where(F.col("source").isin(*XP.MARKET)), PR, PG.QUALITY_FIELDS)
    return PG.best_strategy(c, PK).select(*PK, "strategy").distinct()


@query("page_fallback_strategy", _w(_cands_sql(), f"SELECT {PKS}, strategy FROM fb"))
def q_page_fallback_strategy(spark, sf):
    """Other pages: the first non-empty strategy in the source's order (hud.gov: all)."""
    c = XP.candidates(rt_pages(spark, sf).where(~F.col("source").isin(*XP.MARKET)), PR, ())
    return PG.fallback_strategy(c, PK).select(*PK, "strategy").distinct()


_TROUBLE = (f"tp AS (SELECT DISTINCT {PKS}, kind, source IN ('rent.com', 'hud.gov', 'affordablehousing.com', 'gosection8.com') AND city_ord % 3 = 1 "
            f"AND page_no IN (0, 2, 6) AS failed, source <> 'rent.com' AND city_ord % 4 = 2 AND page_no = 3 AS empty FROM rc)")


@query("page_limit", _w(OX.ctes_cards(), f"""SELECT DISTINCT {PKS} FROM rc
  WHERE kind <> 'search' OR page_no <= CASE WHEN source = 'hud.gov' THEN 3 ELSE 4 END"""))
def q_page_limit(spark, sf):
    """Pages within a cap of 4 a search (3 for the hud.gov section-8 search; locator and senior pages have none)."""
    return PG.page_limit(rt_pages(spark, sf), 4).select(*PK)


@query("paging_stops", _w(OX.ctes_cards(), f"""SELECT DISTINCT {PKS} FROM rc WHERE CASE source
  WHEN 'apartments.com' THEN page_no <= CASE WHEN city_ord % 4 = 3 THEN 1 ELSE 4 - city_ord % 4 END
  WHEN 'craigslist' THEN page_no <= CASE WHEN city_ord % 2 = 0 THEN 1 + city_ord % 5 ELSE 2 END ELSE TRUE END"""))
def q_paging_stops(spark, sf):
    """Pages up to the one that says there are no more, by its links or its stated total of listings."""
    return PG.paging_stops(RT.with_paging(rt_pages(spark, sf))).select(*PK)


@query("source_error_policy", _w(OX.ctes_cards() + [_TROUBLE], f"""SELECT {PKS} FROM tp WHERE NOT failed AND source <> 'rent.com'
  AND (kind <> 'search' OR source NOT IN ('hud.gov', 'affordablehousing.com', 'gosection8.com') OR city_ord % 3 <> 1 OR page_no < 2)"""))
def q_source_error_policy(spark, sf):
    """Pages left after fetch errors: rent.com is lost, three searches stop at page 2, locator and senior pages fail alone."""
    return PG.error_policy(RT.troubled(rt_pages(spark, sf))).select(*PK)


@query("page_prefix", _w(_cands_sql() + [_TROUBLE], f"""SELECT {PKS}, strategy, item_pos FROM chosen JOIN tp USING ({PKS}) WHERE NOT empty
  AND (tp.kind <> 'search' OR source IN ('rent.com', 'hud.gov') OR city_ord % 4 <> 2 OR page_no < 3)"""))
def q_page_prefix(spark, sf):
    """Chosen listings of pages before each search's first empty page (its third, in a fourth of the searches)."""
    pages = RT.troubled(rt_pages(spark, sf)).withColumn("error", F.lit(None).cast("string"))
    chosen = PG.choose_strategy(XP.candidates(pages, PR, PG.QUALITY_FIELDS))
    return PG.page_prefix(chosen, pages).select(*PK, "strategy", _pos())


def _tag_sql(hood: str) -> str:
    other = f"lower(search_city) <> {OX.q(PR.city.lower())}"
    hit = f"({other} AND ({OX.strip('lower(city)')} = {OX.q(PR.city.lower())} OR city = ''))"
    new = (f"CASE WHEN {hood} = '' THEN search_city WHEN NOT contains(lower({hood}), lower(search_city)) "
           f"THEN {hood} || ', ' || search_city ELSE {hood} END")
    return f"CASE WHEN {hit} THEN {new} ELSE {hood} END"


@query("tag_search_city", _w(_cands_sql(), f"""SELECT {PKS}, strategy, item_pos, city, {_tag_sql('neighborhood')}
  AS neighborhood FROM chosen WHERE source IN {_MARKET}"""))
def q_tag_search_city(spark, sf):
    """Market listings found by another city's search carry that city in the neighborhood."""
    pages = rt_pages(spark, sf).where(F.col("source").isin(*XP.MARKET))
    chosen = PG.choose_strategy(XP.candidates(pages, PR, (*PG.QUALITY_FIELDS, "city", "neighborhood")))
    return EX.tag_search_city(chosen, PR.city).select(*PK, "strategy", _pos(), "city", "neighborhood")


_SRC_ORD = "CASE " + " ".join(f"WHEN source = {OX.q(s)} THEN {i}" for i, (_, s, _, _) in enumerate(P.SOURCES)) + " END"
_STRAT_ORD = "CASE " + " ".join(f"WHEN source = {OX.q(s)} AND strategy = {OX.q(st)} THEN {i}"
                                for s, (_, sts) in PG.STRATEGY_POLICY.items() for i, st in enumerate(sts)) + " END"
EXTRACT_COLS = ["seq", "source", "title", "url", "price", "bedrooms", "city", "state", "zip_code", "neighborhood",
                "housing_type"]


@query("extract_pages", _w(_cands_sql(), f"""SELECT row_number() OVER (ORDER BY {_SRC_ORD}, city_ord, page_no, {_STRAT_ORD}, item_pos) AS seq,
  source, title, url, price, bedrooms, city, state, zip_code, CASE WHEN source IN {_MARKET} THEN {_tag_sql('neighborhood')} ELSE neighborhood
  END AS neighborhood, housing_type FROM chosen"""))
def q_extract_pages(spark, sf):
    """All pages to listings: strategies, page policies, search-city tags, crawl order."""
    return XP.extract_listings(rt_pages(spark, sf), PR).select(*EXTRACT_COLS)
