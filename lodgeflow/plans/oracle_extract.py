"""Reference SQL (DuckDB) for extraction queries.

Field rules on single cards: DuckDB renders the same general cards from the
listings fixture and applies the same patterns (RE2), so Java-vs-RE2 and rule
plumbing are checked.  Whole listings, from each source's own markup, from JSON-LD
and from script data: the expected fields are stated directly from the fixture
columns (what a correct extraction must give), independent of how the Spark job
reads the pages.
"""

from __future__ import annotations

from lodgeflow import params as P
from lodgeflow.operators import extract as EX
from lodgeflow.plans import oracle as O
from lodgeflow.sources import roundtrip as RT

PR = P.DEFAULT


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return O.strip(x)


def text_of(x: str) -> str:
    t = f"regexp_replace({x}, '(?s)<[^>]*>', '', 'g')"
    for ent, ch in EX.ENTITIES:
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    return t


def element_text(card: str, tag: str, cls: str) -> str:
    return strip(text_of(f"regexp_extract({card}, {q(rf'(?s)<{tag}\b[^>]*class=\"{cls}\"[^>]*>(.*?)</{tag}>')}, 1)"))


def to_long(x: str) -> str:
    return f"TRY_CAST(replace(replace({x}, '$', ''), ',', '') AS BIGINT)"


def price_first(t: str) -> str:
    return to_long(f"regexp_extract({t}, {q(EX.PRICE_RE)}, 0)")


def price_min(t: str, lo=None, hi=None, incl=True) -> str:
    conds = ["n IS NOT NULL"]
    if lo is not None:
        conds.append(f"n {'>=' if incl else '>'} {lo}")
    if hi is not None:
        conds.append(f"n <= {hi}")
    return (f"list_min(list_filter(list_transform(regexp_extract_all({t}, {q(EX.PRICE_RE)}), "
            f"lambda x: {to_long('x')}), lambda n: {' AND '.join(conds)}))")


def income_based(price: str, t: str, pattern: str) -> str:
    return f"CASE WHEN ({price}) IS NULL AND regexp_matches(lower({t}), {q(pattern)}) THEN 0 ELSE ({price}) END"


def bedrooms(t: str, pattern: str = EX.BEDS_RE["bed_br_bd"], studio_first: bool = False) -> str:
    low = f"lower({t})"
    num = f"nullif(regexp_extract({low}, {q(pattern)}, 1), '')"
    if studio_first:
        return f"coalesce(CASE WHEN contains({low}, 'studio') THEN 'Studio' END, {num}, '')"
    studio = f"CASE WHEN contains({low}, 'studio') OR contains({low}, 'efficiency') THEN 'Studio' END"
    return f"coalesce({num}, {studio}, '')"


def bathrooms(t: str, pattern: str = EX.BATHS_RE["bath_ba_word"]) -> str:
    return f"TRY_CAST(nullif(regexp_extract(lower({t}), {q(pattern)}, 1), '') AS DOUBLE)"


def sqft(t: str, pattern: str) -> str:
    return f"TRY_CAST(replace(regexp_extract(lower({t}), {q(pattern)}, 1), ',', '') AS BIGINT)"


def phone(t: str, tel: str | None = None) -> str:
    found = f"nullif({strip(f'regexp_extract({t}, {q(EX.PHONE_RE)}, 1)')}, '')"
    parts = [f"nullif({strip(f'replace({tel}, {q(EX.TEL_PREFIX)}, {q(str())})')}, '')"] if tel else []
    return f"coalesce({', '.join(parts + [found])}, '')"


def posted(t: str) -> str:
    return f"regexp_extract(lower({t}), {q(EX.DATE_RE)}, 1)"


def csz_parts(t: str, city_default: str, state_default: str):
    hit = f"regexp_matches({t}, {q(EX.CSZ_RE)})"
    g1 = strip(f"regexp_extract({t}, {q(EX.CSZ_RE)}, 1)")
    city = strip(f"string_split({g1}, chr(10))[-1]")
    return (f"CASE WHEN {hit} THEN {city} ELSE {q(city_default)} END",
            f"CASE WHEN {hit} THEN 'NC' ELSE {q(state_default)} END",
            f"CASE WHEN {hit} THEN regexp_extract({t}, {q(EX.CSZ_RE)}, 2) ELSE '' END")


def street(t: str) -> str:
    return strip(f"regexp_extract({t}, {q(EX.STREET_RE)}, 1)")


def split_address(t: str, default_city: str):
    parts = f"string_split({t}, ',')"
    n = f"len({parts})"
    sz = f"list_filter(regexp_split_to_array({strip(f'{parts}[-1]')}, '\\s+'), lambda x: x <> '')"
    city = f"CASE WHEN {n} >= 3 THEN {strip(f'{parts}[-2]')} WHEN {n} = 2 THEN {q(default_city)} END"
    return (f"CASE WHEN {n} >= 2 THEN {city} ELSE '' END",
            f"CASE WHEN {n} >= 2 AND len({sz}) >= 1 THEN {sz}[1] ELSE '' END",
            f"CASE WHEN {n} >= 2 AND len({sz}) >= 2 THEN {sz}[2] ELSE '' END")


def amenities(t: str) -> str:
    low = f"lower({t})"
    return "concat_ws(', ', " + ", ".join(
        f"CASE WHEN contains({low}, {q(k)}) THEN {q(k.title())} END" for k in P.AMENITY_KEYWORDS) + ")"


def senior_type(t: str, default: str) -> str:
    low = f"lower({t})"
    conds = []
    for src, kws in P.SENIOR_KEYWORDS_BY_SOURCE:
        conds.append(f"(source = {q(src)} AND (" + " OR ".join(f"contains({low}, {q(k)})" for k in kws) + "))")
    return f"CASE WHEN {' OR '.join(conds)} THEN 'senior' ELSE {default} END"


def absolute_url(href: str, base: str) -> str:
    return (f"CASE WHEN {href} = '' OR starts_with({href}, '#') OR regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} "
            f"ELSE {base} || '/' || ltrim({href}, '/') END")


def state_gate(t: str) -> str:
    return f"(length({strip(t)}) > 20 AND regexp_matches({t}, '(?i)(NC|north carolina)'))"


# ------------------------------------------------------------------ rendering (same as the Spark source)

def esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


FEATURES = ("concat_ws(' ', CASE WHEN housing_type = 'senior' THEN 'Seniors 62+' END, "
            "CASE WHEN price IS NULL THEN 'No pets' END, CASE WHEN bathrooms >= 1 THEN 'Laundry' END, "
            "CASE WHEN zip_code <> '' THEN 'Parking' END)")
CARD = ("concat_ws(chr(10), '<article class=\"card\">', "
        f"'<h2><a href=\"' || {esc('url')} || '\">' || {esc('title')} || '</a></h2>', "
        "'<span class=\"price\">' || CASE WHEN price IS NULL THEN 'Call for rent' WHEN price = 0 THEN 'Income based' "
        "ELSE '$' || format('{:,}', price) END || '</span>', "
        "'<span class=\"beds\">' || CASE WHEN regexp_matches(bedrooms, '^\\d+$') THEN bedrooms || ' bed' "
        "ELSE bedrooms END || '</span>', "
        f"'<span class=\"baths\">' || CASE WHEN bathrooms IS NULL THEN '' ELSE {O.SHORT_FLOAT_SQL} || ' bath' END "
        "|| '</span>', "
        "'<span class=\"sqft\">' || CASE WHEN bathrooms IS NULL THEN '' ELSE "
        "format('{:,}', CAST(500 * (1 + bathrooms) AS BIGINT)) || ' sq ft' END || '</span>', "
        f"'<div class=\"address\">' || {esc('address')} || '</div>', "
        f"'<div class=\"location\">Location: ' || {esc('city')} || ', ' || state || ' ' || zip_code || '</div>', "
        "'<span class=\"phone\">' || phone || '</span>', "
        "'<span class=\"posted\">Posted: ' || date_posted || '</span>', "
        f"'<p class=\"features\">' || {FEATURES} || '</p>', '</article>')")


LINK = ("CASE WHEN seq % 29 = 0 THEN regexp_replace(url, '^https://(?:ex|EX)[.]org', '') "
        "WHEN seq % 31 = 0 AND url <> '' THEN 'javascript:void(0)' ELSE url END")


def ctes_cards() -> list[str]:
    """``rc``: every fixture listing with its page coordinates, kind of page, position, link and general card."""
    areas = RT.search_areas(PR)
    n = "CASE source WHEN 'hud.gov' THEN 4 WHEN 'affordablehousing.com' THEN 6 ELSE 5 END"
    return O.ctes_fixture() + [
        f"rb AS (SELECT *, CAST(floor(seq / {RT.BLOCK}) AS INTEGER) AS _block FROM fx)",
        f"rp AS (SELECT *, CAST(floor(_block / {n}) AS INTEGER) AS city_ord, "
        f"CAST(_block % {n} + CASE WHEN source = 'hud.gov' THEN 0 ELSE 1 END AS INTEGER) AS page_no FROM rb)",
        f"rc AS (SELECT *, [{', '.join(q(a) for a in areas)}][city_ord % {len(areas)} + 1] AS search_city, "
        f"CASE WHEN source = 'hud.gov' AND page_no = 0 THEN 'locator' WHEN source = 'affordablehousing.com' AND page_no = 6 "
        f"THEN 'senior' ELSE 'search' END AS kind, "
        f"CAST(row_number() OVER (PARTITION BY source, city_ord, page_no ORDER BY seq) - 1 AS INTEGER) AS pos, "
        f"{LINK} AS link, {CARD} AS card FROM rp)",
    ]


# ------------------------------------------------------------------ HTML listings: what each source's page says

NCH, HUD, AFF, GS8 = "'nchousingsearch.org'", "'hud.gov'", "'affordablehousing.com'", "'gosection8.com'"


def ctes_html_listings() -> list[str]:
    """``hl``: HTML-strategy listings of the round-trip pages, admitted, with page keys and pos."""
    base = "CASE source " + " ".join(f"WHEN {q(s)} THEN {q(b)}" for _, s, _, b in P.SOURCES) + " END"
    subsidized = f"source IN ({NCH}, {HUD}, {AFF}, {GS8})"
    # 'City, NC 12345' is read from a card's text only where it stands there in that form, the city in letters
    found = "state = 'NC' AND zip_code <> '' AND regexp_matches(city, '^[A-Za-z ]*$')"
    # the address element's text: its pieces without white space around them
    line = f"{strip('address')} || {strip(chr(39) + ', ' + chr(39) + ' || city || ' + chr(39) + ', ' + chr(39) + ' || state || ' + chr(39) + ' ' + chr(39) + ' || zip_code')}"
    dated = "regexp_extract(date_posted, '^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}')"
    area = "CAST(500 * (1 + bathrooms) AS BIGINT)"
    return ctes_cards() + [
        f"""hx AS (SELECT source, search_city, city_ord, page_no, kind, pos,
  CASE WHEN source = 'zillow' THEN {strip('address')}
       WHEN source = 'apartments.com' AND {strip('title')} = '' AND link <> '' THEN 'View' ELSE {strip('title')} END AS title,
  CASE WHEN link = '' OR starts_with(link, 'http') THEN link
       WHEN source IN ({NCH}, {HUD}, {AFF}) THEN {base} || '/' || ltrim(link, '/')
       WHEN starts_with(link, '/') THEN {base} || link
       WHEN source = {GS8} THEN {base} || '/' || link ELSE link END AS url,
  CASE WHEN source = {NCH} AND coalesce(price, 0) = 0 OR source = {AFF} AND price = 0 THEN 0
       WHEN price > 0 AND (price <= 2000 OR NOT {subsidized}) THEN price END AS price,
  CASE WHEN source = {HUD} THEN '' ELSE bedrooms END AS bedrooms,
  CASE WHEN source NOT IN ({HUD}, {AFF}, 'craigslist') THEN bathrooms END AS bathrooms,
  CASE WHEN source NOT IN ({NCH}, {HUD}, {AFF}) THEN {area} END AS sqft,
  CASE source WHEN {HUD} THEN {street(text_of('card'))} WHEN 'craigslist' THEN neighborhood
       WHEN 'apartments.com' THEN {line} ELSE {strip('address')} END AS address,
  CASE WHEN source = 'craigslist' THEN neighborhood ELSE '' END AS neighborhood,
  CASE WHEN {subsidized} AND {found} THEN {strip('city')} WHEN source = 'apartments.com' AND {strip('city')} <> '' THEN {strip('city')}
       ELSE {q(PR.city)} END AS city,
  CASE WHEN source = 'apartments.com' AND state || zip_code <> '' THEN CASE WHEN state <> '' THEN state ELSE zip_code END
       ELSE {q(PR.state)} END AS state,
  CASE WHEN {subsidized} AND {found} OR source = 'apartments.com' AND state <> '' THEN zip_code ELSE '' END AS zip_code,
  phone,
  CASE WHEN source = 'craigslist' THEN date_posted WHEN source IN ({NCH}, {HUD}, {AFF}) THEN '' ELSE {dated} END AS date_posted,
  CASE WHEN source = {NCH} THEN concat_ws(', ', CASE WHEN bathrooms >= 1 THEN 'Laundry' END, CASE WHEN zip_code <> '' THEN 'Parking' END,
       CASE WHEN price IS NULL THEN 'Pets, No Pets' END) ELSE '' END AS amenities,
  CASE WHEN source = {GS8} THEN 'section8' WHEN NOT {subsidized} THEN 'market' WHEN source = {HUD} AND kind = 'search' THEN 'subsidized'
       WHEN housing_type = 'senior' OR kind = 'senior' THEN 'senior' ELSE 'subsidized' END AS housing_type
  FROM rc WHERE source <> {HUD} OR CASE WHEN kind = 'locator' THEN housing_type = 'senior' ELSE {state_gate(text_of('card'))} END)""",
        "hl AS (SELECT * FROM hx WHERE title <> '' OR url <> '')",
    ]


HTML_COLS = ("source, search_city, city_ord, page_no, kind, pos, title, url, price, bedrooms, bathrooms, sqft, address, "
             "neighborhood, city, state, zip_code, phone, date_posted, amenities, housing_type")


# ------------------------------------------------------------------ JSON-LD and script expectations

def ctes_jsonld_listings() -> list[str]:
    """``jl``: the listing a correct JSON-LD mapping yields for each rendered object."""
    rooms = ("CASE WHEN lower(bedrooms) IN ('studio', '0') THEN 'Studio' "
             "WHEN regexp_matches(bedrooms, '^\\d+$') THEN CAST(CAST(bedrooms AS BIGINT) AS VARCHAR) END")
    hint = ("(" + " OR ".join(f"contains(lower(title || {FEATURES}), {q(k)})" for k in P.SENIOR_KEYWORDS) + ")")
    htype = (f"CASE WHEN source = 'gosection8.com' THEN 'section8' WHEN source = 'hud.gov' AND kind = 'search' THEN 'subsidized' "
             f"WHEN source IN ({NCH}, {HUD}, {AFF}) THEN "
             f"CASE WHEN {hint} OR kind = 'senior' THEN 'senior' ELSE 'subsidized' END ELSE 'market' END")
    return ctes_cards() + [
        f"jx AS (SELECT source, search_city, city_ord, page_no, kind, pos AS item_pos, "
        f"CASE WHEN title <> '' THEN title ELSE substr({FEATURES}, 1, 60) END AS title, "
        f"CASE WHEN price IS NULL OR price = 0 THEN NULL ELSE price END AS price, url, address, "
        f"CASE WHEN city <> '' THEN city ELSE {q(PR.city)} END AS city, "
        f"CASE WHEN state <> '' THEN state ELSE {q(PR.state)} END AS state, zip_code, "
        f"coalesce({rooms}, '') AS bedrooms, CAST(NULL AS DOUBLE) AS bathrooms, CAST(NULL AS BIGINT) AS sqft, "
        f"phone, {htype} AS housing_type FROM rc)",
        "jl AS (SELECT * FROM jx WHERE title <> '' OR url <> '')",
    ]


JSONLD_COLS = ("source, search_city, city_ord, page_no, item_pos, title, price, url, address, city, state, "
               "zip_code, bedrooms, bathrooms, sqft, phone, housing_type")


def ctes_script_listings() -> list[str]:
    """``sl``: the listing a correct script-data mapping yields (market sources only)."""
    zc = f"CASE WHEN city <> '' THEN city ELSE {q(PR.city)} END"
    zs = f"CASE WHEN state <> '' THEN state ELSE {q(PR.state)} END"
    rooms_num = "CASE WHEN lower(bedrooms) IN ('studio', '0') THEN 0 WHEN regexp_matches(bedrooms, '^\\d+$') " \
                "THEN CAST(bedrooms AS BIGINT) END"
    return ctes_cards() + [
        f"sx AS (SELECT source, search_city, city_ord, page_no, kind, pos AS item_pos, "
        f"CASE source WHEN 'zillow' THEN address ELSE title END AS title, "
        f"CASE source WHEN 'zillow' THEN '' ELSE url END AS url, "
        f"CASE WHEN source = 'rent.com' OR price = 0 THEN NULL ELSE price END AS price, "
        f"CASE WHEN source = 'zillow' THEN coalesce(CASE WHEN {rooms_num} = 0 THEN 'Studio' "
        f"ELSE CAST({rooms_num} AS VARCHAR) END, '') "
        f"ELSE coalesce(CASE WHEN {rooms_num} = 0 THEN NULL ELSE CAST({rooms_num} AS VARCHAR) END, '') END AS bedrooms, "
        f"CASE WHEN source = 'zillow' THEN bathrooms WHEN bathrooms = 0 THEN NULL ELSE bathrooms END AS bathrooms, "
        f"address, {zc} AS city, {zs} AS state, zip_code, phone, "
        f"CASE source WHEN 'zillow' THEN date_posted ELSE '' END AS date_posted FROM rc "
        f"WHERE source IN ('apartments.com', 'zillow', 'rent.com'))",
        "sl AS (SELECT * FROM sx WHERE source <> 'apartments.com' OR title <> '' OR url <> '')",
    ]


SCRIPT_COLS = ("source, search_city, city_ord, page_no, item_pos, title, url, price, bedrooms, bathrooms, address, "
               "city, state, zip_code, phone, date_posted")
