"""Reference SQL (DuckDB dialect) for every registered query.

Written independently of the Spark plans: dedupe uses window functions,
ranking a global ``row_number``, classification one CASE per rule.  The
driver runs these on the same parquet tables and compares results.
"""

from __future__ import annotations

from lodgeflow import params as P
from lodgeflow.sources.fixture import FIXTURE_SQL

PR = P.ORACLE
WS = P.PY_WHITESPACE
SUB = "housing_type IN ('subsidized', 'senior', 'section8')"
ZIP_RE = r"\b(\d{5})(?:-\d{4})?\b"


def _lst(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return f"trim({x}, '{WS}')"


def _cutoff(params: P.SearchParams = PR) -> str:
    from datetime import datetime, timedelta
    t = datetime.strptime(params.as_of, "%Y-%m-%d %H:%M:%S") - timedelta(hours=params.recent_hours)
    return t.strftime("%Y-%m-%d %H:%M:%S")


def filter_pred(params: P.SearchParams = PR) -> str:
    b = strip("lower(bedrooms)")
    return (f"(price IS NULL OR (CASE WHEN {SUB} THEN price <= {params.max_rent * P.SUBSIDIZED_PRICE_FACTOR} "
            f"ELSE price BETWEEN {params.min_rent} AND {params.max_rent} END))"
            f" AND ({b} = '' OR {b} IN ({_lst(params.bedroom_labels())}))"
            f" AND (state = '' OR upper(state) = '{params.state.upper()}')")


POSTED_SQL = r"""CASE
  WHEN regexp_matches(_s, '^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$') THEN try_strptime(_s, '%Y-%m-%dT%H:%M:%S')
  WHEN regexp_matches(_s, '^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$') THEN try_strptime(_s, '%Y-%m-%d %H:%M:%S')
  WHEN regexp_matches(_s, '^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$') THEN try_strptime(_s, '%Y-%m-%d %H:%M')
  WHEN regexp_matches(_s, '^\d{4}-\d{1,2}-\d{1,2}$') THEN try_strptime(_s, '%Y-%m-%d')
  WHEN regexp_matches(_s, '^\d{1,2}/\d{1,2}/\d{4}$') THEN try_strptime(_s, '%m/%d/%Y')
  WHEN regexp_matches(_s, '^[A-Za-z]{3} \d{1,2}, \d{4}$') THEN try_strptime(_s, '%b %d, %Y')
END"""


def ctes_fixture() -> list[str]:
    return [f"fx AS ({FIXTURE_SQL})"]


def ctes_filter(src: str, name: str, params: P.SearchParams = PR) -> list[str]:
    return [f"{name} AS (SELECT * FROM {src} WHERE {filter_pred(params)})"]


def ctes_dedupe(src: str, name: str) -> list[str]:
    return [
        f"{name}_u AS (SELECT * FROM {src} QUALIFY url = '' OR row_number() OVER "
        f"(PARTITION BY url = '', lower(rtrim(url, '/')) ORDER BY seq) = 1)",
        f"{name} AS (SELECT * FROM {name}_u QUALIFY title = '' OR row_number() OVER "
        f"(PARTITION BY {strip('lower(title)')}, price ORDER BY seq) = 1)",
    ]


def ctes_classify(src: str, name: str, params: P.SearchParams = PR) -> list[str]:
    pref = _lst([a.lower() for a in params.preferred_areas])
    exp = _lst([a.lower() for a in params.expanded_areas])
    pref_txt = " OR ".join(f"contains(_text, '{a.lower()}')" for a in params.preferred_areas)
    exp_txt = " OR ".join(f"contains(_text, '{a.lower()}')" for a in params.expanded_areas)
    as_of_min = params.as_of[:16]
    return [
        f"{name}_a AS (SELECT *, concat_ws(', ', nullif(address, ''), nullif(city, ''), nullif(state, ''), "
        f"nullif(zip_code, '')) AS full_address FROM {src})",
        f"{name}_b AS (SELECT *, CASE WHEN full_address <> '' THEN '{P.DIRECTIONS_PREFIX}' || "
        f"replace(url_encode(full_address), '%20', '+') ELSE '' END AS directions_url, "
        f"{strip('zip_code')} AS _zs, "
        f"CASE WHEN full_address <> '' THEN regexp_extract(full_address, '{ZIP_RE}', 1) ELSE '' END AS _z1, "
        f"CASE WHEN address <> '' THEN regexp_extract(address, '{ZIP_RE}', 1) ELSE '' END AS _z2, "
        f"{strip('lower(city)')} AS _city, "
        f"lower(address || ' ' || neighborhood || ' ' || full_address) AS _text, "
        r"regexp_replace(substr(date_posted, 1, 19), '\s+', ' ', 'g') AS _s "
        f"FROM {name}_a)",
        f"{name}_c AS (SELECT *, CASE WHEN _zs <> '' THEN _zs WHEN _z1 <> '' THEN _z1 WHEN _z2 <> '' THEN _z2 "
        f"ELSE '' END AS _zip, {POSTED_SQL} AS _posted FROM {name}_b)",
        f"{name} AS (SELECT * EXCLUDE (zip_code, _zs, _z1, _z2, _city, _text, _s, _zip, _posted), "
        f"CASE WHEN _zs <> '' THEN zip_code WHEN _z1 <> '' THEN _z1 WHEN _z2 <> '' THEN _z2 ELSE zip_code END "
        f"AS zip_code, "
        f"CASE WHEN _city IN ({pref}) OR _zip IN ({_lst(params.preferred_zips)}) OR {pref_txt} THEN 'preferred' "
        f"WHEN _city IN ({exp}) OR {exp_txt} THEN 'expanded' ELSE 'other' END AS location_tier, "
        f"coalesce(_posted >= TIMESTAMP '{_cutoff(params)}', false) AS is_recent, "
        f"'{as_of_min}' AS date_scraped "
        f"FROM {name}_c)",
    ]


def ctes_keys(src: str, name: str) -> list[str]:
    return [
        f"{name} AS (SELECT *, CASE WHEN {SUB} THEN 0 ELSE 1 END AS type_ord, "
        f"CASE location_tier WHEN 'preferred' THEN 0 WHEN 'expanded' THEN 1 ELSE 2 END AS tier_ord, "
        f"CASE WHEN is_recent THEN 0 ELSE 1 END AS recent_ord, "
        f"coalesce(price, {P.UNRANKED_PRICE}) AS price_key, "
        f"CASE WHEN {SUB} THEN 1 WHEN location_tier = 'preferred' THEN 2 "
        f"WHEN location_tier = 'expanded' THEN 3 ELSE 4 END AS priority_group FROM {src})"
    ]


def ctes_search(params: P.SearchParams = PR) -> list[str]:
    """fx -> f (filtered) -> d (deduped) -> c (classified) -> s (keys and group)."""
    return (ctes_fixture() + ctes_filter("fx", "f", params) + ctes_dedupe("f", "d")
            + ctes_classify("d", "c", params) + ctes_keys("c", "s"))


def ctes_classified_fixture(params: P.SearchParams = PR) -> list[str]:
    """The whole fixture classified (no filter, no dedupe): ``k``."""
    return ctes_fixture() + ctes_classify("fx", "cf", params) + ctes_keys("cf", "k")


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


LISTING_COLS = ("seq, title, price, bedrooms, bathrooms, sqft, address, city, state, zip_code, neighborhood, "
                "url, source, date_posted, phone, contact_name, amenities, pet_policy, housing_type")
SEARCH_COLS = (LISTING_COLS + ", full_address, directions_url, location_tier, is_recent, date_scraped, "
               "priority_group, type_ord, tier_ord, recent_ord, price_key")
RANK_SQL = "row_number() OVER (ORDER BY type_ord, tier_ord, recent_ord, price_key, seq) AS rank"


def listing_id_sql(prefix: str = "") -> str:
    p = prefix
    return (f"md5(CASE WHEN {p}url <> '' THEN lower({p}url) ELSE concat_ws('|', lower({p}title), "
            f"coalesce(CAST({p}price AS VARCHAR), 'None'), lower({p}address)) END)")


def price_label_sql(missing: str) -> str:
    return (f"CASE WHEN price IS NULL THEN '{missing}' WHEN price = 0 AND {SUB} THEN 'Income-Based' "
            f"ELSE '$' || format('{{:,}}', price) END")


def label_sql(col: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {col} {whens} ELSE '{default}' END"


TYPE_LABEL_SQL = label_sql("housing_type", P.TYPE_LABELS, P.DEFAULT_TYPE_LABEL)
TIER_LABEL_SQL = label_sql("location_tier", P.TIER_LABELS, P.DEFAULT_TIER_LABEL)
SHORT_FLOAT_SQL = (r"regexp_replace(regexp_replace(CAST(CAST(bathrooms AS DECIMAL(38, 10)) AS VARCHAR), "
                   r"'0+$', ''), '\.$', '')")
BEDS_BATHS_SQL = (f"CASE WHEN bathrooms IS NOT NULL AND bathrooms <> 0 THEN "
                  f"(CASE WHEN bedrooms <> '' THEN bedrooms ELSE '?' END) || 'bd/' || {SHORT_FLOAT_SQL} || 'ba' "
                  f"ELSE (CASE WHEN bedrooms <> '' THEN bedrooms ELSE '?' END) || 'bd' END")
PHONE_LINK_SQL = ("CASE WHEN replace(phone, '|', '/') IN ('', '-') THEN '-' "
                  "WHEN length(regexp_replace(replace(phone, '|', '/'), '[^0-9]', '', 'g')) >= 10 THEN "
                  "'[' || replace(phone, '|', '/') || '](tel:' || regexp_replace(phone, '[^0-9]', '', 'g') || ')' "
                  "ELSE replace(phone, '|', '/') END")
SHORT_TITLE_SQL = f"CASE WHEN length(title) > {P.TITLE_CUT} THEN substr(title, 1, {P.TITLE_CUT}) || '...' ELSE title END"
MD_ROW_SQL = (
    f"'| ' || concat_ws(' | ', "
    f"{price_label_sql(P.MISSING_PRICE_MARKDOWN)} || CASE WHEN is_recent THEN ' **NEW**' ELSE '' END, "
    f"{BEDS_BATHS_SQL}, "
    f"replace(CASE WHEN city <> '' THEN city ELSE '?' END, '|', '/'), "
    f"replace(coalesce(nullif(full_address, ''), nullif(address, ''), nullif(city, ''), '?'), '|', '/'), "
    f"CASE WHEN phone <> '' THEN {PHONE_LINK_SQL} ELSE '-' END, "
    f"CASE WHEN date_posted <> '' THEN date_posted ELSE '-' END, "
    f"{TYPE_LABEL_SQL}, "
    f"replace({SHORT_TITLE_SQL}, '|', '/'), "
    f"CASE WHEN url <> '' THEN '[' || CASE WHEN source <> '' THEN source ELSE '?' END || '](' || url || ')' "
    f"ELSE '-' END, "
    f"CASE WHEN directions_url <> '' THEN '[Map](' || directions_url || ')' ELSE '-' END) || ' |'"
)


def alert_sql(num: str) -> str:
    nl = "chr(10)"
    return (
        f"concat_ws({nl}, '', '  [' || CAST({num} AS VARCHAR) || '] ' || title, "
        f"'      Type:     ' || {TYPE_LABEL_SQL}, "
        f"'      Price:    ' || {price_label_sql(P.MISSING_PRICE_CSV)} || '/mo', "
        f"'      Beds:     ' || CASE WHEN bedrooms <> '' THEN bedrooms ELSE 'N/A' END, "
        f"'      Location: ' || coalesce(nullif(full_address, ''), nullif(address, ''), city), "
        f"'      Area:     ' || {TIER_LABEL_SQL}, "
        f"CASE WHEN phone <> '' THEN '      Phone:    ' || phone END, "
        f"'      Link:     ' || url, "
        f"CASE WHEN directions_url <> '' THEN '      Directions: ' || directions_url END, "
        f"'      Source:   ' || source)"
    )


def mail_sql(num: str) -> str:
    return (
        f"concat_ws(chr(10), '--- Listing ' || CAST({num} AS VARCHAR) || ' ---', 'Name:      ' || title, 'Type:      ' || {TYPE_LABEL_SQL}, "
        f"'Price:     ' || {price_label_sql(P.MISSING_PRICE_CSV)} || '/mo', "
        f"'Beds:      ' || CASE WHEN bedrooms <> '' THEN bedrooms ELSE 'N/A' END, "
        f"'Address:   ' || CASE WHEN full_address <> '' THEN full_address ELSE address END, 'Area:      ' || {TIER_LABEL_SQL}, "
        f"CASE WHEN phone <> '' THEN 'Phone:     ' || phone END, 'Link:      ' || url, "
        f"CASE WHEN directions_url <> '' THEN 'Directions: ' || directions_url END, 'Source:    ' || source, '')"
    )
