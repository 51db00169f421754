"""Embedded JSON: JSON-LD objects and script data, as VARIANT columns.

The scripts come from the one pass over a page (:mod:`lodgeflow.operators.markup`),
which also finds the listing objects inside data scripts.  Here they are parsed
with ``try_parse_json`` (bad JSON becomes null and is skipped), flattened with
``explode`` over ``array<variant>`` views and mapped to listing fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.text import col, contains_any
from lodgeflow.operators.markup import fragments, walk_blocks

# ---------------------------------------------------------------------------
# FIXED VALUES: other names of one member, in the order they are tried
# ---------------------------------------------------------------------------
JSONLD = {
    "title": ("name", "headline"), "url": ("url", "@id"), "offers": ("offers",), "address": ("address",),
    "beds": ("numberOfBedrooms", "numberOfRooms"), "baths": ("numberOfBathroomsTotal", "numberOfFullBathrooms"), "area": ("floorSize",),
    "phone": ("telephone", "phone"), "name": ("name",), "text": ("description",),
    "price": ("price",), "price_range": ("priceRange",), "low_price": ("lowPrice",),
}
JSONLD_OFFER = {"price": ("price", "lowPrice"), "url": ("url",)}
JSONLD_ADDRESS = {"street": ("streetAddress",), "city": ("addressLocality",), "state": ("addressRegion",), "zip": ("postalCode",)}
APARTMENTS = {
    "title": ("propertyName", "listingName", "name", "title"), "url": ("listingUrl", "url", "detailUrl", "link"),
    "rent": ("rent", "pricing"), "price": ("price", "rentRange"), "beds": ("bedrooms", "beds"), "baths": ("bathrooms", "baths"),
    "address": ("address", "location"), "phone": ("phone", "phoneNumber", "contactPhone"),
}
APARTMENTS_RENT = {"amount": ("min", "low", "max")}
APARTMENTS_ROOMS = {"least": ("min", "low")}
APARTMENTS_ADDRESS = {"street": ("streetAddress", "street", "line1"), "city": ("city", "addressLocality"), "state": ("state", "addressRegion"),
                      "zip": ("zip", "postalCode", "zipCode")}
ZILLOW = {
    "title": ("statusText", "title", "buildingName"), "url": ("detailUrl", "url"), "price": ("price", "unformattedPrice", "rentZestimate"),
    "beds": ("beds", "bedrooms"), "baths": ("baths", "bathrooms"), "area": ("area", "livingArea"), "address": ("address",),
    "street": ("addressStreet", "streetAddress"), "city": ("addressCity", "city"), "state": ("addressState", "state"),
    "zip": ("addressZipcode", "zipcode"), "phone": ("phone", "phoneNumber", "contactPhone"), "date": ("datePosted", "listingDateTimeOnMarket"),
}
ZILLOW_ADDRESS = {"street": ("streetAddress",), "city": ("city",), "state": ("state",), "zip": ("zipcode", "zip")}
ZILLOW_HOME = ("price", "rentZestimate", "zestimate")
RENT = {
    "title": ("propertyName", "name", "title"), "url": ("listingUrl", "url", "detailUrl"), "rent": ("rent",), "price": ("price", "rent"),
    "beds": ("bedrooms", "beds"), "baths": ("bathrooms", "baths"), "area": ("squareFeet", "sqft", "area"), "address": ("address",),
    "pets": ("petPolicy", "pets"), "phone": ("phone", "phoneNumber"),
}
RENT_RENT = {"amount": ("min", "max")}
RENT_ADDRESS = {"street": ("streetAddress", "line1"), "city": ("city",), "state": ("state",), "zip": ("zip", "postalCode")}
# ---------------------------------------------------------------------------


# ------------------------------------------------------------------ variant helpers

def vget(v, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(col(v), path, typ)


OBJECT, ARRAY, STRING, VOID = "{", "[", '"', "n"      # first characters of JSON texts
FALSE_RE = r'^(?:""|false|null|\[\]|\{\}|-?0(?:\.0+)?(?:[eE][+-]?\d+)?)$'


def vtype(v) -> Column:
    """The kind of a JSON value: the first character of its text (a digit or minus: a number); null for null."""
    return F.substring(F.to_json(col(v)), 1, 1)


def truthy(v) -> Column:
    """Python truthiness of a JSON value: null, 0, '', false, [] and {} are false."""
    return F.coalesce(~F.to_json(col(v)).rlike(FALSE_RE), F.lit(False))


def vstr(v) -> Column:
    """str() of a JSON scalar; '' for null."""
    return F.coalesce(vget(v, "$", "string"), F.lit(""))


def is_object(v) -> Column:
    return vget(v, "$", "map<string,variant>").isNotNull()


def is_array(v) -> Column:
    return vget(v, "$", "array<variant>").isNotNull()


def has_key(v, key: str) -> Column:
    return vget(v, f'$["{key}"]').isNotNull()


def num_text_to_long(s: Column) -> Column:
    """int(float(text without ',' and '$')); null when that fails."""
    clean = F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    d = clean.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) > 9.2e18), F.lit(None)).otherwise(d.try_cast("bigint"))


def first_number(s: Column) -> Column:
    """First run of digits and commas, commas removed, as a number (null if only commas)."""
    return F.replace(F.regexp_extract(F.replace(s, F.lit("$"), F.lit("")), r"[\d,]+", 0), F.lit(","),
                     F.lit("")).try_cast("bigint")


def studio_or_count(v) -> Column:
    """int(x) == 0 -> 'Studio', else str(int(x)); null when not an integer."""
    n = F.when(vtype(v) == STRING, vget(v, "$", "string").try_cast("bigint")).otherwise(vget(v, "$", "bigint"))
    return F.when(n == 0, F.lit("Studio")).when(n.isNotNull(), n.cast("string"))


# ------------------------------------------------------------------ JSON-LD

def jsonld_objects(scripts: DataFrame, keys) -> DataFrame:
    """Every object of JSON-LD scripts (keys..., script_no, item): top-level arrays flattened, bad JSON skipped."""
    parsed = scripts.select(*keys, "script_no", F.try_parse_json("item").alias("v")).where(F.col("v").isNotNull())
    items = F.coalesce(vget("v", "$", "array<variant>"), F.array("v"))
    return parsed.select(*keys, F.col("script_no").alias("block_no"), F.posexplode(items).alias("item_no", "item")).where(is_object("item"))


def jsonld_blocks(pages: DataFrame, keys) -> DataFrame:
    """Every JSON-LD object of pages; block_no counts a page's scripts."""
    return jsonld_objects(fragments(pages, keys, ("jsonld",)), keys)


def expand_graph(items: DataFrame, keys, market_sources=("apartments.com", "zillow", "rent.com")) -> DataFrame:
    """Market sources read the nodes of an ``@graph`` instead of its wrapper."""
    graph = vget("item", '$["@graph"]', "array<variant>")
    use = F.col("source").isin(*market_sources) & has_key("item", "@graph")
    nodes = F.when(use, F.coalesce(graph, F.array())).otherwise(F.array("item"))
    out = items.select("*", F.posexplode(nodes).alias("node_no", "node"), use.alias("from_graph"))
    return out.where(is_object("node")).drop("item").withColumnRenamed("node", "item")


def jsonld_admit(items: DataFrame) -> DataFrame:
    """apartments.com: a housing @type or an address or name; zillow/rent.com: address (graph
    nodes) or address/name (plain items); other sources take every object."""
    ld_type = F.lower(F.coalesce(
        F.array_join(vget("item", '$["@type"]', "array<string>"), " "), vstr(vget("item", '$["@type"]'))))
    housing = contains_any(ld_type, P.JSONLD_HOUSING_TYPES)
    addr, name = truthy(vget("item", "$.address")), truthy(vget("item", "$.name"))
    src = F.col("source")
    ok = (F.when(src == "apartments.com", housing | addr | name)
          .when(src.isin("zillow", "rent.com"), F.when(F.col("from_graph"), addr).otherwise(addr | name))
          .otherwise(F.lit(True)))
    return items.where(ok)


def _members(df: DataFrame, base: str, names: dict, prefix: str) -> DataFrame:
    """Stage the first true member of each alias list (else the last one) as a column ``prefix_field``, its type
    as ``prefix_field_ty``. Staging keeps later rules small: they refer to columns, not to lookups."""
    single = {k for ks in names.values() for k in ks if len(ks) > 1}
    df = df.withColumns({f"{prefix}__{_n(k)}": vget(base, f'$["{k}"]') for k in {k for ks in names.values() for k in ks}})
    df = df.withColumns({f"{prefix}__{_n(k)}_t": truthy(f"{prefix}__{_n(k)}") for k in single})

    def chosen(ks) -> Column:
        out = F.col(f"{prefix}__{_n(ks[-1])}")
        for k in reversed(ks[:-1]):
            out = F.when(F.col(f"{prefix}__{_n(k)}_t"), F.col(f"{prefix}__{_n(k)}")).otherwise(out)
        return out
    df = df.withColumns({f"{prefix}_{f}": chosen(ks) for f, ks in names.items()})
    return df.withColumns({f"{prefix}_{f}_ty": vtype(f"{prefix}_{f}") for f in names})


def _n(key: str) -> str:
    """Column name of a member (column names are case-insensitive: zipCode != zipcode)."""
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in key).replace("@", "at_")


def _is(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c + "_ty") == kind, F.lit(False))


def jsonld_to_listing(items: DataFrame, default_city: str, default_state: str) -> DataFrame:
    """Field mapping of a schema.org object to listing columns."""
    df = _members(items, "item", JSONLD, "l")
    df = df.withColumn("l_offer", F.when(_is("l_offers", ARRAY), vget("l_offers", "$[0]")).otherwise(F.col("l_offers")))
    df = _members(df, "l_offer", JSONLD_OFFER, "lo")
    df = _members(df, "l_address", JSONLD_ADDRESS, "la")
    df = df.withColumns({"l_size": vget("l_area", "$.value"), "l_desc": vstr("l_text")})
    title = vstr("l_title")
    title = F.when(title != "", title).otherwise(F.substring("l_desc", 1, 60))
    amounts = [F.when(truthy("lo_price"), num_text_to_long(vstr("lo_price")))]
    amounts += [F.when(truthy(c), first_number(vstr(c))) for c in ("l_price", "l_price_range", "l_low_price")]
    url = vstr("l_url")
    inside = _is("l_address", OBJECT)
    in_place = lambda c, default: F.when(inside, F.coalesce(F.nullif(vstr(c), F.lit("")), F.lit(default))).otherwise(F.lit(""))
    low = F.lower("l_desc")
    beds_desc = F.coalesce(F.nullif(F.regexp_extract(low, r"(\d+)\s*(?:bed|br|bedroom)", 1), F.lit("")),
                           F.when(low.contains("studio"), F.lit("Studio")))
    return df.select(
        *items.columns, title.alias("title"), F.coalesce(*amounts).alias("price"), F.when(url != "", url).otherwise(vstr("lo_url")).alias("url"),
        F.when(inside, vstr("la_street")).when(_is("l_address", STRING), vstr("l_address")).otherwise(F.lit("")).alias("address"),
        in_place("la_city", default_city).alias("city"), in_place("la_state", default_state).alias("state"), in_place("la_zip", "").alias("zip_code"),
        F.coalesce(studio_or_count("l_beds"), F.when(F.col("l_desc") != "", beds_desc), F.lit("")).alias("bedrooms"),
        vget("l_baths", "$", "double").alias("bathrooms"),
        F.when(_is("l_area", OBJECT) & truthy("l_size"), num_text_to_long(vstr("l_size"))).alias("sqft"), vstr("l_phone").alias("phone"),
        contains_any(F.lower(F.concat(vstr("l_name"), F.col("l_desc"))), P.SENIOR_KEYWORDS).alias("senior_hint"))


def jsonld_housing_type(source: Column, senior_hint: Column, kind: Column) -> Column:
    """Section 8 source: section8; market sources: market; others subsidized, or senior on
    keywords or a senior search page, but one source's search pages are subsidized whatever they say."""
    return (F.when(source == "gosection8.com", F.lit(P.TYPE_SECTION8))
            .when((source == "hud.gov") & (kind == "search"), F.lit(P.TYPE_SUBSIDIZED))
            .when(source.isin("nchousingsearch.org", "hud.gov", "affordablehousing.com"),
                  F.when(senior_hint | (kind == "senior"), F.lit(P.TYPE_SENIOR)).otherwise(F.lit(P.TYPE_SUBSIDIZED)))
            .otherwise(F.lit(P.TYPE_MARKET)))


# ------------------------------------------------------------------ script data

def script_blocks(pages: DataFrame, keys) -> DataFrame:
    """Script data of pages as (keys..., script_no, part, v), by each source's rule: see markup._blocks."""
    blocks = fragments(pages, keys, ("block",))
    return blocks.select(*keys, "script_no", "part", F.try_parse_json("item").alias("v")).where(F.col("v").isNotNull())


def json_walk(blocks: DataFrame, keys) -> DataFrame:
    """Listing objects inside script data, as (keys..., script_no, part, pos, hit_path, item).

    At an object, (apartments.com) the object itself when it has a name-like and a
    data-like key; then every element of a known-key array and the hits below
    known-key objects; only when that gave nothing, the hits below all children.
    In an array, an object with a marker key is a hit, other containers are
    searched, to any depth. ``pos`` counts a block's hits in that order.
    """
    return walk_blocks(blocks, [*keys, "script_no", "part"])


def _abs(url: Column, base: Column) -> Column:
    return F.when((url != "") & ~url.startswith("http"), F.concat(base, url)).otherwise(url)


def _num_or_text(v) -> Column:
    """int for JSON numbers; first [digits,] group of strings; null otherwise."""
    t = vtype(v)
    return (F.when(t.rlike("[-0-9]"), vget(v, "$", "double").try_cast("bigint"))
            .when(t == STRING, first_number(vget(v, "$", "string"))))


OUT_FIELDS = ("title", "url", "price", "bedrooms", "bathrooms", "sqft", "address", "city", "state", "zip_code",
              "phone", "date_posted", "pet_policy")


def _phone_of(c: str) -> Column:
    return F.when(_is(c, OBJECT), vstr(vget(c, "$.number"))).otherwise(vstr(c))


def _given(c: str) -> Column:
    """Whether a member is there and not null."""
    return F.col(c).isNotNull() & (F.col(c + "_ty") != VOID)


def _apts(df: DataFrame, base: str) -> DataFrame:
    df = _members(df, "item", APARTMENTS, "i")
    df = _members(_members(df, "i_rent", APARTMENTS_RENT, "ir"), "i_address", APARTMENTS_ADDRESS, "ia")
    df = _members(_members(df, "i_beds", APARTMENTS_ROOMS, "ib"), "i_baths", APARTMENTS_ROOMS, "it")
    inside = _is("i_address", OBJECT)
    in_place = lambda c: F.when(inside, vstr(c)).otherwise(F.lit(""))
    beds = (F.when(_is("i_beds", OBJECT), F.when(F.coalesce(vget("ib_least", "$", "double"), F.lit(0.0)) != 0,
                                                   vget("ib_least", "$", "bigint").cast("string")).otherwise(F.lit("Studio")))
            .when(_given("i_beds"), studio_or_count("i_beds")))
    return df.select(
        "*", vstr("i_title").alias("title"), _abs(vstr("i_url"), F.lit(base)).alias("url"),
        F.coalesce(F.when(_is("i_rent", OBJECT), _num_or_text("ir_amount")), _num_or_text("i_price")).alias("price"), beds.alias("bedrooms"),
        F.when(_is("i_baths", OBJECT), vget("it_least", "$", "double")).otherwise(vget("i_baths", "$", "double")).alias("bathrooms"),
        F.lit(None).cast("bigint").alias("sqft"),
        F.when(_is("i_address", STRING), vstr("i_address")).otherwise(in_place("ia_street")).alias("address"),
        in_place("ia_city").alias("city"), in_place("ia_state").alias("state"), in_place("ia_zip").alias("zip_code"),
        _phone_of("i_phone").alias("phone"), F.lit("").alias("date_posted"), F.lit("").alias("pet_policy"))


def _zillow(df: DataFrame, base: str, default_city: str, default_state: str) -> DataFrame:
    df = _members(_members(df, "item", ZILLOW, "i"), "i_address", ZILLOW_ADDRESS, "ia")
    home = [vget("item", f"$.hdpData.homeInfo.{k}", "double") for k in ZILLOW_HOME]
    inside, line = _is("i_address", OBJECT), _is("i_address", STRING)

    def place(c: str, default: str) -> Column:
        """The address's own, unless it is the default, which a member beside the address may tell better."""
        own = (F.when(inside, F.coalesce(vget(f"ia_{c}", "$", "string"), F.lit(default))).when(line, F.lit(default)).otherwise(F.lit("")))
        beside = F.coalesce(F.nullif(vstr(f"i_{c}"), F.lit("")), F.lit(default))
        return F.when(own.isin("", default), beside).otherwise(own)
    df = df.withColumn("z_street", F.when(inside, vstr("ia_street")).when(line, vstr("i_address")).otherwise(F.lit("")))
    df = df.withColumn("z_street", F.when(F.col("z_street") != "", F.col("z_street")).otherwise(vstr("i_street")))
    own_zip = F.when(inside, vstr("ia_zip")).otherwise(F.lit(""))
    return df.select(
        "*", F.when(vstr("i_title") != "", vstr("i_title")).otherwise(F.col("z_street")).alias("title"),
        _abs(vstr("i_url"), F.lit(base)).alias("url"),
        F.coalesce(_num_or_text("i_price"), *[F.when(h > 0, h.cast("bigint")) for h in home]).alias("price"),
        studio_or_count("i_beds").alias("bedrooms"), vget("i_baths", "$", "double").alias("bathrooms"), vget("i_area", "$", "bigint").alias("sqft"),
        F.col("z_street").alias("address"), place("city", default_city).alias("city"), place("state", default_state).alias("state"),
        F.when(own_zip != "", own_zip).otherwise(vstr("i_zip")).alias("zip_code"), _phone_of("i_phone").alias("phone"),
        vstr("i_date").alias("date_posted"), F.lit("").alias("pet_policy"))


def _rent(df: DataFrame, base: str, default_city: str, default_state: str) -> DataFrame:
    df = _members(df, "item", RENT, "i")
    df = _members(_members(df, "i_rent", RENT_RENT, "ir"), "i_address", RENT_ADDRESS, "ia")
    inside = _is("i_address", OBJECT)
    in_place = lambda c, default: F.when(inside, F.coalesce(vget(c, "$", "string"), F.lit(default))).otherwise(F.lit(""))
    fewest = vget("i_beds", "$.min")
    beds = (F.when(_is("i_beds", OBJECT), F.when(F.coalesce(vget(fewest, "$", "double"), F.lit(0.0)) == 0, F.lit("Studio"))
                   .otherwise(vstr(fewest)))
            .when(_given("i_beds"), studio_or_count("i_beds")))
    least = lambda c, kind: F.when(_is(c, OBJECT), vget(c, "$.min", kind)).otherwise(vget(c, "$", kind))
    return df.select(
        "*", vstr("i_title").alias("title"), _abs(vstr("i_url"), F.lit(base)).alias("url"),
        F.when(_is("i_rent", OBJECT), _num_or_text("ir_amount")).when(truthy("i_rent"), _num_or_text("i_price")).alias("price"),
        beds.alias("bedrooms"), least("i_baths", "double").alias("bathrooms"), least("i_area", "bigint").alias("sqft"),
        F.when(inside, vstr("ia_street")).when(_is("i_address", STRING), vstr("i_address")).otherwise(F.lit("")).alias("address"),
        in_place("ia_city", default_city).alias("city"), in_place("ia_state", default_state).alias("state"),
        F.when(inside, vstr("ia_zip")).otherwise(F.lit("")).alias("zip_code"), vstr("i_phone").alias("phone"), F.lit("").alias("date_posted"),
        F.when(_is("i_pets", OBJECT), F.when(truthy(vget("i_pets", "$.allowed")), F.lit("Cats/Dogs"))
               .otherwise(F.lit("No Pets"))).otherwise(vstr("i_pets")).alias("pet_policy"))


def script_to_listing(hits: DataFrame, default_city: str, default_state: str) -> DataFrame:
    """Per-source alias chains from a script listing object to listing columns (objects only).

    Each source family gets its own projection over its own rows, which keeps
    the generated code per projection small.
    """
    objs = hits.where(is_object("item"))
    bases = {s: b for _, s, _, b in P.SOURCES}
    keep = list(hits.columns)
    parts = [
        _apts(objs.where(F.col("source") == "apartments.com"), bases["apartments.com"]),
        _zillow(objs.where(F.col("source") == "zillow"), bases["zillow"], default_city, default_state),
        _rent(objs.where(F.col("source") == "rent.com"), bases["rent.com"], default_city, default_state),
    ]
    out = None
    for p in parts:
        p = p.select(*keep, *OUT_FIELDS)
        out = p if out is None else out.unionByName(p)
    return out.withColumns({
        "city": F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit(default_city)),
        "state": F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit(default_state)),
        "bedrooms": F.coalesce(F.col("bedrooms"), F.lit("")),
    })
