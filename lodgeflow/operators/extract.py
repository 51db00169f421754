"""HTML extraction: cards -> listing fields.

The cards of listing pages and the texts of their fields come from
:mod:`lodgeflow.operators.markup`; here each field is a column function over
them, with the sources' differences as branches on ``source``.  For pages of no
known source, ``cards`` splits a page by patterns (narrow: no shuffle); their
text has tags removed and the five basic entities decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.text import col, contains_any, py_strip

# ---------------------------------------------------------------------------
# FIXED VALUES: field patterns (as written for Python's re, common subset)
# ---------------------------------------------------------------------------
PRICE_RE = r"\$[\d,]+"
PHONE_RE = r"(\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4})"
DATE_RE = r"(?:posted|listed|available|updated)[:\s]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
CSZ_RE = r"([A-Za-z\s]+),\s*NC\s*(\d{5})"
STREET_RE = r"(?i)(\d+\s+[A-Za-z\s.]+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct|Pl|Cir)[^,]*)"
INCOME_RE = r"(?:income[- ]based|30%\s*of\s*income|based on income)"
INCOME_OR_CALL_RE = r"(?:income[- ]based|30%\s*of\s*income|based on income|call for)"
BEDS_RE = {
    "bed_br_bd": r"(\d+)\s*(?:bed|br|bd|bedroom)",
    "bed_br": r"(\d+)\s*(?:bed|br|bedroom)",
    "bed_br_bd_gs8": r"(\d+)\s*(?:bed|br|bedroom|bd)",
    "br_only": r"(?i)(\d+)\s*br",
}
BATHS_RE = {
    "bath_ba_word": r"(\d+(?:\.\d+)?)\s*(?:bath|ba\b)",
    "bath_ba": r"(\d+(?:\.\d+)?)\s*(?:bath|ba)",
    "number": r"(\d+(?:\.\d+)?)",
}
SQFT_RE = {
    "sqft_sf": r"([\d,]+)\s*(?:sq\s*ft|sqft|sf)",
    "sqft": r"(?i)([\d,]+)\s*(?:sq\s*ft|sqft)",
    "ft": r"(?i)([\d,]+)\s*ft",
}
CARD_RE = r"(?s)<article\b[^>]*>.*?</article>"
CARD_FALLBACK_RE = "|".join(
    rf'(?s)<{t}\b[^>]*class="[^"]*(?:listing|result|property|placard|card)[^"]*"[^>]*>.*?</{t}>'
    for t in ("div", "li", "tr"))
CONTAINER_TAGS = ("div", "tr", "li", "article", "section")
CONTAINER_WORDS_RE = r"(?i)(?:bed|br|studio|apartment|housing)"
STATE_RE = r"(?i)(?:nc|north carolina)"
ANCHOR_RE = r"(?s)<a\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
TEL_PREFIX = "tel:"
SCHEME_RE = "^[A-Za-z][A-Za-z0-9+.-]*:"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
# ---------------------------------------------------------------------------


# ------------------------------------------------------------------ column functions

def text_of(html) -> Column:
    """Text of an HTML fragment: tags removed, basic entities decoded (&amp; last)."""
    t = F.regexp_replace(col(html), r"(?s)<[^>]*>", "")
    for ent, ch in ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def element_text(card, tag: str, cls: str) -> Column:
    """Stripped text of the first ``<tag class="cls">`` element, '' when absent."""
    inner = F.regexp_extract(col(card), rf'(?s)<{tag}\b[^>]*class="{cls}"[^>]*>(.*?)</{tag}>', 1)
    return py_strip(text_of(inner))


def _to_long(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit("")).try_cast("bigint")


def price_first(text) -> Column:
    """First $-amount as a number; null when none (or when it has no digits)."""
    return _to_long(F.regexp_extract(col(text), PRICE_RE, 0))


def price_min(text, lo: int | None = None, hi: int | None = None, lo_inclusive: bool = True) -> Column:
    """Smallest $-amount within [lo, hi] (lo exclusive if asked); null when none."""
    amounts = F.transform(F.regexp_extract_all(col(text), F.lit(PRICE_RE), F.lit(0)), _to_long)

    def keep(n):
        c = n.isNotNull()
        if lo is not None:
            c = c & ((n >= lo) if lo_inclusive else (n > lo))
        if hi is not None:
            c = c & (n <= hi)
        return c
    return F.array_min(F.filter(amounts, keep))


def income_based(price: Column, text, pattern: str = INCOME_RE) -> Column:
    """0 (income-based) when the price is still unknown and the text says so."""
    return F.when(price.isNull() & F.lower(col(text)).rlike(pattern), F.lit(0).cast("bigint")).otherwise(price)


def bedrooms(text, pattern: str = BEDS_RE["bed_br_bd"], studio_first: bool = False) -> Column:
    """Bedroom count from text, else 'Studio' on studio/efficiency, else ''."""
    low = F.lower(col(text))
    num = F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    studio = F.when(low.contains("studio") | low.contains("efficiency"), F.lit("Studio"))
    if studio_first:
        studio = F.when(low.contains("studio"), F.lit("Studio"))
        return F.coalesce(studio, num, F.lit(""))
    return F.coalesce(num, studio, F.lit(""))


def bathrooms(text, pattern: str = BATHS_RE["bath_ba_word"]) -> Column:
    return F.nullif(F.regexp_extract(F.lower(col(text)), pattern, 1), F.lit("")).try_cast("double")


def sqft(text, pattern: str = SQFT_RE["sqft_sf"]) -> Column:
    raw = F.regexp_extract(F.lower(col(text)), pattern, 1)
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("bigint")


def phone(text, tel: Column | None = None) -> Column:
    """A tel: link target wins; else the first US number in the text; else ''."""
    found = py_strip(F.regexp_extract(col(text), PHONE_RE, 1))
    parts = [F.nullif(py_strip(F.replace(tel, F.lit(TEL_PREFIX), F.lit(""))), F.lit(""))] if tel is not None else []
    return F.coalesce(*parts, F.nullif(found, F.lit("")), F.lit(""))


def posted(text) -> Column:
    """Posted/listed/available/updated date in m/d/y or m-d-y form, raw; '' if none."""
    return F.regexp_extract(F.lower(col(text)), DATE_RE, 1)


def city_state_zip(text, default_city: str, default_state: str) -> Column:
    """struct(city, state, zip) from 'City, NC 12345' (city = last line), else the defaults."""
    t = col(text)
    hit = t.rlike(CSZ_RE)
    g1 = py_strip(F.regexp_extract(t, CSZ_RE, 1))
    city = py_strip(F.element_at(F.split(g1, "\n"), -1))
    return F.struct(F.when(hit, city).otherwise(F.lit(default_city)).alias("city"),
                    F.when(hit, F.lit("NC")).otherwise(F.lit(default_state)).alias("state"),
                    F.when(hit, F.regexp_extract(t, CSZ_RE, 2)).otherwise(F.lit("")).alias("zip_code"))


def street(text) -> Column:
    return py_strip(F.regexp_extract(col(text), STREET_RE, 1))


def split_address(text, default_city: str) -> Column:
    """'street, city, ST 12345' split from the right: struct(city, state, zip_code) ('' when absent)."""
    t = col(text)
    parts = F.split(t, ",")
    n = F.size(parts)
    # rsplit(',', 2): the last two commas separate city and state+zip
    state_zip = F.filter(F.split(py_strip(F.element_at(parts, -1)), r"\s+"), lambda x: x != "")
    city = F.when(n >= 3, py_strip(F.element_at(parts, -2))).when(n == 2, F.lit(default_city))
    has = n >= 2
    return F.struct(F.when(has, city).otherwise(F.lit("")).alias("city"),
                    F.when(has & (F.size(state_zip) >= 1), F.element_at(state_zip, 1)).otherwise(F.lit("")).alias("state"),
                    F.when(has & (F.size(state_zip) >= 2), F.element_at(state_zip, 2)).otherwise(F.lit("")).alias("zip_code"))


def amenities(text) -> Column:
    """Fixed keyword list in order, title-cased labels joined by ', ' ('pets' also hits 'no pets')."""
    low = F.lower(col(text))
    labels = [F.when(low.contains(k), F.lit(k.title())) for k in P.AMENITY_KEYWORDS]
    return F.concat_ws(", ", *labels)


def senior_type(text, source: Column, default: Column) -> Column:
    """Default housing type upgraded to senior when a source keyword occurs."""
    low = F.lower(col(text))
    cond = None
    for src, kws in P.SENIOR_KEYWORDS_BY_SOURCE:
        c = (source == src) & contains_any(low, kws)
        cond = c if cond is None else (cond | c)
    return F.when(cond, F.lit(P.TYPE_SENIOR)).otherwise(default)


def housing_gate(text) -> Column:
    return contains_any(F.lower(col(text)), P.HOUSING_GATE_KEYWORDS)


def state_gate(text) -> Column:
    return (F.length(py_strip(col(text))) > 20) & col(text).rlike(r"(?i)(NC|north carolina)")


def absolute_url(href, base) -> Column:
    """Relative links joined to the site's url; those with a scheme, fragments and '' kept as they are."""
    h = col(href)
    return (F.when((h == "") | h.startswith("#") | h.rlike(SCHEME_RE), h)
            .otherwise(F.concat(col(base), F.lit("/"), F.ltrim(h, F.lit("/")))))


def origin(url) -> Column:
    return F.regexp_extract(col(url), r"^(https?://[^/?#]+)", 1)


# ------------------------------------------------------------------ frame operators

def cards(pages: DataFrame, keys=("page_key",), card_re: str = CARD_RE,
          fallback_re: str | None = CARD_FALLBACK_RE) -> DataFrame:
    """One row per card: (keys..., pos, card).  Fallback patterns only where the main ones found none."""
    main = F.regexp_extract_all(F.col("html"), F.lit(card_re), F.lit(0))
    found = main
    if fallback_re:
        found = F.when(F.size(main) > 0, main).otherwise(
            F.regexp_extract_all(F.col("html"), F.lit(fallback_re), F.lit(0)))
    return pages.select(*keys, F.posexplode(found).alias("pos", "card"))


def container_fallback(pages: DataFrame, keys=("page_key",), min_len: int = 30, inclusive: bool = False,
                       need_price: bool = True, words: str = CONTAINER_WORDS_RE, tags=CONTAINER_TAGS,
                       also: str | None = None) -> DataFrame:
    """Containers whose text is long enough and looks like a listing, for pages without cards.

    A container is the text from an opening tag to the first closing tag of the
    same name (innermost-first reading of nested markup). ``also`` is a further
    pattern that the text must hold.
    """
    arrays = [F.regexp_extract_all(F.col("html"), F.lit(rf"(?s)<{t}\b[^>]*>.*?</{t}>"), F.lit(0))
              for t in tags]
    conts = pages.select(*keys, F.posexplode(F.concat(*arrays)).alias("pos", "card"))
    t = text_of(F.col("card"))
    n = F.length(py_strip(t))
    gate = (n >= min_len) if inclusive else (n > min_len)
    if need_price:
        gate = gate & t.rlike(r"\$\d+")
    if also:
        gate = gate & t.rlike(also)
    return conts.where(gate & t.rlike(words))


def card_gate(df: DataFrame, kind: str = "housing") -> DataFrame:
    t = text_of(F.col("card"))
    return df.where(housing_gate(t) if kind == "housing" else state_gate(t))


def links(pages: DataFrame, keys=("page_id",), base: Column | None = None) -> DataFrame:
    """Every anchor of a page: (keys..., pos, href made absolute, text)."""
    b = base if base is not None else origin("url")
    arr = F.arrays_zip(F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_RE), F.lit(1)).alias("href"),
                       F.regexp_extract_all(F.col("html"), F.lit(ANCHOR_RE), F.lit(2)).alias("inner"))
    out = pages.select(*keys, b.alias("_base"), F.posexplode(arr).alias("pos", "a"))
    return out.select(*keys, "pos", absolute_url(F.col("a.href"), F.col("_base")).alias("href"),
                      py_strip(text_of(F.col("a.inner"))).alias("text"))


# FIXED VALUES: housing type of each source's listings before keywords, and how its links join its base url.
DEFAULT_TYPES = {
    "nchousingsearch.org": "subsidized", "hud.gov": "subsidized", "affordablehousing.com": "subsidized", "gosection8.com": "section8",
    "apartments.com": "market", "craigslist": "market", "zillow": "market", "rent.com": "market",
}
JOINS_ALL_LINKS = ("nchousingsearch.org", "hud.gov", "affordablehousing.com", "gosection8.com")   # others: those that begin with / only
NO_LINKS_RE = r"^(?:#|javascript)"                                                                # nchousingsearch.org, links besides the title


def link_url(href, source: Column) -> Column:
    """A listing's link as its source reads it: joined to the base url, or left as it is; '' and null give ''."""
    h = F.coalesce(col(href), F.lit(""))
    base = F.coalesce(*[F.when(source == s, F.lit(b)) for _, s, _, b in P.SOURCES], F.lit(""))
    slash = h.startswith("/")
    joined = (F.when(source == "gosection8.com", F.when(slash, F.concat(base, h)).otherwise(F.concat(base, F.lit("/"), h)))
              .otherwise(F.concat(base, F.lit("/"), F.ltrim(h, F.lit("/")))))
    return (F.when((h == "") | h.startswith("http"), h)
            .when(source.isin(*JOINS_ALL_LINKS), joined)
            .otherwise(F.when(slash, F.concat(base, h)).otherwise(h)))


def _last_detail(kind, value) -> Column:
    """The last value among the detail texts of one kind that give one."""
    found = F.filter(F.transform("_details", lambda d: F.when(kind(d), value(d))), lambda v: v.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def html_listings(cards_df: DataFrame, city: str, state: str) -> DataFrame:
    """Listing rows from card fragments (source, kind, text, parts, details): see markup.fragments.

    Sources that read a field alike share a branch; the branches of one field are
    told by lists of sources.
    """
    src, text = F.col("source"), F.col("text")
    part = lambda k: F.col("parts").getItem(k)
    some = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    nch, hud, aff, gs8, apts, cl = "nchousingsearch.org", "hud.gov", "affordablehousing.com", "gosection8.com", "apartments.com", "craigslist"
    listed = src.isin("zillow", "rent.com")
    market = src.isin(apts, cl, "zillow", "rent.com")
    df = cards_df.withColumns({
        "_details": F.transform(F.coalesce("details", F.array().cast("array<string>")), lambda d: F.lower(d)),
        "_el": F.coalesce(part("price"), F.lit("")),
        "_meta": F.coalesce(part("housing"), part("meta"), F.lit("")),
        "_link_ok": (src != nch) | ~F.coalesce(part("link_href"), F.lit("")).rlike(NO_LINKS_RE),
    })
    df = df.withColumns({
        "_title_url": F.when(src.isin(nch, cl), link_url(part("title_href"), src)).otherwise(F.lit("")),
        "_link_url": F.when(F.col("_link_ok"), link_url(part("link_href"), src)).otherwise(F.lit("")),
        "_amount": F.when(src.isin(cl, "zillow", "rent.com"), price_first("_el")).when(src == apts, price_min("_el"))
        .otherwise(price_min(F.when(src.isin(nch, gs8) & part("price").isNotNull(), part("price")).otherwise(text), 0, 2000, False)),
        "_csz": F.when(~market, city_state_zip(text, city, state)),
        "_split": F.when(src == apts, split_address(F.coalesce(part("address"), F.lit("")), city)),
        "_posted": F.when(market | (src == gs8), posted(text)).otherwise(F.lit("")),
        "_hood": F.btrim(F.coalesce(part("hood"), F.lit("")), F.lit("() ")),
    })
    is_bed = lambda d: contains_any(d, ("bed", "br")) | ((src == "zillow") & d.contains("bd"))
    is_bath = lambda d: ~is_bed(d) & d.contains("ba")
    is_area = lambda d: ~is_bed(d) & ~d.contains("ba") & F.when(
        src == "zillow", contains_any(d, ("sqft", "sq ft"))).otherwise(contains_any(d, ("sq", "ft")))
    number = lambda d, p: F.nullif(F.regexp_extract(d, p, 0), F.lit(""))
    link_title = F.when(F.col("_link_ok") & (F.coalesce(part("link_href"), F.lit("")) != ""), part("link"))
    title = (F.when(src.isin(aff, gs8), some(part("link"), part("title")))
             .when(listed, some(part("link")))
             .when(src == cl, some(part("title")))
             .when((src == nch) & (F.col("_title_url") != ""), some(part("title")))
             .otherwise(some(part("title"), link_title)))
    beds = (F.when(src == apts, bedrooms(F.coalesce(part("beds"), F.lit("")), BEDS_RE["bed_br_bd"], studio_first=True))
            .when(src == cl, bedrooms("_meta", BEDS_RE["br_only"]))
            .when(listed, F.coalesce(_last_detail(is_bed, lambda d: F.coalesce(number(d, r"\d+"), F.when(d.contains("studio"), F.lit("Studio")))), F.lit("")))
            .when(src == hud, F.lit("")).when(src == gs8, bedrooms(text, BEDS_RE["bed_br_bd_gs8"])).otherwise(bedrooms(text, BEDS_RE["bed_br"])))
    baths = (F.when(src == nch, bathrooms(text)).when(src == gs8, bathrooms(text, BATHS_RE["bath_ba"]))
             .when(src == apts, bathrooms(F.coalesce(part("baths"), F.lit("")), BATHS_RE["number"]))
             .when(listed, _last_detail(is_bath, lambda d: number(d, r"[\d.]+")).try_cast("double")))
    area = (F.when(src == apts, sqft(F.coalesce(part("sqft"), F.lit("")), SQFT_RE["sqft"])).when(src == cl, sqft("_meta", SQFT_RE["ft"]))
            .when(src == gs8, sqft(text, SQFT_RE["sqft_sf"]))
            .when(listed, F.replace(_last_detail(is_area, lambda d: number(d, r"[\d,]+")), F.lit(","), F.lit("")).try_cast("bigint")))
    amount = F.col("_amount")
    price = (F.when(src == nch, income_based(amount, text, INCOME_OR_CALL_RE)).when(src == aff, income_based(amount, text, INCOME_RE))
             .when(market, F.coalesce(amount, price_min(text, 50, 3000, True))).otherwise(amount))
    tel = F.when(F.coalesce(part("phone_href"), F.lit("")).startswith(TEL_PREFIX), part("phone_href"))
    by_element = src.isin(apts, "zillow", "rent.com")
    called = F.when(by_element & tel.isNotNull(), py_strip(F.replace(tel, F.lit(TEL_PREFIX), F.lit("")))) \
        .when(by_element & part("phone").isNotNull(), phone(part("phone"))).otherwise(F.lit(""))
    csz, sp, plain = F.col("_csz"), F.col("_split"), src.isin(cl, "zillow", "rent.com")
    kind_type = F.when((src == aff) & (F.col("kind") == "senior"), F.lit(P.TYPE_SENIOR)).otherwise(
        F.coalesce(*[F.when(src == s, F.lit(t)) for s, t in DEFAULT_TYPES.items()], F.lit(P.TYPE_MARKET)))
    return df.select(
        *cards_df.columns, title.alias("title"),
        F.when(src.isin(nch, cl) & (F.col("_title_url") != ""), F.col("_title_url")).when(src == cl, F.lit("")).otherwise(F.col("_link_url")).alias("url"),
        price.alias("price"), F.when(market, some(beds, bedrooms(text))).otherwise(beds).alias("bedrooms"),
        F.when(market, F.coalesce(baths, bathrooms(text))).otherwise(baths).alias("bathrooms"), area.alias("sqft"),
        F.when(src == hud, street(text)).when(src == cl, F.col("_hood")).otherwise(F.coalesce(part("address"), F.lit(""))).alias("address"),
        F.when(plain, F.lit(city)).when(src == apts, some(sp["city"], F.lit(city))).otherwise(csz["city"]).alias("city"),
        F.when(plain, F.lit(state)).when(src == apts, some(sp["state"], F.lit(state))).otherwise(csz["state"]).alias("state"),
        F.when(plain, F.lit("")).when(src == apts, sp["zip_code"]).otherwise(csz["zip_code"]).alias("zip_code"),
        some(called, phone(text)).alias("phone"),
        F.when(src == cl, some(part("date"), F.col("_posted"))).otherwise(F.col("_posted")).alias("date_posted"),
        F.when(src == cl, F.col("_hood")).otherwise(F.lit("")).alias("neighborhood"),
        F.when(src == nch, amenities(text)).otherwise(F.lit("")).alias("amenities"),
        F.when((src == hud) & (F.col("kind") == "search"), F.lit(P.TYPE_SUBSIDIZED)).otherwise(senior_type(text, src, kind_type)).alias("housing_type"))


def admit(df: DataFrame) -> DataFrame:
    """Drop extracted rows that have neither a title nor a url."""
    return df.where((F.col("title") != "") | (F.col("url") != ""))


def default_city(df: DataFrame, city: str, state: str) -> DataFrame:
    return df.withColumns({
        "city": F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit(city)),
        "state": F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit(state)),
    })


def enrich(df: DataFrame, text: str = "text") -> DataFrame:
    """Fill-only-if-missing pass: price, bedrooms, bathrooms, phone, date."""
    t = F.col(text)
    return df.withColumns({
        "price": F.coalesce(F.col("price"), price_min(t, 50, 3000, True)),
        "bedrooms": F.coalesce(F.nullif(F.col("bedrooms"), F.lit("")), F.nullif(bedrooms(t), F.lit("")), F.lit("")),
        "bathrooms": F.coalesce(F.col("bathrooms"), bathrooms(t)),
        "phone": F.coalesce(F.nullif(F.col("phone"), F.lit("")), phone(t)),
        "date_posted": F.coalesce(F.nullif(F.col("date_posted"), F.lit("")), posted(t)),
    })


def tag_search_city(df: DataFrame, primary_city: str) -> DataFrame:
    """Listings found by a search for another city but labelled with the primary (or no) city
    carry the searched city in the neighborhood, so address matching can place them."""
    sc = F.col("search_city")
    other = py_strip(F.lower(sc)) != primary_city.lower().strip()
    city_l = py_strip(F.lower(F.col("city")))
    hit = other & ((city_l == primary_city.lower().strip()) | (F.col("city") == ""))
    hood = F.col("neighborhood")
    new = (F.when(hood == "", sc)
           .when(~F.lower(hood).contains(F.lower(sc)), F.concat(hood, F.lit(", "), sc))
           .otherwise(hood))
    return df.withColumn("neighborhood", F.when(hit, new).otherwise(hood))
