"""Round-trip pages: fixture listings rendered as crawled pages.

The driver's ``pages`` table holds generic web pages, not listing pages, so
extraction is also checked on pages rendered from the listings fixture: each
listing becomes an HTML card in its source's own markup, a JSON-LD object and an
entry of a page's embedded script data.  A page is (source, block of 160
consecutive order keys), i.e. about 20 listings; blocks map to (search city, page).
Page assembly is a group-by on that key with a bounded group (at most 160 rows).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.labels import short_float
from lodgeflow.sources.fixture import fixture_listings

BLOCK = 160          # order keys per page block
PAGES_PER_CITY = 5   # page numbers 1..5 per (source, search city)
MARKET = ("apartments.com", "zillow", "rent.com")


def search_areas(params: P.SearchParams = P.DEFAULT) -> list[str]:
    """Primary city, then preferred then expanded areas, case-insensitively distinct."""
    seen, out = set(), []
    for c in (params.city, *params.preferred_areas, *params.expanded_areas):
        k = c.lower().strip()
        if k not in seen:
            seen.add(k)
            out.append(c)
    return out


def _esc(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _rooms() -> Column:
    b = F.col("bedrooms")
    return F.when(F.lower(b).isin("studio", "0"), F.lit(0)).when(b.rlike(r"^\d+$"), b.try_cast("int"))


def features() -> Column:
    """A features line stated by the listing itself (senior designation, pets, laundry, parking)."""
    g = F.col
    return F.concat_ws(" ", F.when(g("housing_type") == "senior", F.lit("Seniors 62+")),
                       F.when(g("price").isNull(), F.lit("No pets")),
                       F.when(g("bathrooms") >= 1, F.lit("Laundry")),
                       F.when(g("zip_code") != "", F.lit("Parking")))


def link() -> Column:
    """The listing's link as its page writes it: mostly its url, for some a path or no address at all."""
    u = F.col("url")
    return (F.when(F.col("seq") % 29 == 0, F.regexp_replace(u, "^https://(?:ex|EX)[.]org", ""))
            .when((F.col("seq") % 31 == 0) & (u != ""), F.lit("javascript:void(0)")).otherwise(u))


def _shown(link_col: Column) -> dict[str, Column]:
    """The parts of a card as texts."""
    g = F.col
    some = lambda text, unit: F.when(text == "", F.lit("")).otherwise(F.concat(text, F.lit(unit)))
    baths = F.when(g("bathrooms").isNull(), F.lit("")).otherwise(short_float(g("bathrooms")))
    area = F.when(g("bathrooms").isNull(), F.lit("")).otherwise(F.format_number((500 * (1 + g("bathrooms"))).cast("bigint"), 0))
    counted = g("bedrooms").rlike(r"^\d+$")
    tel = F.concat(F.lit('<a class="call" href="tel:'), g("phone"), F.lit('">Call</a>'))
    return {
        "title": _esc(g("title")), "link": _esc(link_col), "address": _esc(g("address")),
        "place": F.concat(_esc(g("city")), F.lit(", "), g("state"), F.lit(" "), g("zip_code")),
        "price": F.when(g("price").isNull(), F.lit("Call for rent")).when(g("price") == 0, F.lit("Income based"))
        .otherwise(F.concat(F.lit("$"), F.format_number(g("price"), 0))),
        "phone": g("phone"), "tel": F.when(g("phone") == "", F.lit("")).otherwise(tel), "posted": g("date_posted"), "features": features(),
        "hood": g("neighborhood"), "rooms": g("bedrooms"), "bed": F.when(counted, F.lit(" bed")).otherwise(F.lit("")),
        "br": F.when(counted, F.lit("br")).otherwise(F.lit("")), "beds": F.when(counted, F.lit(" Beds")).otherwise(F.lit("")),
        "bds": F.when(counted, F.lit(" bds")).otherwise(F.lit("")), "bath": some(baths, " bath"), "bths": some(baths, " Baths"),
        "ba": some(baths, " ba"), "sq_ft": some(area, " sq ft"), "feet": some(area, "ft"), "sqft": some(area, " sqft"), "area": some(area, " Sq. Ft."),
    }


#: Cards in general markup, and in that of five sources; {name} stands for a part of the card.
GENERAL_CARD = """<article class="card">
<h2><a href="{link}">{title}</a></h2>
<span class="price">{price}</span>
<span class="beds">{rooms}{bed}</span>
<span class="baths">{bath}</span>
<span class="sqft">{sq_ft}</span>
<div class="address">{address}</div>
<div class="location">Location: {place}</div>
<span class="phone">{phone}</span>
<span class="posted">Posted: {posted}</span>
<p class="features">{features}</p>
</article>"""
SOURCE_CARDS = {
    "nchousingsearch.org": """<div class="listing-result">
<div class="row"><div class="row"><h2><a href="{link}">{title}</a></h2></div></div>
<div class="rent"><div>{price}</div></div>
<span class="beds">{rooms}{bed}</span>
<span class="baths">{bath}</span>
<div class="address"><div>{address}</div></div>
<div class="place">Location: {place}</div>
<span class="phone">{phone}</span>
<p class="features">{features}</p>
</div>""",
    "apartments.com": """<article data-testid="property-card" class="wide placard">
<div class="property-title"><span>{title}</span></div>
<a class="property-link" href="{link}">View</a>
<div class="property-pricing"><div>{price}</div></div>
<div class="property-beds">{rooms}{bed}</div>
<div class="property-baths">{bath}</div>
<div class="property-sqft">{sq_ft}</div>
<div class="property-address"><div>{address}</div><div>, {place}</div></div>
{tel}
<div class="when">Posted: {posted}</div>
<p class="features">{features}</p>
</article>""",
    "craigslist": """<li class="cl-static-search-result">
<a class="titlestring" href="{link}">{title}</a>
<div class="priceinfo">{price}</div>
<div class="meta"><span class="housing">{rooms}{br} - {feet}</span></div>
<div class="nearby">({hood})</div>
<time datetime="{posted}">{posted}</time>
<span>{phone}</span>
<ul><li>{features}</li></ul>
</li>""",
    "zillow": """<article data-test="property-card" class="Tile">
<a href="{link}" data-test="property-card-link"><address>{address}</address></a>
<span data-test="property-card-price">{price}</span>
<ul><li>{rooms}{bds}</li><li>{ba}</li><li>{sqft}</li></ul>
{tel}
<span>Posted: {posted}</span>
<p>{features}</p>
</article>""",
    "rent.com": """<div data-tid="property-card" class="x1">
<div><a href="{link}" class="property-link">{title}</a></div>
<div data-tid="price">{price}</div>
<span data-tid="bed">{rooms}{beds}</span><span data-tid="bath">{bths}</span><span data-tid="sqft">{area}</span>
<div data-tid="address"><div>{address}</div></div>
{tel}
<span>Posted: {posted}</span>
<p>{features}</p>
</div>""",
}


def _filled(card: str, part) -> Column:
    pieces = [F.lit(p) if i % 2 == 0 else part(p) for i, p in enumerate(re.split(r"\{(\w+)\}", card))]
    return F.concat(*pieces)


def card_html() -> Column:
    """One listing card of general markup; elements on their own lines like a formatted page."""
    parts = _shown(F.col("url"))
    return _filled(GENERAL_CARD, parts.__getitem__)


def with_source_card(fx: DataFrame) -> DataFrame:
    """Listings with ``card`` in the markup of their source; three sources use the general one.
    The parts are columns first, as all markups share them."""
    parts = {f"_{k}": v for k, v in _shown(link()).items()}
    part = lambda k: F.col(f"_{k}")
    cards = [F.when(F.col("source") == s, _filled(c, part)) for s, c in SOURCE_CARDS.items()]
    return fx.withColumns(parts).withColumn("card", F.coalesce(*cards, _filled(GENERAL_CARD, part))).drop(*parts)


def jsonld_item() -> Column:
    g = F.col
    return F.struct(
        F.lit("Apartment").alias("@type"), g("title").alias("name"), g("url").alias("url"),
        F.array(F.struct(g("price").alias("price"))).alias("offers"),
        F.struct(g("address").alias("streetAddress"), g("city").alias("addressLocality"),
                 g("state").alias("addressRegion"), g("zip_code").alias("postalCode")).alias("address"),
        g("phone").alias("telephone"), _rooms().alias("numberOfRooms"), features().alias("description"))


def sparse_item() -> Column:
    """An object that tells less than a listing: some have no housing type, name or address."""
    n = F.col("seq")
    return F.struct(F.when(n % 5 == 0, "WebPage").when(n % 5 == 1, "ApartmentComplex").otherwise("").alias("@type"),
                    F.when((n % 7).isin(1, 2), "Home").when(n % 7 == 3, "").alias("name"),
                    F.when(n % 11 < 4, F.struct(F.lit("Concord").alias("addressLocality"))).alias("address"))


def script_item() -> Column:
    g = F.col
    return F.struct(
        g("title").alias("propertyName"), g("url").alias("listingUrl"), g("price").alias("price"),
        _rooms().alias("bedrooms"), g("bathrooms").alias("bathrooms"),
        F.struct(g("address").alias("streetAddress"), g("city").alias("city"), g("state").alias("state"),
                 g("zip_code").alias("zip")).alias("address"),
        g("phone").alias("phone"), g("date_posted").alias("datePosted"))


# Pages per search and the first one's number: a locator before the searches of hud.gov, a senior page behind those of affordablehousing.com.
PAGES_BY_SOURCE = {"hud.gov": (4, 0), "affordablehousing.com": (6, 1)}
KINDS = {("hud.gov", 0): "locator", ("affordablehousing.com", 6): "senior"}


def listings_with_page(fx: DataFrame) -> DataFrame:
    """Each listing with its page coordinates (source, city_ord, page_no)."""
    block = F.floor(F.col("seq") / BLOCK).cast("int")
    n, first = F.lit(PAGES_PER_CITY), F.lit(1)
    for s, (k, f) in PAGES_BY_SOURCE.items():
        n, first = F.when(F.col("source") == s, F.lit(k)).otherwise(n), F.when(F.col("source") == s, F.lit(f)).otherwise(first)
    return fx.withColumns({
        "city_ord": F.floor(block / n).cast("int"),
        "page_no": (block % n + first).cast("int"),
    })


def render_pages(fx: DataFrame, params: P.SearchParams = P.DEFAULT, general: bool = False, sparse: bool = False) -> DataFrame:
    """Pages (PAGE schema) holding every listing of the fixture in all three renderings; ``general`` cards for all sources, or each source's own.
    ``sparse`` adds an object of each listing that tells little, as a script and (market sources) as a node of the graph."""
    areas = search_areas(params)
    src_base = {s: b for _, s, _, b in P.SOURCES}
    lp = listings_with_page(fx)
    lp = lp.withColumn("card", card_html()) if general else with_source_card(lp)
    per = lp.select("source", "city_ord", "page_no", "seq", "card",
                    F.to_json(jsonld_item()).alias("ld"), script_item().alias("item"),
                    *[F.to_json(sparse_item()).alias("bare")] * sparse)
    grouped = per.groupBy("source", "city_ord", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("seq", "card", "ld", "item", *["bare"] * sparse))).alias("rows"))
    cards = F.array_join(F.transform("rows", lambda r: r["card"]), "\n")
    bare = [F.transform("rows", lambda r: r["bare"])] * sparse
    objects = F.concat(F.transform("rows", lambda r: r["ld"]), *bare)
    each = lambda texts: F.array_join(F.transform(texts, lambda t: F.concat(
        F.lit('<script type="application/ld+json">'), t, F.lit("</script>"))), "\n")
    ld_each = each(objects)
    ld_graph = F.concat_ws("\n", F.concat(F.lit('<script type="application/ld+json">{"@graph":['), F.array_join(objects, ","),
                                          F.lit("]}</script>")), *[each(b) for b in bare])
    is_market = F.col("source").isin(*MARKET)
    payload = F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.transform("rows", lambda r: r["item"]).alias("listResults")).alias("searchResults"))
        .alias("pageProps")).alias("props")))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), payload, F.lit("</script>"))
    html = F.concat_ws("\n", F.lit("<html><body>"), cards, F.when(is_market, ld_graph).otherwise(ld_each),
                       script, F.lit("</body></html>"))
    base = F.coalesce(*[F.when(F.col("source") == s, F.lit(b)) for s, b in src_base.items()])
    city = F.element_at(F.array(*[F.lit(a) for a in areas]), (F.col("city_ord") % len(areas)) + 1)
    return grouped.select(
        "source", city.alias("search_city"), "city_ord", "page_no",
        F.concat(base, F.lit("/search?city="), F.replace(city, F.lit(" "), F.lit("+")),
                 F.lit("&page="), F.col("page_no").cast("string")).alias("url"),
        html.alias("html"), F.to_timestamp(F.lit(params.as_of)).alias("fetched_at"),
        F.lit(None).cast("string").alias("error"),
        F.coalesce(*[F.when((F.col("source") == s) & (F.col("page_no") == n), F.lit(k)) for (s, n), k in KINDS.items()], F.lit("search")).alias("kind"))


def roundtrip_pages(spark: SparkSession, sf_dir: str, params: P.SearchParams = P.DEFAULT, general: bool = False, sparse: bool = False) -> DataFrame:
    return render_pages(fixture_listings(spark, sf_dir), params, general, sparse)


def troubled(pages: DataFrame) -> DataFrame:
    """The crawl with failed and empty pages: each source but four loses some page of some
    searches, the others come back empty now and then."""
    failed = (F.col("source").isin("rent.com", "hud.gov", "affordablehousing.com", "gosection8.com")
              & (F.col("city_ord") % 3 == 1) & F.col("page_no").isin(0, 2, 6))
    empty = ~F.col("source").isin("rent.com") & (F.col("city_ord") % 4 == 2) & (F.col("page_no") == 3)
    return pages.withColumns({"error": F.when(failed, F.lit("timeout")),
                              "html": F.when(empty, F.lit("<html><body><p>Nothing found.</p></body></html>")).otherwise(F.col("html"))})


def with_paging(pages: DataFrame) -> DataFrame:
    """The crawl with the marks that two sources give of more pages: a link to the next, or a stated total."""
    nxt = F.lit('<a class="next" href="?more">next</a>')
    total = F.concat(F.lit('<span class="totalcount">1 - 120 of '), F.format_number(113 + 120 * (F.col("city_ord") % 5), 0), F.lit("</span>"))
    mark = (F.when((F.col("source") == "apartments.com") & ((F.col("city_ord") + F.col("page_no")) % 4 != 0), nxt)
            .when((F.col("source") == "craigslist") & (F.col("city_ord") % 2 == 0), total)
            .when((F.col("source") == "craigslist") & (F.col("page_no") != 2), nxt).otherwise(F.lit("")))
    return pages.withColumn("html", F.concat("html", mark))
