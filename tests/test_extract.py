"""Extraction: column rules, JSON mapping, the JSON walk against a direct recursion, page policies."""

import json
import random

from pyspark.sql import functions as F

from lodgeflow.operators import extract as EX
from lodgeflow.operators import json_extract as JX
from lodgeflow.operators import markup as MU
from lodgeflow.operators import pages as PG

KNOWN = MU.WALK_KNOWN_KEYS
MARKERS = MU.WALK_MARKER_KEYS


def recursive_hits(root, source):
    """The live-hit rule over an enumeration of all paths: a hit counts unless an object
    above it, that it passes through a key of no meaning, has a hit through a known one."""
    hits, todo = [], [(root, ())]
    while todo:
        node, steps = todo.pop()
        through = lambda known: (*steps, (id(node), known))
        if isinstance(node, list):
            for x in node:
                if isinstance(x, dict) and set(x) & set(MARKERS[source]):
                    hits.append((x, steps))
                elif isinstance(x, (dict, list)):
                    todo.append((x, steps))
        elif isinstance(node, dict):
            if source == "apartments.com" and set(node) & set(MU.SELF_NAME_KEYS) and set(node) & set(MU.SELF_DATA_KEYS):
                hits.append((node, through(True)))
            for key, x in node.items():
                known = key in KNOWN[source]
                if known and isinstance(x, list):
                    hits += [(y, through(True)) for y in x]
                if isinstance(x, dict) or isinstance(x, list) and not known:
                    todo.append((x, through(known)))
    known_hits = {at for _, steps in hits for at, known in steps if known}
    return [x for x, steps in hits if not any(at in known_hits and not known for at, known in steps)]


def random_doc(rng, source, depth=0):
    keys = list(KNOWN[source]) + list(MARKERS[source]) + ["a", "b", "props", "data", "x"] + list(MU.SELF_NAME_KEYS)
    r = rng.random()
    if depth > 13 or depth > 4 and r < 0.7 or r < 0.2:
        return rng.choice([1, 2, "s", "t", None, True])
    if r < 0.55:
        return [random_doc(rng, source, depth + 1) for _ in range(rng.randint(0, 3))]
    return {k: random_doc(rng, source, depth + 1) for k in rng.sample(keys, rng.randint(1, 4))}


def canon(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_json_walk_matches_direct_recursion(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        src = ["apartments.com", "zillow", "rent.com"][i % 3]
        doc = {"props": random_doc(rng, src)} if i % 5 else random_doc(rng, src)
        if i < 3:  # deep chains of fallback edges ending in a marked object, 14 and some hundred levels down
            doc = [{"price": 1}]
            for k in range(12 if i < 2 else 300):
                doc = {"ab"[k % 2]: doc}
        rows.append((src, i, json.dumps(doc)))
    blocks = spark.createDataFrame(rows, "source string, doc int, raw string") \
        .select("source", "doc", F.lit(0).alias("script_no"), F.lit(0).alias("part"),
                F.parse_json("raw").alias("v"))
    hits = JX.json_walk(blocks, ["source", "doc"]).select("doc", F.to_json("item").alias("j")).collect()
    got = {}
    for r in hits:
        got.setdefault(r.doc, []).append(canon(json.loads(r.j)) if r.j is not None else "null")
    for src, i, raw in rows:
        want = sorted(canon(h) for h in recursive_hits(json.loads(raw), src))
        assert sorted(got.get(i, [])) == want, (i, raw)


def test_column_rules(spark):
    df = spark.createDataFrame([
        ("<a href='x'>", "call (704) 555-1234 or $, then $1,200 and $450", "tel:704-555-9999 "),
        ("", "1.5 bath\n, NC 28227\nPets allowed, no pets in pool", ""),
    ], "h string, t string, tel string")
    r = df.select(
        EX.phone("t", F.col("tel")).alias("phone"), EX.phone("t").alias("phone_text"),
        EX.price_first("t").alias("first"), EX.price_min("t", 0, 2000, False).alias("min"),
        EX.city_state_zip("t", "Charlotte", "NC").alias("csz"), EX.amenities("t").alias("am"),
    ).collect()
    assert r[0].phone == "704-555-9999" and r[0].phone_text == "(704) 555-1234"
    assert r[0].first is None          # "$," carries no digits
    assert r[0].min == 450
    # city is the last line of the run before ", NC": strip happens before the split
    assert r[1].csz.city == "bath" and r[1].csz.zip_code == "28227"
    assert r[1].am == "Pool, Pets, No Pets"


def test_split_address_and_text(spark):
    df = spark.createDataFrame([("12 Elm St, Concord, NC 28025",), ("12 Elm St, NC",), ("12 Elm St",)], "a string")
    got = [tuple(r.s) for r in df.select(EX.split_address("a", "Charlotte").alias("s")).collect()]
    assert got == [("Concord", "NC", "28025"), ("Charlotte", "NC", ""), ("", "", "")]
    t = spark.range(1).select(EX.text_of(F.lit("<b>A &amp;lt; B</b> &quot;x&quot;")).alias("t")).first().t
    assert t == 'A &lt; B "x"'


def test_jsonld_mapping(spark):
    obj = {"@type": ["Apartment", "Place"], "name": "Elm Court", "offers": [{"price": "1,200.50"}],
           "address": {"streetAddress": "12 Elm St", "addressLocality": "", "postalCode": "28025"},
           "numberOfBedrooms": 0, "numberOfRooms": 0, "floorSize": {"value": "1,050"},
           "telephone": 7045551234, "description": "Senior living, 2 bedroom"}
    items = spark.createDataFrame([("apartments.com", json.dumps(obj))], "source string, raw string") \
        .select("source", F.parse_json("raw").alias("item"), F.lit(False).alias("from_graph"))
    r = JX.jsonld_to_listing(JX.jsonld_admit(items), "Charlotte", "NC").first()
    assert (r.title, r.price, r.address, r.city, r.state, r.zip_code) == \
        ("Elm Court", 1200, "12 Elm St", "Charlotte", "NC", "28025")
    assert r.bedrooms == "Studio" and r.sqft == 1050 and r.phone == "7045551234" and r.senior_hint


def _pages(spark, rows):
    return spark.createDataFrame(rows, "source string, search_city string, city_ord int, page_no int, error string")


def test_page_policies(spark):
    pages = _pages(spark, [
        ("zillow", "Charlotte", 0, 1, None), ("zillow", "Charlotte", 0, 2, None), ("zillow", "Charlotte", 0, 3, None),
        ("hud.gov", "Charlotte", 0, 1, None), ("hud.gov", "Charlotte", 0, 4, None),
        ("rent.com", "Charlotte", 0, 1, None), ("rent.com", "Midland", 1, 2, "timeout"),
        ("gosection8.com", "Charlotte", 0, 1, None), ("gosection8.com", "Charlotte", 0, 2, "503"),
        ("gosection8.com", "Charlotte", 0, 3, None),
    ])
    capped = {(r.source, r.page_no) for r in PG.page_limit(pages, 2).collect()}
    assert ("zillow", 3) not in capped and ("hud.gov", 4) not in capped and ("zillow", 2) in capped
    kept = {(r.source, r.page_no) for r in PG.error_policy(pages).collect()}
    assert not any(s == "rent.com" for s, _ in kept)          # one failure loses the whole source
    assert ("gosection8.com", 1) in kept and ("gosection8.com", 3) not in kept   # stop at the failure
    listings = spark.createDataFrame([("zillow", "Charlotte", 0, 1, "html"), ("zillow", "Charlotte", 0, 3, "html")],
                                     "source string, search_city string, city_ord int, page_no int, strategy string")
    pref = {r.page_no for r in PG.page_prefix(listings, pages.drop("error")).collect()}
    assert pref == {1}                                          # page 2 was empty: page 3 does not count


def test_strategy_choice(spark):
    rows = [("zillow", "C", 0, 1, s, p, b) for s, p, b in
            [("script", 5, "1"), ("jsonld", 5, "1"), ("html", 5, "")]]
    rows += [("affordablehousing.com", "C", 0, 1, "jsonld", 1, "1"), ("hud.gov", "C", 0, 1, "jsonld", 1, "1"),
             ("hud.gov", "C", 0, 1, "html", 1, "1")]
    df = spark.createDataFrame(rows, "source string, search_city string, city_ord int, page_no int, strategy string, "
                                     "price bigint, bedrooms string")
    got = {(r.source, r.strategy) for r in PG.choose_strategy(df).collect()}
    assert ("zillow", "script") in got and ("zillow", "jsonld") not in got     # tie: script first
    assert ("affordablehousing.com", "jsonld") in got                          # html empty: fallback
    assert {("hud.gov", "jsonld"), ("hud.gov", "html")} <= got                 # union


def _walk(spark, *bodies):
    rows = [("rent.com", i, f"<script type='application/json'>{b}</script>") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "source string, page int, html string")
    return JX.json_walk(JX.script_blocks(pages, ["source", "page"]), ["source", "page"])


def test_walk_has_no_length_limit_and_survives_no_scripts(spark):
    nested = '{"a":{"a":{"a":[{"rent":1}]}}}'
    assert _walk(spark, nested, '[{"rent":1}]', "").count() == 2
    assert _walk(spark, "").count() == 0


def test_walk_paths_hold_any_array_index(spark):
    hits = _walk(spark, '[{},{"rent":1},{"rent":2}]')
    assert sorted(r.hit_path for r in hits.collect()) == ["/0000000001", "/0000000002"]


def test_no_maximum_rent_means_no_upper_test(listings):
    from lodgeflow.operators import filters as FL
    df = listings(*(dict(seq=i, title=t, price=p) for i, (t, p) in enumerate([("a", 250000), ("b", 5), ("c", None)])))
    assert sorted(r.title for r in FL.rent_filter(df, 10).collect()) == ["a", "c"]


def _fetched(spark, *rows):
    from lodgeflow.schema import PAGE
    return spark.createDataFrame([(s, "Charlotte", c, p, "", html, None, None, kind[0] if kind else None) for s, c, p, html, *kind in rows], PAGE)


def test_seq_is_unique_and_in_crawl_order_on_long_pages_and_late_pages(spark):
    from lodgeflow.plans.extract_plan import extract_listings
    card = "<article><a href='/x' href=\"/{0}\">Flat {0} in Charlotte, NC 28205</a></article>"
    row = '<li class="result-row"><a class="titlestring" href="/x">Flat {0} in Charlotte</a></li>'
    items = json.dumps([{"@type": "Apartment", "name": f"Home {i}", "url": f"/h{i}"} for i in range(20_000)])
    pages = _fetched(spark, ("hud.gov", 0, 1, f'<script type="application/ld+json">{items}</script>' + card.format("a") + card.format("b")),
                     ("craigslist", 0, 2000, row.format("late")), ("craigslist", 1, 976, row.format("next city")),
                     ("craigslist", 0, 3, row.format("early")))
    rows = extract_listings(pages).orderBy("seq").select("seq", "source", "title").collect()
    assert len(rows) == 20_005 and len({r.seq for r in rows}) == len(rows)
    assert [r.title.split(" in ")[0] for r in rows if r.source == "craigslist"] == ["Flat early", "Flat late", "Flat next city"]
    hud = [r.title for r in rows if r.source == "hud.gov"]
    assert hud[:20_000] == [f"Home {i}" for i in range(20_000)]


def test_containers_of_each_source_follow_its_own_rule(spark):
    from lodgeflow.plans.extract_plan import html_strategy
    from lodgeflow.params import DEFAULT
    link = '<h2><a href="/{0}">{1}</a></h2>'
    exact = "Studio flat for $700 per month"
    assert len(exact) == 30
    body = ("<div>" + link.format("no-price", "Quiet senior apartment homes in Concord, NC") + "</div>"
            "<li>" + link.format("section", "Section eight voucher home for $900") + "</li>"
            "<tr>" + link.format("exact", exact) + "</tr>"
            "<section>" + link.format("part", "Housing for families at $800 in North Carolina") + "</section>")
    pages = _fetched(spark, *[(s, 0, 1, body) for s, _ in MU.CONTAINER_RULES])
    got = {(r.source, r.url.rsplit("/", 1)[1]) for r in html_strategy(pages, DEFAULT).collect()}
    assert got == {("affordablehousing.com", "no-price"), ("affordablehousing.com", "part"),
                   ("gosection8.com", "section"), ("nchousingsearch.org", "exact")}


def test_placards_arrays_in_any_script_are_found(spark):
    from lodgeflow.plans.extract_plan import script_strategy
    from lodgeflow.params import DEFAULT
    body = ('<script>var a = 1;</script><script>load({ "placards" : [{"title":"Elm Court","url":"/elm"},{"name":"Oak"}] });'
            'load({"placard":[{"name":"Pine"}]});</script>')
    data = '<script type="application/json">{"listings":[{"name":"Data"}]}</script>'
    pages = _fetched(spark, ("apartments.com", 0, 1, data + body), ("zillow", 0, 1, body))
    rows = script_strategy(pages, DEFAULT).orderBy("item_pos").collect()
    assert [(r.source, r.title) for r in rows] == [("apartments.com", t) for t in ("Elm Court", "Oak", "Pine", "Data")]


def test_window_data_is_read_as_each_source_does(spark):
    from lodgeflow.plans.extract_plan import script_strategy
    from lodgeflow.params import DEFAULT
    data = '<script type="application/json">{"results":[{"name":"Data","detailUrl":"/d"}]}</script>'
    none = '<script id="__NEXT_DATA__">{"results":[]}</script>'
    window = '<script>window.__DATA__ = {"results":[{"name":"Window","detailUrl":"/w"}]}; window.pageData={"results":[{"name":"Page"}]};</script>'
    sources = ("apartments.com", "zillow", "rent.com")
    pages = _fetched(spark, *[(s, 0, n, html) for s in sources for n, html in enumerate((data + window, none + window, window))])
    got = {}
    for r in script_strategy(pages, DEFAULT).orderBy("source", "page_no", "item_pos").collect():
        got.setdefault((r.source, r.page_no), []).append(r.title or r.url)
    assert got["apartments.com", 0] == ["Data", "Window", "Page"] and got["apartments.com", 1] == ["Window", "Page"]
    assert got["zillow", 0] == ["https://www.zillow.com/d"]                       # the data scripts held a listing
    assert got["zillow", 1][0] == got["zillow", 2][0] == "https://www.zillow.com/w" and len(got["zillow", 2]) == 2
    assert [n for s, n in got if s == "rent.com"] == [0] and got["rent.com", 0] == ["Data"]


CARDS = {
    "apartments.com": (
        '<div class="wide placard"><div class="top"><div><h2 class="js-placardTitle">Elm <b>Court</b></h2></div></div>'
        '<a class="property-link" href="/elm">see</a><div class="price-range"><div>$1,450</div> - <div>$990</div></div>'
        '<div class="bed-range">Studio, 2 bed</div><div class="bath-range"><i>1.5</i> bath</div><div class="property-sqft">1,020 sqft</div>'
        '<div class="property-address"><div>12 Elm St</div>, Concord, NC 28025</div><a href="tel:704-555-0101">call</a></div>',
        ("ElmCourt", "https://www.apartments.com/elm", 990, "Studio", 1.5, 1020, "12 Elm St, Concord, NC 28025", "Concord", "28025", "704-555-0101", "")),
    "craigslist": (
        '<li class="result-row"><ul><li>x</li></ul><div class="result-title"><a href="/apa/1.html">Oak flat</a></div><span class="result-price">$875</span>'
        '<span class="result-meta"><span class="housing">2br - 900ft</span></span><span class="result-hood"> (NoDa)</span><time datetime="2026-08-01">Aug 1</time></li>',
        ("Oak flat", "https://charlotte.craigslist.org/apa/1.html", 875, "2", None, 900, "NoDa", "Charlotte", "", "", "2026-08-01")),
    "zillow": (
        '<div class="list-card"><a href="#map">map</a><a href="/homedetails/9">9 Pine Rd</a><div class="list-card-price">$1,100/mo</div>'
        '<address>9 Pine Rd</address><ul><li>3 bds</li><li>2 ba</li><li>1,300 sqft</li></ul></div>',
        ("map", "#map", 1100, "3", 2.0, 1300, "9 Pine Rd", "Charlotte", "", "", "")),
    "rent.com": (
        '<article class="property-card"><div class="x"><div class="x"><a href="/apartments/ash">Ash</a></div></div><span class="rent-price">from $640</span>'
        '<div class="_1bZMX"><span>1 Bed</span><span>1 Bath</span><span>700 Sq Ft</span></div><div data-tid="address">5 Ash Ln</div></article>',
        ("Ash", "https://www.rent.com/apartments/ash", 640, "1", 1.0, 700, "5 Ash Ln", "Charlotte", "", "", "")),
    "nchousingsearch.org": (
        '<div class="listing-item"><div><div><strong><a href="detail/7">Fir Homes</a></strong></div></div><p>Studio, call for rent, 1 ba </p>'
        '<address>7 Fir Ct</address>\nAlbemarle, NC 28001 (704) 555-0107</div>',
        ("Fir Homes", "https://www.nchousingsearch.org/detail/7", 0, "Studio", 1.0, None, "7 Fir Ct", "Albemarle", "28001", "(704) 555-0107", "")),
    "affordablehousing.com": (
        '<div class="result-card"><h3><a href="/p/8">Yew Place</a></h3><div>Rent is 30% of income. 2 bedroom</div><div class="address"><div>8 Yew Dr</div></div></div>',
        ("Yew Place", "https://affordablehousingonline.com/p/8", 0, "2", None, None, "8 Yew Dr", "Charlotte", "", "", "")),
    "gosection8.com": (
        '<table><tr class="listing-row"><td><a href="section-8/5">Bay unit</a><td>$1,200 $800 <td>1 bd 1 bath 650 sf<td class="location">5 Bay St</tr></table>',
        ("Bay unit", "https://www.gosection8.com/section-8/5", 800, "1", 1.0, 650, "5 Bay St", "Charlotte", "", "", "")),
    "hud.gov": (
        '<table><tr><td><b>Elder House</b><td><a href="r/3">more</a><td>100 Oak Ave, Monroe, NC 28110 for seniors $500</tr></table>',
        ("Elder House", "https://resources.hud.gov/r/3", 500, "", None, None, "100 Oak Ave", "Monroe", "28110", "", "")),
}


def test_cards_of_each_source_are_read_by_its_own_names(spark):
    from lodgeflow.plans.extract_plan import html_strategy
    from lodgeflow.params import DEFAULT
    pages = _fetched(spark, *[(s, 0, 1, f"<html><body><div>{html}</div><div>other $5 text</div></body></html>") for s, (html, _) in CARDS.items()])
    got = {}
    for r in html_strategy(pages, DEFAULT).collect():
        got.setdefault(r.source, []).append((r.title, r.url, r.price, r.bedrooms, r.bathrooms, r.sqft, r.address, r.city, r.zip_code, r.phone, r.date_posted))
    assert got == {s: [want] for s, (_, want) in CARDS.items()}


def test_cards_of_another_source_are_no_cards_and_nested_ones_all_are(spark):
    from lodgeflow.plans.extract_plan import html_strategy
    from lodgeflow.params import DEFAULT
    pages = _fetched(spark, *[(s, 0, 1, CARDS["zillow"][0]) for s in ("apartments.com", "craigslist", "rent.com")],
                     ("gosection8.com", 0, 1, '<div class="result-box"><article><h2><a href="/a">A</a></h2></article><article><h2><a href="/b">B</a></h2></article></div>'))
    assert [(r.source, r.pos, r.title) for r in html_strategy(pages, DEFAULT).orderBy("pos").collect()] == [
        ("gosection8.com", 0, "A"), ("gosection8.com", 1, "A"), ("gosection8.com", 2, "B")]


def test_links_are_joined_as_each_source_joins_them(spark):
    hrefs = ["", "http://x/y", "/a", "a", "#top", "javascript:go()", "mailto:x", "//cdn/x"]
    rows = [(s, h) for s in ("nchousingsearch.org", "gosection8.com", "zillow") for h in hrefs]
    df = spark.createDataFrame(rows, "source string, href string").select("source", "href", EX.link_url("href", F.col("source")).alias("u"))
    got = {(r.source, r.href): r.u for r in df.collect()}
    nch, gs8 = "https://www.nchousingsearch.org", "https://www.gosection8.com"
    assert [got["nchousingsearch.org", h] for h in hrefs] == ["", "http://x/y", nch + "/a", nch + "/a", nch + "/#top", nch + "/javascript:go()", nch + "/mailto:x", nch + "/cdn/x"]
    assert [got["gosection8.com", h] for h in hrefs] == ["", "http://x/y", gs8 + "/a", gs8 + "/a", gs8 + "/#top", gs8 + "/javascript:go()", gs8 + "/mailto:x", gs8 + "//cdn/x"]
    assert [got["zillow", h] for h in hrefs] == ["", "http://x/y", "https://www.zillow.com/a", "a", "#top", "javascript:go()", "mailto:x", "https://www.zillow.com//cdn/x"]
    page = '<div class="result"><a href="#x">skip</a></div><div class="result"><a href="list">Pine</a></div>'
    from lodgeflow.plans.extract_plan import html_strategy
    from lodgeflow.params import DEFAULT
    assert [(r.title, r.url) for r in html_strategy(_fetched(spark, ("nchousingsearch.org", 0, 1, page)), DEFAULT).collect()] == [("Pine", nch + "/list")]
    plain = spark.createDataFrame([(h,) for h in hrefs], "h string").select(EX.absolute_url("h", F.lit("http://s")).alias("u"))
    assert [r.u for r in plain.collect()] == ["", "http://x/y", "http://s/a", "http://s/a", "#top", "javascript:go()", "mailto:x", "http://s/cdn/x"]


def test_page_kinds(spark):
    from lodgeflow.plans.extract_plan import extract_listings
    card = '<article class="card"><h3><a href="/{0}">{0} housing</a></h3> in Concord, NC 28025 {1}</article>'
    ld = '<script type="application/ld+json">{{"name": "{0}", "url": "/{0}", "description": "{1}"}}</script>'
    pages = _fetched(
        spark, ("hud.gov", 0, 0, card.format("loc-html", "seniors") + ld.format("loc", "elderly"), "locator"), ("hud.gov", 0, 1, card.format("s8", "senior") + ld.format("s8ld", "senior")),
        ("hud.gov", 1, 0, card.format("only-html", "older adults welcome"), "locator"), ("hud.gov", 1, 7, '<article class="card"><a href="/n">no such word at all</a></article>', "locator"),
        ("affordablehousing.com", 0, 1, card.format("general", "")), ("affordablehousing.com", 0, 6, card.format("for-all", ""), "senior"),
        ("affordablehousing.com", 1, 6, ld.format("ld-all", ""), "senior"))
    got = {r.title.split()[0]: r.housing_type for r in extract_listings(pages).collect()}
    assert got == {"loc": "senior", "s8": "subsidized", "s8ld": "subsidized", "only-html": "senior", "general": "subsidized", "for-all": "senior", "ld-all": "senior"}
    failed = pages.withColumn("error", F.when(F.col("page_no").isin(0, 6) & (F.col("city_ord") == 0), "timeout"))
    kept = {(r.source, r.city_ord, r.page_no) for r in PG.error_policy(failed).collect()}
    assert kept == {("hud.gov", 0, 1), ("hud.gov", 1, 0), ("hud.gov", 1, 7), ("affordablehousing.com", 0, 1), ("affordablehousing.com", 1, 6)}
    assert {r.page_no for r in PG.page_limit(pages, 0).collect()} == {0, 6, 7}


def test_paging_stops(spark):
    nxt, total = '<a class="next" href="?p">next</a>', '<span class="totalcount">1 - 120 of 250</span>'
    pages = _fetched(spark, *[("apartments.com", 0, n, nxt if n != 2 else "") for n in (1, 2, 3)], *[("craigslist", 0, n, total) for n in (1, 2, 3, 4)],
                     *[("craigslist", 1, n, "") for n in (1, 2)], *[("craigslist", 2, n, nxt) for n in (1, 2)], *[("zillow", 0, n, "") for n in (1, 2)])
    got = sorted((r.source, r.city_ord, r.page_no) for r in PG.paging_stops(pages).collect())
    assert got == [("apartments.com", 0, 1), ("apartments.com", 0, 2), ("craigslist", 0, 1), ("craigslist", 0, 2), ("craigslist", 0, 3),
                   ("craigslist", 1, 1), ("craigslist", 2, 1), ("craigslist", 2, 2), ("zillow", 0, 1), ("zillow", 0, 2)]


def test_pages_of_any_shape_do_not_crash(spark):
    odd = [None, "", "<", "<div", "</div>" * 500, "<div>" * 3000 + "x", "<script>window.__A__ = {bad};</script>", '<script type="application/json">[[[', "<!--",
           '<script type="application/ld+json">[1, "x", null, {"name": "A"}]</script>', '<script type="application/json">' + "[" * 5000 + "]" * 5000 + "</script>"]
    pages = _fetched(spark, *[(s, 0, n, html) for s, *_ in [(x,) for x in CARDS] for n, html in enumerate(odd)])
    from lodgeflow.plans.extract_plan import extract_listings
    assert {r.title for r in extract_listings(pages).collect()} == {"A"}
    assert extract_listings(pages.limit(0)).count() == 0


def test_sparse_objects_beside_each_listing_are_admitted_by_the_sources_rule(listings):
    """Of three listings (all named and placed) the sparse object of one is named and placed, of one neither, of one named only."""
    from lodgeflow.sources import roundtrip as RT
    keys = ["source", "city_ord", "page_no"]
    for source, expected in (("zillow", {(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (3, 0)}), ("craigslist", {(i, 0) for i in range(6)})):
        pages = RT.render_pages(listings(*(dict(seq=s, title="T", city="C", source=source) for s in (1, 5, 8))), sparse=True)
        got = JX.jsonld_admit(JX.expand_graph(JX.jsonld_blocks(pages, keys), keys)).collect()
        assert {(r.block_no, r.node_no) for r in got} == expected and len(got) == len(expected)


def test_scripts_alone_are_those_that_the_elements_hold():
    rng = random.Random(5)
    bits = ['<script type="application/ld+json">', "</script>", "</SCRIPT >", "<!--", "-->", "<!x>", "<", "</", "< ", '"', "=", "<p>", '<a title="<script>">',
            "<textarea>", "</textarea>", "<scriptx>", "<script/", "<style", "</3", "{}", "\n"]
    for _ in range(3000):
        html = "".join(rng.choices(bits, k=rng.randint(1, 15)))
        assert MU.scripts_of(html) == MU.Elements(html).scripts, html


def test_long_scripts_are_handed_on_in_parts(spark, monkeypatch):
    """Rows leave Python a few at a time, in order, however many a batch of pages gives."""
    body = json.dumps([{"rent": i} for i in range(50)])
    pages = spark.createDataFrame([("rent.com", i, f"<script type='application/json'>{body}</script>") for i in range(4)],
                                  "source string, page int, html string").coalesce(1)
    monkeypatch.setattr(MU, "_FLUSH", 700)
    got = JX.json_walk(JX.script_blocks(pages, ["source", "page"]), ["source", "page"]).collect()
    assert [(r.page, r.pos) for r in got] == [(p, i) for p in range(4) for i in range(50)]
    found = MU.fragments(pages, ["source", "page"], ("script",)).collect()
    assert [(r.page, r.pos, json.loads(r.item)["rent"]) for r in found] == [(p, i, i) for p in range(4) for i in range(50)]


def test_candidates_hold_the_fields_asked_for_and_all_rows(listings):
    from lodgeflow.plans import extract_plan as XP
    from lodgeflow.sources import roundtrip as RT
    pages = RT.render_pages(listings(*(dict(seq=s, title=f"T{s}", price=100 * s, bedrooms="2", city="C", state="NC", source=source)
                                       for s, source in enumerate(("zillow", "rent.com", "hud.gov", "craigslist", "apartments.com", "zillow"), 1))))
    few, full = XP.candidates(pages, fields=PG.QUALITY_FIELDS), XP.candidates(pages)
    assert few.columns == [*XP.PAGE_KIND, "strategy", "item_pos", "price", "bedrooms"]
    rows = lambda df: sorted(map(repr, df.select(few.columns).collect()))
    assert rows(few) == rows(full) and {r.strategy for r in few.collect()} == {"html", "jsonld", "script"}
    nothing = XP.candidates(pages.where("source = 'none'"), fields=())
    assert nothing.count() == 0


def test_fallback_choice_never_broadcasts_a_pages_listings(spark, tmp_path):
    page = F.col("id") % 40
    source = F.when(page % 2 == 0, F.lit("hud.gov")).otherwise(F.lit("gosection8.com"))
    strategy = F.when((F.col("id") % 3 == 0) & (page % 4 != 1), F.lit("jsonld")).otherwise(F.lit("html"))
    path = str(tmp_path / "listings")
    (spark.range(60_000, numPartitions=2).select(source.alias("source"), F.lit("Concord").alias("search_city"), F.lit(0).alias("city_ord"),
                                                 page.cast("int").alias("page_no"), F.lit("search").alias("kind"), strategy.alias("strategy"))
     .sortWithinPartitions("page_no", "strategy").write.parquet(path))
    out = PG.fallback_strategy(spark.read.parquet(path), ["source", "search_city", "city_ord", "page_no"])
    got = {(r.source, r.page_no % 4, r.strategy): r["count"] for r in out.groupBy("source", "page_no", "strategy").count().collect()}
    assert got == {("hud.gov", 0, "jsonld"): 500, ("hud.gov", 0, "html"): 1000, ("hud.gov", 2, "jsonld"): 500, ("hud.gov", 2, "html"): 1000,
                   ("gosection8.com", 1, "html"): 1500, ("gosection8.com", 3, "jsonld"): 500}
    counted = out.groupBy().count()
    assert counted.collect()[0][0] == 10 * (1500 + 1500 + 1500 + 500)
    plan = counted._jdf.queryExecution().executedPlan().toString()              # as it ran
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
