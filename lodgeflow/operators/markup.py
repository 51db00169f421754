"""Markup: one pass over each page's html gives the fragments that all later rules read.

A page becomes rows: listing cards with the texts of their fields, JSON-LD
scripts, data scripts, and the listing objects inside them.  What to look for is
a table of selectors per source and page kind.  A page's tags are scanned once
into a flat list of elements, each with its parent and the span of its text, so
nested elements of one name end at their own tag.  The pass runs as Arrow
batches and shuffles nothing; the rows it gives hold no html.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: where each source keeps cards and their fields (CSS selectors).
# "cards" are read from a page; "cards_else" where it has none of them. A field
# is the first element in page order that any of its selectors meets.
# ---------------------------------------------------------------------------
SELECTORS = {
    ("nchousingsearch.org", "search"): {
        "cards": ".listing-result, .search-result, .property-listing, div.result, tr.listing-row, .listing-item, "
                 "div[class*='listing'], div[class*='result'], div[class*='property'], article, .card",
        "title": ".listing-title, .property-name, h2 a, h3 a, .listing-result-title, a[href*='listing'], a[href*='detail'], "
                 ".name, strong a, b a",
        "link": "a[href*='listing'], a[href*='detail'], a[href]",
        "price": ".rent, .price, .listing-rent, [class*='rent'], [class*='price']",
        "address": ".address, .listing-address, .property-address, [class*='address'], address",
    },
    ("hud.gov", "locator"): {
        "cards": ".resource-result, .listing, .result-item, div[class*='result'], tr, li.resource, article, .card, div[class*='listing']",
        "title": "h3, h4, .title, a, strong, b",
        "link": "a[href]",
    },
    ("hud.gov", "search"): {
        "cards": "table tr, .property, .listing, div[class*='result'], article, .card",
        "title": "h3, h4, .title, a, strong, b",
        "link": "a[href]",
    },
    ("affordablehousing.com", "search"): {
        "cards": ".property-listing, .search-result, .listing-card, div[class*='property'], div[class*='listing'], article, "
                 ".result-card, .card",
        "link": "a[href*='housing'], a[href*='property'], h2 a, h3 a, a.title",
        "title": "h2, h3, h4, .property-name, .title",
        "address": ".address, .property-address, address",
    },
    ("affordablehousing.com", "senior"): {
        "cards": ".property-listing, .search-result, .listing-card, div[class*='property'], div[class*='listing'], article, .card",
        "link": "a[href*='housing'], a[href*='property'], h2 a, h3 a, a.title",
        "title": "h2, h3, h4, .property-name, .title",
        "address": ".address, .property-address, address",
    },
    ("gosection8.com", "search"): {
        "cards": ".listing, .search-result, .property-card, .rental-listing, div[class*='listing'], div[class*='result'], "
                 "tr[class*='listing'], article, .card",
        "link": "a[href*='section-8'], a[href*='listing'], a[href*='rental'], h2 a, h3 a, a.title, a[href*='housing']",
        "title": "h2, h3, h4, .listing-title, .property-name",
        "price": ".price, .rent, [class*='price'], [class*='rent']",
        "address": ".address, address, [class*='address'], [class*='location']",
    },
    ("apartments.com", "search"): {
        "cards": "li.mortar-wrapper, article[data-testid='property-card'], div.placard, section.placard-content",
        "cards_else": "[data-listingid], [data-url], [data-listing-id], [data-property-id], article[class*='placard'], "
                      "div[class*='placard']",
        "title": ".property-title, [data-testid='property-title'], .js-placardTitle, span.js-placardTitle, .listing-title, "
                 "a .title, h2, h3",
        "link": "a.property-link, a[data-testid='property-link'], a[href*='/apartments/'], a[href*='.apartments.com/'], a[href]",
        "price": ".property-pricing, [data-testid='property-pricing'], .price-range, .rent-range, [class*='price'], "
                 "[class*='rent'], .pricing",
        "beds": ".property-beds, [data-testid='property-beds'], .bed-range, [class*='bed'], .beds",
        "baths": ".property-baths, [data-testid='property-baths'], .bath-range, [class*='bath']",
        "sqft": ".property-sqft, [data-testid='property-sqft']",
        "address": ".property-address, [data-testid='property-address'], [class*='address'], .listing-address",
        "phone": ".property-phone, [data-testid='property-phone'], a[href^='tel:'], [class*='phone']",
        "next": "a.next, [data-testid='next-page'], a[title='Next'], a[aria-label='Next'], .pagination .next",
    },
    ("craigslist", "search"): {
        "cards": "li.cl-static-search-result, li.result-row, .cl-search-result, div.result-node",
        "cards_else": "[data-pid], .gallery-card",
        "title": "a.titlestring, a.posting-title, .result-title a, a.cl-app-anchor",
        "price": ".priceinfo, .result-price, .price",
        "housing": ".meta .housing, .result-meta .housing, .post-bedrooms",
        "meta": ".meta, .result-meta",
        "hood": ".result-hood, .nearby, .supertitle",
        "date": "time, .date, [datetime]",
        "next": "a.next, .cl-next-page, button.bd-button[title='next']",
        "total": ".totalcount, .cl-page-number",
    },
    ("zillow", "search"): {
        "cards": "article[data-test='property-card'], div.list-card, li.ListItem, [data-testid='search-result-list-item'], "
                 "[class*='property-card'], [class*='ListItem']",
        "link": "a[href*='/homedetails/'], a[href*='/b/'], a[data-test='property-card-link'], a[href*='/apartments/'], "
                "a[href*='zillow.com'], a[href]",
        "price": "[data-test='property-card-price'], .list-card-price, span.PropertyCardWrapper__StyledPriceLine, "
                 "[class*='price'], [class*='Price']",
        "address": "address, [data-test='property-card-addr'], [class*='address'], [class*='Address']",
        "details": "li, .list-card-details span, [data-test='property-card-details'] span, [class*='bed'], [class*='bath'], "
                   "[class*='sqft']",
        "phone": "a[href^='tel:'], [data-test='property-card-phone']",
    },
    ("rent.com", "search"): {
        "cards": "[data-tid='property-card'], div._1y05u, div.listing-card, article.property-card, "
                 "[data-testid='property-card'], div[class*='listing'], div[class*='property']",
        "link": "a[href*='/apartments/'], a._3ouMn, a.property-link, a[href*='/rent/'], a[data-testid='property-link'], a[href]",
        "price": "[data-tid='price'], .price, ._1KxV6, .rent-price, [class*='price'], [class*='rent']",
        "details": "[data-tid='bed'], [data-tid='bath'], [data-tid='sqft'], .detail-item, ._1bZMX span, [class*='bed'], "
                   "[class*='bath']",
        "address": "[data-tid='address'], .property-address, ._1dhrl, [class*='address']",
        "phone": "a[href^='tel:'], [data-tid='phone'], .phone",
    },
}
#: What counts as a container of a page without cards: tags, least length, and patterns that its text must hold.
CONTAINER_RULES = {
    ("nchousingsearch.org", "search"): (("div", "tr", "li", "article"), 30, r"\$\d+", r"(?i)(?:bed|br|studio|apartment|housing)"),
    ("affordablehousing.com", "search"): (("div", "section"), 31, r"(?i)(?:apartment|housing)", r"(?i)(?:nc|north carolina)"),
    ("gosection8.com", "search"): (("div", "tr", "li"), 31, r"\$\d+", r"(?i)(?:bed|br|studio|section)"),
}
#: Keys that hold listings inside script data, and keys that mark an element of any other array as one.
WALK_KNOWN_KEYS = {
    "apartments.com": ("listings", "properties", "searchResults", "results", "placards", "listResults"),
    "zillow": ("listResults", "searchResults", "cat1", "results", "mapResults", "relaxedResults"),
    "rent.com": ("listings", "properties", "searchResults", "results"),
}
WALK_MARKER_KEYS = {
    "apartments.com": ("rent", "price", "propertyName", "listingName", "name"),
    "zillow": ("zpid", "price", "address", "detailUrl"),
    "rent.com": ("rent", "price", "propertyName", "listingUrl", "name"),
}
SELF_NAME_KEYS = ("listingName", "propertyName", "name", "title")      # apartments.com only
SELF_DATA_KEYS = ("rent", "price", "address", "location")
PLACARDS_RE = re.compile(r'"placards?"?\s*:\s*(\[.+?\])', re.S)
WINDOW_RE = re.compile(r"(?:window\.__\w+__|window\.\w+Data)\s*=\s*(\{.+?\});", re.S)
# Names of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
                     "pre section table ul".split())
CLOSED_BY = {"li": ("li", ("ul", "ol")), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table")),
             "option": ("option", ("select",))}
# ---------------------------------------------------------------------------

FRAGMENT = ("what string, pos int, text string, parts map<string,string>, details array<string>, item string, path string, "
            "script_no int, part int")
_REST = r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_REST})(?:>|\Z)""", re.S)
# All up to the next element whose content is no markup, by the same tokens; its opening tag; its end.
_RAW_NAME = rf"(?ai:{'|'.join(sorted(RAW))})(?=[\s/>]|\Z)"
_UP_TO_RAW = re.compile(rf"""(?:[^<]++|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?!{_RAW_NAME})/?[a-zA-Z][^\s/>]*{_REST}(?:>|\Z)|</?(?![a-zA-Z/!?])|</(?![a-zA-Z]))*+""", re.S)
_RAW_TAG = re.compile(rf"<([a-zA-Z]+)({_REST})(?:>|\Z)", re.S)
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>|\\Z", re.I) for tag in RAW}
_ATTR = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ONE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?)='(?P<val>[^']*)')?\]""")


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def scripts_of(html: str) -> list[tuple[dict[str, str], str]]:
    """A page's scripts as (attributes, content): those that ``Elements`` finds, without its elements."""
    out, pos = [], 0
    while m := _RAW_TAG.match(html, _UP_TO_RAW.match(html, pos).end()):
        tag = m[1].lower()
        done = _RAW_END[tag].search(html, m.end())
        if tag == "script":
            out.append((_attrs(m[2]), html[m.end():done.start()]))
        pos = done.end()
    return out


class Elements:
    """A page's elements in order: tag, attributes, parent, the pieces of text each holds, and the first element behind it."""

    def __init__(self, html: str):
        self.tag, self.raw, self.parent, self.first, self.last, self.behind = [], [], [], [], [], []
        self.pieces: list[str] = []
        self.scripts: list[tuple[dict[str, str], str]] = []
        tags, raws, parents, firsts, lasts, behind, pieces = self.tag, self.raw, self.parent, self.first, self.last, self.behind, self.pieces
        stack: list[int] = []
        is_open: dict[str, int] = {}
        pos, end, search = 0, len(html), _TOKEN.search

        def close(upto: int) -> None:
            while len(stack) > upto:
                i = stack.pop()
                is_open[tags[i]] -= 1
                lasts[i], behind[i] = len(pieces), len(tags)

        def opened(names, scope=()) -> int | None:
            for at in range(len(stack) - 1, -1, -1):
                name = tags[stack[at]]
                if name in names:
                    return at
                if name in scope:
                    return None
            return None

        while pos < end:
            m = search(html, pos)
            stop = m.start() if m else end
            if stop > pos:
                piece = html[pos:stop]
                pieces.append(unescape(piece) if "&" in piece else piece)
            if not m:
                break
            pos = m.end()
            slash, tag, raw = m.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                if not is_open.get(tag):
                    continue
                if tags[stack[-1]] == tag:
                    close(len(stack) - 1)
                    continue
                at = opened((tag,), () if tag in ("table", "article", "section", "ul", "ol", "body", "html") else ("table",) if tag != "td" else ())
                if at is not None:
                    close(at)
                continue
            if tag in CLOSES_P and is_open.get("p") and (at := opened(("p",), ("table", "td"))) is not None:
                close(at)
            if tag in CLOSED_BY:
                names, scope = CLOSED_BY[tag]
                names = (names, "th") if names == "td" else (names,)
                if any(is_open.get(name) for name in names) and (at := opened(names, scope)) is not None:
                    close(at)
            tags.append(tag)
            raws.append(raw)
            parents.append(stack[-1] if stack else -1)
            firsts.append(len(pieces))
            lasts.append(len(pieces))
            behind.append(len(tags))
            if tag in RAW:
                done = _RAW_END[tag].search(html, pos)
                if tag == "script":
                    self.scripts.append((_attrs(raw), html[pos:done.start()]))
                pos = done.end()
            elif tag not in VOID:
                stack.append(len(tags) - 1)
                is_open[tag] = is_open.get(tag, 0) + 1
        close(0)

    def text(self, i: int) -> str:
        return "".join(self.pieces[self.first[i]:self.last[i]])

    def stripped(self, i: int) -> str:
        """The pieces without white space around them, one behind the other."""
        return "".join(p.strip() for p in self.pieces[self.first[i]:self.last[i]])


@lru_cache(maxsize=None)
def _compiled(selectors: str) -> list[list[tuple]]:
    """Each selector as its compounds: (tag, classes, attribute tests), the element's own last."""
    out = []
    for one in selectors.split(","):
        chain = []
        for part in one.split():
            found = [m.groupdict() for m in _ONE.finditer(part)]
            chain.append((next((f["tag"] for f in found if f["tag"]), None), tuple(f["cls"] for f in found if f["cls"]),
                          tuple((f["attr"], f["op"], f["val"]) for f in found if f["attr"])))
        out.append(chain)
    return out


def _fits(compound: tuple, tag: str, attrs: dict[str, str]) -> bool:
    name, classes, tests = compound
    if name and name != tag:
        return False
    if classes and not set(classes) <= set(attrs.get("class", "").split()):
        return False
    for attr, op, val in tests:
        have = attrs.get(attr)
        if have is None or val is not None and not (val in have if op == "*" else have.startswith(val) if op == "^" else have == val):
            return False
    return True


class Page:
    """A page's elements with the selectors that each meets."""

    def __init__(self, html: str, cache: dict):
        self.el, self._cache = Elements(html), cache
        self._known: dict[int, dict[str, str]] = {}

    def attrs(self, i: int) -> dict[str, str]:
        if i not in self._known:
            self._known[i] = _attrs(self.el.raw[i])
        return self._known[i]

    def known(self, i: int, rules: tuple[tuple[str, str], ...]) -> list[tuple[str, list]]:
        """(name, selectors) of the rules whose own part fits an element; the rest of a selector depends on its place."""
        key = (rules, self.el.tag[i], self.el.raw[i])
        found = self._cache.get(key)
        if found is None:
            if len(self._cache) > 50_000:
                self._cache.clear()
            tag, attrs = self.el.tag[i], self.attrs(i)
            found = [(name, chains) for name, selectors in rules if (chains := [c for c in _compiled(selectors) if _fits(c[-1], tag, attrs)])]
            self._cache[key] = found
        return found

    def placed(self, i: int, chains: list) -> bool:
        """Whether an element stands where one of these selectors asks it to."""
        for chain in chains:
            at, left = self.el.parent[i], len(chain) - 2
            while left >= 0 and at >= 0:
                left -= _fits(chain[left], self.el.tag[at], self.attrs(at))
                at = self.el.parent[at]
            if left < 0:
                return True
        return False

    def select(self, selectors: str) -> list[int]:
        rules = (("", selectors),)
        return [i for i in range(len(self.el.tag)) if any(self.placed(i, chains) for _, chains in self.known(i, rules))]

    def within(self, i: int) -> range:
        """The elements inside one."""
        return range(i + 1, self.el.behind[i])


@lru_cache(maxsize=None)
def _fields(source: str, kind: str) -> tuple[tuple[str, str], ...]:
    return tuple((name, selectors) for name, selectors in SELECTORS[source, kind].items() if name not in ("cards", "cards_else", "next", "total"))


def _card(page: Page, i: int, rules: tuple[tuple[str, str], ...]) -> dict:
    parts: dict[str, str] = {}
    at: dict[str, int] = {}
    details = []
    for j in page.within(i):
        for name, chains in page.known(j, rules):
            if name not in at and page.placed(j, chains):
                if name == "details":
                    details.append(page.el.stripped(j))
                else:
                    at[name] = j
    for name, _ in rules:
        if (j := at.get(name)) is None:
            continue
        attrs = page.attrs(j)
        parts[name] = page.el.text(j) if name == "phone" else page.el.stripped(j)
        if name in ("title", "link", "phone") and "href" in attrs:
            parts[name + "_href"] = attrs["href"]
        if name == "date" and attrs.get("datetime"):
            parts[name] = attrs["datetime"]
    return {"text": page.el.text(i), "parts": parts, "details": details}


def _cards(page: Page, source: str, kind: str) -> Iterator[dict]:
    rules = SELECTORS.get((source, kind))
    if rules is None:
        return
    found = page.select(rules["cards"]) or (page.select(rules["cards_else"]) if "cards_else" in rules else [])
    if not found and (source, kind) in CONTAINER_RULES:
        tags, least, *patterns = CONTAINER_RULES[source, kind]
        for i, tag in enumerate(page.el.tag):
            if tag in tags:
                text = page.el.text(i)
                if len(text.strip()) >= least and all(re.search(p, text) for p in patterns):
                    found.append(i)
    for pos, i in enumerate(found):
        yield {"what": "card", "pos": pos} | _card(page, i, _fields(source, kind))


def find_listings(root, source: str) -> list[tuple[str, object]]:
    """(path, value) of the listing objects in script data, to any depth.

    An object's own hits are the elements of arrays under known keys (and, for one
    source, itself); an array's are its objects with a marker key.  Below an
    object, what lies under keys of no meaning counts only if nothing was found in
    it otherwise.  Containers are listed from the root on, their hits summed from
    the last back, then kept from the first on.
    """
    known, markers = WALK_KNOWN_KEYS.get(source, ()), WALK_MARKER_KEYS.get(source, ())
    own_rule = source == "apartments.com"
    nodes: list[tuple[int, bool, object, str, tuple]] = [(-1, True, root, "", ())]    # parent, by a known way, value, path, place
    hits: list[list[tuple[tuple, str, object]]] = []
    for at, (_, _, node, path, place) in enumerate(nodes):                            # the list grows behind
        here: list[tuple[tuple, str, object]] = []
        if isinstance(node, dict):
            if own_rule and not node.keys().isdisjoint(SELF_NAME_KEYS) and not node.keys().isdisjoint(SELF_DATA_KEYS):
                here.append(((*place, -1), path + "/@", node))
            for i, (key, value) in enumerate(node.items()):
                by_known = key in known
                spot = (*place, known.index(key) if by_known else len(known) + i)
                if by_known and isinstance(value, list):
                    here += [((*spot, k), f"{path}/{key}/{k:010d}", x) for k, x in enumerate(value)]
                elif isinstance(value, (dict, list)):
                    nodes.append((at, by_known, value, f"{path}/{key}", spot))
        elif isinstance(node, list):
            for k, x in enumerate(node):
                if isinstance(x, dict) and not x.keys().isdisjoint(markers):
                    here.append(((*place, k), f"{path}/{k:010d}", x))
                elif isinstance(x, (dict, list)):
                    nodes.append((at, True, x, f"{path}/{k:010d}", (*place, k)))
        hits.append(here)
    strong, weak = [len(h) for h in hits], [0] * len(nodes)
    for at in range(len(nodes) - 1, 0, -1):
        parent, by_known, *_ = nodes[at]
        if by_known:
            strong[parent] += strong[at] or weak[at]
        else:
            weak[parent] += strong[at] or weak[at]
    kept, out = [True] * len(nodes), hits[0][:]
    for at in range(1, len(nodes)):
        parent, by_known, *_ = nodes[at]
        kept[at] = kept[parent] and (by_known or not strong[parent])
        if kept[at]:
            out += hits[at]
    return [(path, value) for _, path, value in sorted(out, key=lambda h: h[0])]


def _loads(text: str):
    try:
        return json.loads(text, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None


def _blocks(scripts: list, source: str) -> Iterator[tuple[int, int, object, list]]:
    """(script, part, data, its listings) of script JSON.  Placards arrays of one source come first; its other
    scripts may assign data to the window.  Another reads such assignments only where
    its data scripts held no listing; the third reads data scripts alone."""
    found = False
    if source == "apartments.com":
        for n, (_, body) in enumerate(scripts):
            for part, m in enumerate(PLACARDS_RE.finditer(body)):
                if (data := _loads(m[1])) is not None:
                    yield n - len(scripts), part, (data := {"placards": data}), find_listings(data, source)
    assigned = []
    for n, (attrs, body) in enumerate(scripts):
        if attrs.get("id") == "__NEXT_DATA__" or "application/json" in attrs.get("type", ""):
            if (data := _loads(body)) is not None:
                hits = find_listings(data, source)
                found = found or any(isinstance(x, dict) for _, x in hits)
                yield n, 0, data, hits
        elif source == "apartments.com" or source == "zillow":
            assigned += [(n, part, m[1]) for part, m in enumerate(WINDOW_RE.finditer(body), 1)]
    if source == "apartments.com" or not found:
        for n, part, raw in assigned:
            if (data := _loads(raw)) is not None:
                yield n, part, data, find_listings(data, source)


def _fragments(source: str, kind: str, html: str, want: frozenset, cache: dict) -> Iterator[dict]:
    page = None if want.isdisjoint(("card", "page")) else Page(html, cache)
    scripts = page.el.scripts if page else scripts_of(html)
    if "card" in want:
        yield from _cards(page, source, kind)
    if "jsonld" in want:
        for n, (attrs, body) in enumerate(scripts):
            if "application/ld+json" in attrs.get("type", "").lower():
                yield {"what": "jsonld", "script_no": n, "item": body}
    if source in WALK_KNOWN_KEYS and not want.isdisjoint(("block", "script")):
        pos = 0
        for n, part, data, hits in _blocks(scripts, source):
            if "block" in want:
                yield {"what": "block", "script_no": n, "part": part, "item": json.dumps(data)}
            if "script" in want:
                for path, value in hits:
                    yield {"what": "script", "pos": pos, "script_no": n, "part": part, "path": path, "item": json.dumps(value)}
                    pos += 1
    if "page" in want:
        rules = SELECTORS.get((source, kind), {})
        parts = {}
        for name in ("next", "total"):
            if name in rules and (found := page.select(rules[name])):
                parts[name] = page.el.stripped(found[0])
        yield {"what": "page", "parts": parts}


#: Characters of rows handed on at a time.
_FLUSH = 4 << 20


def fragments(pages: DataFrame, keys, want=("card", "jsonld", "script")) -> DataFrame:
    """(keys..., FRAGMENT columns) of every page; a page without html has none but its paging marks.

    ``want`` names the kinds of rows: ``card``, ``jsonld`` (whole scripts), ``block`` (data
    scripts), ``script`` (listing objects in them) and ``page`` (its paging marks). Keys
    must hold ``source``; without a column ``kind`` all pages are searches.
    """
    keys = list(keys)
    kind = F.coalesce(F.col("kind"), F.lit("search")) if "kind" in pages.columns else F.lit("search")
    narrow = pages.select(*keys, kind.alias("_kind"), F.col("html").alias("_html"))
    names = [f.split()[0] for f in re.sub(r"<[^>]*>", "", FRAGMENT).split(", ")]
    types = {"parts": pa.map_(pa.string(), pa.string()), "details": pa.list_(pa.string()), "pos": pa.int32(), "script_no": pa.int32(),
             "part": pa.int32()}
    wanted = frozenset(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}

        def flush(at: list[int], rows: list[dict]) -> pa.RecordBatch:
            cols = [b.column(k).take(pa.array(at, pa.int64())) for k in keys]
            for n in names:
                values = [r.get(n) for r in rows]
                cols.append(pa.array([list(v.items()) if v is not None else None for v in values] if n == "parts" else values, types.get(n, pa.string())))
            return pa.RecordBatch.from_arrays(cols, [*keys, *names])

        for b in batches:
            at, rows, size = [], [], 0
            sources, kinds, pieces = (b.column(c) for c in ("source", "_kind", "_html"))
            for i in range(b.num_rows):                                               # one page in Python's memory at a time
                source, k, html = sources[i].as_py(), kinds[i].as_py(), pieces[i].as_py()
                for row in _fragments(source, k, html or "", wanted, cache) if html or "page" in wanted else ():
                    at.append(i)
                    rows.append(row)
                    size += 200 + len(row.get("text") or "") + len(row.get("item") or "")
                    if size > _FLUSH:
                        yield flush(at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield flush(at, rows)

    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{schema}, {FRAGMENT}")


def walk_blocks(blocks: DataFrame, keys) -> DataFrame:
    """(keys..., pos, hit_path, item) of the listing objects in script data ``v`` (a variant)."""
    keys = list(keys)
    narrow = blocks.select(*keys, F.to_json("v").alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
            cols = [b.column(k).take(pa.array([f[0] for f in found], pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*cols, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.string()),
                                               pa.array([f[3] for f in found], pa.string())], [*keys, "pos", "hit_path", "item"])

        for b in batches:
            found, size = [], 0
            sources, texts = b.column("source"), b.column("_json")
            for i in range(b.num_rows):                                               # one block in Python's memory at a time
                for n, (path, value) in enumerate(find_listings(_loads(texts[i].as_py() or "null"), sources[i].as_py())):
                    found.append((i, n, path, json.dumps(value)))
                    size += 200 + len(path) + len(found[-1][3])
                    if size > _FLUSH:
                        yield flush(b, found)
                        found, size = [], 0
            if found:
                yield flush(b, found)

    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    return narrow.mapInArrow(run, f"{schema}, pos int, hit_path string, item string").withColumn("item", F.try_parse_json("item"))
