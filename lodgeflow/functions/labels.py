"""Display columns: labels, addresses, links, table rows and alert text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodgeflow import params as P
from lodgeflow.functions.text import col


def is_subsidized(housing_type="housing_type") -> Column:
    return col(housing_type).isin(*P.SUBSIDIZED_TYPES)


def _lookup(c: Column, pairs, default: str) -> Column:
    out = None
    for k, v in pairs:
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def type_label(housing_type="housing_type") -> Column:
    return _lookup(col(housing_type), P.TYPE_LABELS, P.DEFAULT_TYPE_LABEL)


def tier_label(location_tier="location_tier") -> Column:
    return _lookup(col(location_tier), P.TIER_LABELS, P.DEFAULT_TIER_LABEL)


def price_label(price="price", housing_type="housing_type", missing: str = P.MISSING_PRICE_CSV) -> Column:
    """"$1,234"; 0 on a subsidized row is income-based; null shows ``missing``."""
    p = col(price)
    return (F.when(p.isNull(), F.lit(missing))
            .when((p == 0) & is_subsidized(housing_type), F.lit(P.INCOME_BASED_LABEL))
            .otherwise(F.concat(F.lit("$"), F.format_number(p, 0))))


def recent_label(is_recent="is_recent") -> Column:
    return F.when(col(is_recent), F.lit(P.RECENT_LABEL)).otherwise(F.lit(""))


def full_address(address="address", city="city", state="state", zip_code="zip_code") -> Column:
    """Non-empty parts joined by ', ' (empty when there are none)."""
    return F.concat_ws(", ", *[F.nullif(col(c), F.lit("")) for c in (address, city, state, zip_code)])


def directions_url(full="full_address") -> Column:
    """Map link with the address form-encoded like Python's quote_plus.

    Java's encoder leaves '*' and encodes '~'; Python does the opposite.
    """
    enc = F.replace(F.replace(F.url_encode(col(full)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(col(full) != "", F.concat(F.lit(P.DIRECTIONS_PREFIX), enc)).otherwise(F.lit(""))


def short_float(x: Column) -> Column:
    """Python's '%g' for values with at most 10 decimals and |x| < 1e6."""
    s = x.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def beds_baths(bedrooms="bedrooms", bathrooms="bathrooms") -> Column:
    beds = F.when(col(bedrooms) != "", col(bedrooms)).otherwise(F.lit("?"))
    b = col(bathrooms)
    return F.when(b.isNotNull() & (b != 0), F.concat(beds, F.lit("bd/"), short_float(b), F.lit("ba"))) \
        .otherwise(F.concat(beds, F.lit("bd")))


def pipe_safe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("/"))


def phone_link(phone="phone") -> Column:
    """Markdown tel: link when the number has at least 10 digits; '-' when empty."""
    p = pipe_safe(col(phone))
    digits = F.regexp_replace(p, r"[^0-9]", "")
    return (F.when((p == "") | (p == "-"), F.lit("-"))
            .when(F.length(digits) >= 10, F.concat(F.lit("["), p, F.lit("](tel:"), digits, F.lit(")")))
            .otherwise(p))


def short_title(title="title", width: int = P.TITLE_CUT) -> Column:
    t = col(title)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)


def markdown_row(c=None) -> Column:
    """One results-table row of the Markdown report."""
    g = F.col
    price = F.concat(price_label("price", "housing_type", P.MISSING_PRICE_MARKDOWN),
                     F.when(g("is_recent"), F.lit(" **NEW**")).otherwise(F.lit("")))
    city = pipe_safe(F.when(g("city") != "", g("city")).otherwise(F.lit("?")))
    addr = pipe_safe(F.coalesce(F.nullif(g("full_address"), F.lit("")), F.nullif(g("address"), F.lit("")),
                                F.nullif(g("city"), F.lit("")), F.lit("?")))
    phone = F.when(g("phone") != "", phone_link("phone")).otherwise(F.lit("-"))
    listed = F.when(g("date_posted") != "", g("date_posted")).otherwise(F.lit("-"))
    source = F.when(g("source") != "", g("source")).otherwise(F.lit("?"))
    link = F.when(g("url") != "", F.concat(F.lit("["), source, F.lit("]("), g("url"), F.lit(")"))).otherwise(F.lit("-"))
    directions = F.when(g("directions_url") != "", F.concat(F.lit("[Map]("), g("directions_url"), F.lit(")"))) \
        .otherwise(F.lit("-"))
    cells = [price, beds_baths(), city, addr, phone, listed, type_label(), pipe_safe(short_title()), link, directions]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def alert_block(number: Column, style: str = "console") -> Column:
    """Multi-line alert for one new listing; optional lines vanish when empty."""
    g = F.col
    opt = lambda cond, text: F.when(cond, text)  # noqa: E731  (null drops the line)
    if style == "console":
        lines = [
            F.lit(""),
            F.concat(F.lit("  ["), number.cast("string"), F.lit("] "), g("title")),
            F.concat(F.lit("      Type:     "), type_label()),
            F.concat(F.lit("      Price:    "), price_label(), F.lit("/mo")),
            F.concat(F.lit("      Beds:     "), F.when(g("bedrooms") != "", g("bedrooms")).otherwise(F.lit("N/A"))),
            F.concat(F.lit("      Location: "), F.coalesce(F.nullif(g("full_address"), F.lit("")),
                                                          F.nullif(g("address"), F.lit("")), g("city"))),
            F.concat(F.lit("      Area:     "), tier_label()),
            opt(g("phone") != "", F.concat(F.lit("      Phone:    "), g("phone"))),
            F.concat(F.lit("      Link:     "), g("url")),
            opt(g("directions_url") != "", F.concat(F.lit("      Directions: "), g("directions_url"))),
            F.concat(F.lit("      Source:   "), g("source")),
        ]
    else:
        lines = [
            F.concat(F.lit("--- Listing "), number.cast("string"), F.lit(" ---")),
            F.concat(F.lit("Name:      "), g("title")),
            F.concat(F.lit("Type:      "), type_label()),
            F.concat(F.lit("Price:     "), price_label(), F.lit("/mo")),
            F.concat(F.lit("Beds:      "), F.when(g("bedrooms") != "", g("bedrooms")).otherwise(F.lit("N/A"))),
            F.concat(F.lit("Address:   "), F.coalesce(F.nullif(g("full_address"), F.lit("")), g("address"))),
            F.concat(F.lit("Area:      "), tier_label()),
            opt(g("phone") != "", F.concat(F.lit("Phone:     "), g("phone"))),
            F.concat(F.lit("Link:      "), g("url")),
            opt(g("directions_url") != "", F.concat(F.lit("Directions: "), g("directions_url"))),
            F.concat(F.lit("Source:    "), g("source")),
            F.lit(""),
        ]
    return F.concat_ws("\n", *lines)
