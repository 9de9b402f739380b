"""Column expressions for addresses: sites, normal forms, kinds of pages and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.lexicon import LINK_TYPES, NO_PAGE_ENDINGS, OTHER_PAGE_TYPE, PAGE_TYPES

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):/{2,}(?:[^/?#@]*@)?([^/?#:\\]+)(?::[0-9]*)?([^?#]*)"
_VALID = r"^[A-Za-z][A-Za-z0-9+.-]*:/{2,}(?:[^/?#@]*@)?[^/?#:\\\s]+(?::[0-9]*)?(?:[/?#].*)?$"


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_VALID), F.lit(False))


def host(url: Column) -> Column:
    """The small-letter host; empty for what is no address."""
    return F.when(is_url(url), F.lower(F.regexp_extract(url, _PARTS, 2))).otherwise(F.lit(""))


def site_key(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(url, _PARTS, 3), " ", "%20")
    return F.when(found == "", F.lit("/")).otherwise(found)


def shown_path(url: Column) -> Column:
    """The path of an address; what is none as it is."""
    return F.when(is_url(url), path(url)).otherwise(F.coalesce(url, F.lit("")))


def shortened(text: Column, most: int = 55) -> Column:
    """The first `most` characters with an ellipsis, where there are more."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("…"))).otherwise(whole)


def normalize(url: Column, every_slash: bool = False) -> Column:
    """Host without www. and path, in small letters, without one closing slash; what is no address in small letters.

    every_slash: all closing slashes go, but for that of the root.
    """
    where = F.concat(site_key(url), path(url))
    if every_slash:
        bare = F.regexp_replace(path(url), "/+$", "")
        where = F.concat(site_key(url), F.when(bare == "", F.lit("/")).otherwise(bare))
    else:
        where = F.regexp_replace(where, "/$", "")
    return F.when(is_url(url), F.lower(where)).otherwise(F.lower(url))


def slug(url: Column) -> Column:
    """The path's words, in small letters; empty for what is no address."""
    return F.when(is_url(url), F.lower(F.trim(F.regexp_replace(path(url), "[/-]", " ")))).otherwise(F.lit(""))


def page_type(url: Column) -> Column:
    low = F.lower(url)
    out = F.lit(OTHER_PAGE_TYPE)
    for name, pattern in reversed(PAGE_TYPES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def link_type(source: Column, target: Column) -> Column:
    out = F.concat(source, F.lit("-to-"), target)
    for (a, b), name in LINK_TYPES.items():
        out = F.when((source == a) & (target == b), F.lit(name)).otherwise(out)
    return out


def is_page_url(url: Column) -> Column:
    """Whether a sitemap's address may be a page: http, and no ending of another kind of file."""
    plain = F.substring_index(F.lower(url), "?", 1)
    return F.coalesce(url.startswith("http"), F.lit(False)) & ~F.coalesce(plain.rlike(rf"\.({'|'.join(NO_PAGE_ENDINGS)})$"), F.lit(False))


def matches_patterns(url: Column, include: list[str], exclude: list[str]) -> Column:
    """No part of exclude is in the address, and some part of include is, if there are any."""
    out = F.lit(True)
    for x in exclude:
        out = out & ~url.contains(x)
    if include:
        some = F.lit(False)
        for x in include:
            some = some | url.contains(x)
        out = out & some
    return out
