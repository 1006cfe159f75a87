"""URL functions as Column expressions. Four normal forms exist on purpose; each keeps its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that don't change a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source", "mc_cid", "mc_eid")
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, k: int) -> Column:
    """Scheme, authority, path or query (1 to 4) of a URL; empty where there is none."""
    return F.regexp_extract(url, _PARTS, k)


def host(url: Column) -> Column:
    """Lower-case authority without a leading ``www.``."""
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def host_anywhere(url: Column) -> Column:
    """Lower-case authority without ``www.`` wherever it stands; one caller wants it so."""
    return F.replace(F.lower(part(url, 2)), F.lit("www."), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, host, path without trailing slashes, and the query without tracking parameters, sorted by name.

    Parameters of one name keep their order; pairs without ``=`` get one; null is the empty text. Escapes in the
    query are kept as they are.
    """
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.filter(named, lambda x: ~F.lower(x["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "&")
    scheme = F.lower(part(url, 1))
    base = F.concat(F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(""), host(url), F.rtrim(part(url, 3), F.lit("/")))
    return F.when(url.isNull(), "").otherwise(F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def frontier_form(url: Column) -> Column:
    """The queue's form: trimmed, all lower case, no trailing slashes."""
    return F.rtrim(F.lower(F.trim(url)), F.lit("/"))


def frontier_hash(url: Column) -> Column:
    return F.sha2(frontier_form(url), 256)


def link_form(url: Column) -> Column:
    """The link extractor's form: scheme, authority, path and query as they stand, no fragment."""
    return F.regexp_replace(url, "#.*$", "")


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL for a link on a page: absolute links stay, ``//`` and ``/`` take what they lack from the page,
    others replace the page's last path part.
    """
    scheme, authority = part(base, 1), part(base, 2)
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#") | (link == ""), F.concat(root, part(base, 3), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )
