"""HTML functions: product sections as Column expressions, DOM signatures over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 30_000


def without_noise(html: Column) -> Column:
    """A page without scripts, styles, comments, drawings and what stands in for scripts; white space squeezed."""
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for tag in ("svg", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(out, r"\s+", " ")


def structured_product(html: Column) -> Column:
    """Name, brand, description and price lines of a page's JSON-LD product, then title and description; or empty."""
    data = F.regexp_extract(html, r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>', 1)
    field = lambda path: F.nullif(F.get_json_object(data, path), F.lit(""))
    is_product = field("$['@type']") == "Product"
    line = lambda label, value: F.when(is_product, F.concat(F.lit(f"{label}: "), value))
    meta = lambda name: F.nullif(F.regexp_extract(html, rf'(?i)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.concat_ws(
        "\n",
        line("Product Name", field("$.name")),
        line("Brand", field("$.brand.name")),
        line("Description", field("$.description")),
        line("Price", F.concat(F.coalesce(field("$.offers.priceCurrency"), F.lit("")), F.lit(" "), field("$.offers.price"))),
        F.concat(F.lit("Title: "), F.coalesce(meta("og:title"), title)),
        F.concat(F.lit("Meta: "), F.coalesce(meta("og:description"), meta("description"))),
    )


def product_section(html: Column) -> Column:
    """What a page says of its product, at most 30,000 characters: structured data over 100 characters, else the first
    main, article or product section over 500, else the page without noise.
    """
    told, clean, out = structured_product(html), without_noise(html), F.lit(None).cast("string")
    for pattern in (r"(?is)<main[^>]*>(.*?)</main>", r"(?is)<article[^>]*>(.*?)</article>", r'(?is)<div[^>]*class="[^"]*product[^"]*"[^>]*>(.*?)</div>', r'(?is)<div[^>]*id="[^"]*product[^"]*"[^>]*>(.*?)</div>'):
        found = F.regexp_extract(clean, pattern, 1)
        out = F.coalesce(out, F.when(F.length(found) > 500, found))
    return F.substring(F.when(F.length(told) > 100, told).otherwise(F.coalesce(out, clean)), 1, MOST_CHARS)


class _Signature(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        part = [tag]
        if classes := sorted((values.get("class") or "").split()):
            part.append("class=" + ",".join(classes))
        if values.get("id"):
            part.append("id=" + values["id"])
        part += [name for name, _ in attrs if name.startswith("data-")]
        self.parts.append(":".join(part))

    handle_startendtag = handle_starttag


def signature(html: str) -> str:
    """MD5 of a page's elements with their classes, ids and names of data attributes, without texts and values."""
    parser = _Signature()
    parser.feed(html or "")
    parser.close()
    return hashlib.md5("|".join(parser.parts).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def dom_signature(html: pd.Series) -> pd.Series:
    return html.map(signature)


def balanced_json(text: str, marker: str) -> str | None:
    """The JSON object that follows a marker, by counting braces outside strings; null if it isn't closed."""
    at = (text or "").find(marker)
    start = text.find("{", at + len(marker)) if at >= 0 else -1
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|[{}]', text[start:] if start >= 0 else ""):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0 and m[0] == "}":
            return text[start : start + m.end()]
    return None


@F.pandas_udf(T.StringType())
def json_after(text: pd.Series, marker: pd.Series) -> pd.Series:
    return pd.Series([balanced_json(t, m) for t, m in zip(text, marker)], dtype=object)
