"""Web sources as rows: sitemaps, robots files, search results; no network, their texts are input columns."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import settled

ORGANIC = "array<struct<position:int,title:string,link:string,snippet:string>>"
SHOPPING = "array<struct<position:int,title:string,price:string,source:string,link:string>>"
IMAGES = "array<struct<position:int,title:string,original:string,source:string>>"
NEWS = "array<struct<position:int,title:string,link:string,source:string,date:string>>"
KINDS = {"organic_results": ORGANIC, "shopping_results": SHOPPING, "images_results": IMAGES, "news_results": NEWS}


def search_results(responses: DataFrame, key: str, column: str, kind: str) -> DataFrame:
    """One row for each result of a JSON response, missing texts as empty ones."""
    parsed = F.from_json(F.get_json_object(column, f"$.{kind}"), KINDS[kind])
    rows = responses.select(key, F.posexplode(parsed).alias("pos", "r")).select(key, (F.col("pos") + 1).alias("rank"), "r.*")
    texts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string" and f.name != key]
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def sitemap_entries(files: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, url, lastmod, priority) of a sitemap's entries, or of an index's (``is_index``) sitemaps.

    A last change in none of the known forms is null; so is a priority outside 0 to 1.
    """
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    rows = files.select(key, F.col(xml).rlike("(?i)<sitemapindex").alias("is_index"), F.posexplode(blocks).alias("pos", "b"))
    tag = lambda name: F.trim(F.regexp_extract("b", rf"(?is)<{name}>(.*?)</{name}>", 1))
    priority = tag("priority").try_cast("double")
    return rows.select(key, "is_index", "pos", tag("loc").alias("url"), last_change(tag("lastmod")).alias("lastmod"), F.when(priority.between(0, 1), priority).alias("priority"))


def last_change(text: Column) -> Column:
    """A time in one of the sitemap's forms, else by ISO rules."""
    forms = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms), text.try_cast("timestamp"))


def robots_sitemaps(text: Column) -> Column:
    """The addresses of a robots file's Sitemap lines."""
    return F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))


def allowed(url: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found in a URL; patterns that don't compile are left out, and none lets all pass."""
    import re

    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    return url.rlike("(?i)(?:" + "|".join(good) + ")") if good else F.lit(True)


@F.pandas_udf(T.StringType())
def unpacked(body: pd.Series) -> pd.Series:
    """A sitemap's text from its bytes, which may be gzip members; null for what can't be unpacked."""

    def one(raw):
        try:
            return None if raw is None else (gzip.decompress(raw) if bytes(raw[:2]) == b"\x1f\x8b" else bytes(raw)).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return body.map(one)


def crawl_sitemaps(files: DataFrame, start: str, most_depth: int = 3) -> DataFrame:
    """(depth, the files' columns, url, lastmod, priority): the entries of a sitemap, and of those that an index names.

    files has (address, body, further columns); an index's entries lead to files by address, level by level, no deeper
    than ``most_depth``, and no file is read twice.
    """
    texts = files.withColumn("xml", unpacked(F.col("body"))).drop("body")
    keep = [c for c in texts.columns if c != "xml"]
    wanted = texts.filter(F.col("address") == start).withColumn("depth", F.lit(0))
    seen, out = wanted.select("address"), None
    for depth in range(most_depth + 1):
        entries = sitemap_entries(wanted.withColumn("key", F.struct(*keep, "depth")), "key", "xml")
        rows = settled(entries.select("key.depth", *(f"key.{c}" for c in keep), "is_index", "url", "lastmod", "priority"))
        out = rows if out is None else out.unionByName(rows)
        if depth == most_depth:
            break
        named = settled(rows.filter("is_index").select(F.col("url").alias("address")).distinct().join(seen, "address", "left_anti"))
        if named.isEmpty():
            break
        wanted = texts.join(named, "address", "left_semi").withColumn("depth", F.lit(depth + 1))
        seen = seen.unionByName(named)
    return out
