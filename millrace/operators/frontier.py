"""The URL frontier and source registry: what is new, what comes next, and which sources exist already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.urls import frontier_hash, part


def unseen(urls: DataFrame, seen: DataFrame, everywhere: DataFrame) -> DataFrame:
    """URLs (queue, url, priority) that neither their queue nor any has seen, one row a queue and URL, the most urgent.

    ``seen`` has (queue, url_hash), ``everywhere`` (url_hash); both are only probed, never collected.
    """
    hashed = urls.withColumn("url_hash", frontier_hash(F.col("url")))
    new = hashed.join(seen, ["queue", "url_hash"], "left_anti").join(everywhere, "url_hash", "left_anti")
    first = F.min(F.struct((-F.col("priority")).alias("p"), "url"))
    return new.groupBy("queue", "url_hash").agg(first.alias("f")).select("queue", "url_hash", F.col("f.url").alias("url"), (-F.col("f.p")).alias("priority"))


def popped(queue: DataFrame, most: int) -> DataFrame:
    """The next ``most`` rows: highest priority, then by URL, as members of equal score are ordered by their text."""
    return queue.orderBy(F.desc("priority"), "url").limit(most)


def base_address(url: Column) -> Column:
    """Scheme, host and path of a site; https where no scheme is given, ``/`` where no path is."""
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    path = part(full, 3)
    return F.concat(part(full, 1), F.lit("://"), part(full, 2), F.when(path == "", "/").otherwise(path))


def registered(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` (site_id, url) with the known source of its host, if any: hosts are equal without case and ``www.``."""
    host = lambda c: F.regexp_replace(F.lower(part(c, 2)), r"^www\.", "")
    sites = found.withColumn("address", base_address(F.col("url"))).withColumn("host", host(F.col("address")))
    sources = known.withColumn("host", host(F.col("base_url"))).groupBy("host").agg(F.min("source_id").alias("known_source"))
    return sites.join(sources, "host", "left").select("site_id", "address", "known_source")
