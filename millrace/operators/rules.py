"""Smaller rules of the pipeline: boosts, missing fields, enums, budgets, slugs, severities, priorities of kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boosted(confidence: Column, boost: float = 0.1, most: float = 0.95) -> Column:
    """A producer's own page is believed more, up to a bound."""
    return F.least(confidence + boost, F.lit(most))


def missing(fields: dict[str, Column]) -> Column:
    """Names of the fields that aren't filled, in the order given."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fields.items())))


def failures(checks: dict[str, Column]) -> Column:
    """Reasons of the checks that fail; empty if all hold."""
    return missing(checks)


def enum_value(text: Column, allowed: tuple[str, ...]) -> Column:
    """struct(value, warning): the allowed value in lower case, or none and a warning."""
    low = F.lower(F.trim(text))
    known = low.isin(*allowed)
    return F.struct(F.when(known, low).alias("value"), F.when(~known & (low != ""), F.concat(F.lit("invalid: "), text)).alias("warning"))


def mapped(text: Column, table: dict[str, str], default: str) -> Column:
    """The class a table has for a text, without case and outer spaces; a default otherwise."""
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, F.lower(F.trim(text))), F.lit(default))


def success_rate(new: Column, failed: Column) -> Column:
    return F.when(new + failed > 0, new / (new + failed)).otherwise(0.0)


def severity(failed: Column, total: Column) -> Column:
    """One failing selector is a warning, more are critical; more than half healthy is healthy."""
    return F.when(failed > 1, "critical").when(failed == 1, "warning").otherwise("ok")


def unique_slugs(rows: DataFrame, slug: str, order: list[str]) -> DataFrame:
    """``rows`` with a suffix -1, -2, ... at the second and further rows of a slug."""
    k = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    return rows.withColumn("unique_slug", F.when(k == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), (k - 1).cast("string"))))


def appended(entries: Column, entry: Column, key: str) -> Column:
    """A list of structs with one more, unless one with its key is there."""
    return F.when(F.exists(entries, lambda e: e[key].eqNullSafe(entry[key])), entries).otherwise(F.concat(entries, F.array(entry)))


def tracked(rows: DataFrame, key: str) -> DataFrame:
    """Source tracking by product: sets of sources, all rejections in order, most steps."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_list("rejected")).alias("rejected"), F.max("steps").alias("steps"))


def tracking_merged(old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """A record's source tracking after another run: sources united, rejections appended, provenance by the newer run,
    the higher number of steps, the newer time."""
    none = F.array().cast("array<string>")
    texts = lambda c: F.coalesce(c, none)
    maps = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(maps(old["provenance"]), lambda k, _: ~F.array_contains(F.map_keys(maps(new["provenance"])), k))
    return {
        "sources": F.array_sort(F.array_union(texts(old["sources"]), texts(new["sources"]))), "rejected": F.concat(texts(old["rejected"]), texts(new["rejected"])),
        "provenance": F.map_concat(kept, maps(new["provenance"])), "steps": F.greatest(F.coalesce(old["steps"], F.lit(0)), F.coalesce(new["steps"], F.lit(0))), "at": new["at"],
    }


def duration_seconds(started: Column, completed: Column, now: Column) -> Column:
    """Whole seconds of a job, up to now while it runs; null for one that hasn't started."""
    return F.floor(F.coalesce(completed, now).cast("double") - started.cast("double")).cast("bigint")


def within_budget(rows: DataFrame, key: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows that a budget still pays for, in order; refunded rows (``refund``) cost nothing."""
    spent = F.sum(F.when(F.col("refund"), 0).otherwise(F.col(cost))).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("spent", spent).filter(F.col("spent") <= budget)


def should_enrich(status: Column) -> Column:
    return status.isin("skeleton", "partial", "baseline")


def recently(at: Column, as_of: str, days: int) -> Column:
    """Whether something was done in the last days; never done is not recent."""
    return F.coalesce(at > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"), F.lit(False))


def term_parts(term: Column, default_year: int) -> Column:
    """struct(key, year) of ``key:year``; the year may be missing."""
    parts = F.split(term, ":")
    return F.struct(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(default_year)).alias("year"))
