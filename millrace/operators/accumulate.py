"""Merging whole fields, lists and maps: two records side by side, or a field's many sources in order of arrival.

Two records are merged by Column expressions. Of many sources, a fold by arrival has a closed form: a value is replaced
only by one of strictly higher confidence, so what stays begins with the first source of the highest confidence, and
lists and maps collect from there on. That takes two aggregations by key, whatever the number of sources, and no list
of a key's sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merging import merged_list

# Fields that two sources can verify.
VERIFIABLE = ("name", "brand", "abv", "age_statement", "volume_ml", "country", "region", "palate_description", "nose_description", "finish_description", "palate_flavors")


def empty(value: Column, kind: str) -> Column:
    """Whether a value says nothing: null, blank text, empty list or map; 0 and false say something."""
    if kind == "string":
        return F.coalesce(F.trim(value) == "", F.lit(True))
    if kind in ("array", "map"):
        return F.coalesce(F.size(value) <= 0, F.lit(True))
    return value.isNull()


def key_of(item: Column) -> Column:
    return F.lower(F.trim(item))


def with_new(existing: Column, new: Column, folded: bool = True) -> Column:
    """A list followed by another's items that it hasn't, each once; without case and outer spaces if ``folded``."""
    key = key_of if folded else (lambda x: x)
    have = F.transform(existing, key)
    added = F.filter(new, lambda x: ~F.coalesce(F.array_contains(have, key(x)), F.lit(False)))
    once = merged_list(added) if folded else F.array_distinct(added)
    return F.concat(existing, once)


def filled_map(existing: Column, new: Column) -> Column:
    """A map with another's entries where it has no key, or an empty value; nothing is replaced."""
    old = F.map_filter(existing, lambda k, v: ~empty(v, "string"))
    more = F.map_filter(new, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(old), k), F.lit(False)))
    kept = F.map_filter(existing, lambda k, v: empty(v, "string") & ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.map_concat(old, kept, more)


def merge(existing: Column, sure: Column, new: Column, new_sure: Column, kind: str) -> Column:
    """struct(value, confidence, enriched) of a field merged by confidence.

    An empty new value changes nothing; an empty old one, or one of strictly lower confidence (unknown counts as 0), is
    replaced; otherwise lists and maps take what they haven't, at the old confidence.
    """
    old_sure = F.coalesce(sure, F.lit(0.0))
    replaced = ~empty(new, kind) & (empty(existing, kind) | (new_sure > old_sure))
    grown = {"array": with_new, "map": filled_map}[kind](existing, new) if kind in ("array", "map") else existing
    value = F.when(empty(new, kind), existing).when(replaced, new).otherwise(grown)
    more = ~empty(new, kind) & ~replaced & ((F.size(grown) > F.size(existing)) if kind == "array" else (grown != existing) if kind == "string" else F.lit(False))
    if kind == "map":
        told = lambda m: F.size(F.map_filter(m, lambda _, v: ~empty(v, "string")))
        more = ~empty(new, kind) & ~replaced & (told(grown) > told(existing))
    return F.struct(value.alias("value"), F.when(replaced, new_sure).otherwise(sure).alias("confidence"), F.coalesce(replaced | more, F.lit(False)).alias("enriched"))


def merge_v2(existing: Column, sure: Column, new: Column, new_sure: Column, kind: str) -> Column:
    """struct(value, confidence, enriched) by the second merger's rules: only null is no new value, blanks count as
    values, an unknown new confidence is 0.5, and lists compare their items as they are."""
    old_sure, its = F.coalesce(sure, F.lit(0.0)), F.coalesce(new_sure, F.lit(0.5))
    nothing = existing.isNull() | ((F.size(existing) == 0) if kind == "array" else (existing == "") if kind == "string" else F.lit(False))
    replaced = new.isNotNull() & (nothing | (its > old_sure))
    grown = with_new(existing, new, folded=False) if kind == "array" else existing
    value = F.when(new.isNull(), existing).when(replaced, new).otherwise(grown)
    more = new.isNotNull() & ~replaced & (F.size(grown) > F.size(existing)) if kind == "array" else F.lit(False)
    return F.struct(value.alias("value"), F.when(replaced, its).otherwise(sure).alias("confidence"), F.coalesce(replaced | more, F.lit(False)).alias("enriched"))


def fill_missing(existing: Column, new: Column, kind: str) -> Column:
    """The new value where the old one is missing (0 counts as missing); lists are united, in order of their items."""
    if kind == "array":
        none = F.array().cast("array<string>")
        return F.when(F.size(new) > 0, F.array_sort(F.array_union(F.coalesce(existing, none), new))).otherwise(existing)
    missing = F.coalesce(existing == (F.lit("") if kind == "string" else F.lit(0)), F.lit(True))
    return F.when(missing, F.coalesce(new, existing)).otherwise(existing)


def newly_verified(verified: Column, fields: dict[str, tuple[Column, Column, str]]) -> Column:
    """Fields that a second source confirms: both filled and equal, texts without case and outer spaces, lists as sets;
    ``fields`` has (old, new, kind) by name, in the order of VERIFIABLE. Known ones come first."""

    def same(old: Column, new: Column, kind: str) -> Column:
        if kind == "string":
            return (old != "") & (new != "") & (key_of(old) == key_of(new))
        if kind == "array":
            return (F.size(old) > 0) & (F.size(new) > 0) & (F.array_sort(F.array_distinct(old)) == F.array_sort(F.array_distinct(new)))
        return (old != 0) & (new != 0) & (old == new)

    found = F.array(*(F.when(F.coalesce(same(*fields[f]), F.lit(False)) & ~F.array_contains(verified, f), F.lit(f)) for f in VERIFIABLE if f in fields))
    return F.concat(verified, F.array_compact(found))


def add_award(awards: Column, award: Column) -> Column:
    """A record's awards with one more, unless one of its competition and year is there, or it has no medal."""
    known = F.exists(awards, lambda a: a["competition"].eqNullSafe(award["competition"]) & a["year"].eqNullSafe(award["year"]))
    fit = ~known & (F.coalesce(award["competition"], F.lit("")) != "") & (F.coalesce(award["medal"], F.lit("")) != "")
    return F.when(fit, F.concat(awards, F.array(award))).otherwise(awards)


def from_best(rows: DataFrame, key: list[str], order: str, confidence: str) -> DataFrame:
    """The rows of a key's first source of the highest confidence, and of all that came after it."""
    best = F.min(F.struct((-F.col(confidence)).alias("c"), F.col(order).alias("o"))).over(Window.partitionBy(*key))
    return rows.withColumn("__best", best).filter(F.col(order) >= F.col("__best.o")).drop("__best")


def merge_lists(rows: DataFrame, key: list[str], order: str, values: str, confidence: str) -> DataFrame:
    """(key, values) of list fields merged in order: items without repetitions that differ in case or outer spaces."""
    told = rows.filter(F.size(values) > 0)
    items = from_best(told, key, order, confidence).select(*key, F.col(order).alias("o"), F.posexplode(values).alias("i", "item"))
    return _collected(items.withColumn("__item", key_of(F.col("item"))), key)


def first_lists(rows: DataFrame, key: list[str], order: str, values: str) -> DataFrame:
    """(key, values) of all sources' items in order, each once as it is written."""
    items = rows.select(*key, F.col(order).alias("o"), F.posexplode(values).alias("i", "item"))
    return _collected(items.withColumn("__item", F.col("item")), key)


def refresh_lists(rows: DataFrame, key: list[str], order: str, values: str, confidence: str) -> DataFrame:
    """(key, values, confidence) of list fields refreshed: all sources' items in order, each once without case and
    outer spaces, whatever the confidence, and the highest confidence."""
    items = rows.select(*key, F.col(order).alias("o"), F.posexplode(values).alias("i", "item"))
    lists = _collected(items.withColumn("__item", key_of(F.col("item"))), key)
    return rows.groupBy(*key).agg(F.max(confidence).alias("confidence")).join(lists, key, "left").select(*key, "values", "confidence")


def _collected(items: DataFrame, key: list[str]) -> DataFrame:
    first = items.groupBy(*key, "__item").agg(F.min(F.struct("o", "i", "item")).alias("f"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["item"]).alias("values"))


def merge_maps(rows: DataFrame, key: list[str], order: str, values: str, confidence: str) -> DataFrame:
    """(key, map_key, value) of map fields merged in order: each key's first filled value, from the best source on."""
    told = rows.filter(F.size(values) > 0)
    entries = from_best(told, key, order, confidence).select(*key, F.col(order).alias("o"), F.explode(values).alias("map_key", "value"))
    filled_first = F.min(F.struct(empty(F.col("value"), "string").alias("e"), "o", "value"))
    return entries.groupBy(*key, "map_key").agg(filled_first.alias("f")).select(*key, "map_key", F.col("f.value").alias("value"))
