"""Merging what several sources say of a product's fields: provenance, votes, conflicts, merges.

All operators work on the long form (product_id, source_id, field_name, extracted_value, confidence), grouped by
product and field, so a popular product's rows meet per field only; aggregates keep one value each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["product_id", "field_name"]
#: Fields that add up rather than conflict, and fields in which case doesn't count.
ARRAY_FIELDS, FOLDED_FIELDS = ("palate_flavors", "primary_aromas", "finish_flavors", "awards", "images", "ratings"), ("name", "brand", "region", "country")


def filled(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def normal(value: Column, field: Column) -> Column:
    """A value for comparison: trimmed, in lower case for fields in which case doesn't count; numbers stay texts."""
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.when(field.isin(*FOLDED_FIELDS), F.lower(trimmed)).otherwise(trimmed)


def provenance(rows: DataFrame) -> DataFrame:
    """Per product and field: sources, whether values differ, the highest confidence and its value (first source)."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "source_id", "extracted_value"))
    found = rows.groupBy(*KEY).agg(F.count("*").alias("source_count"), (F.countDistinct("extracted_value") > 1).alias("has_conflict"), best.alias("b"))
    return found.select(*KEY, "source_count", "has_conflict", (-F.col("b.c")).alias("top_confidence"), F.col("b.extracted_value").alias("top_value"))


def votes(rows: DataFrame) -> DataFrame:
    """(product_id, field_name, value, votes, first_source) of filled values."""
    said = rows.filter(filled(F.col("extracted_value")))
    return said.groupBy(*KEY, F.col("extracted_value").alias("value")).agg(F.count("*").alias("votes"), F.min("source_id").alias("first_source"))


def majority(rows: DataFrame) -> DataFrame:
    """The value with most votes; among equals the one seen first; and whether others were said."""
    best = F.min(F.struct((-F.col("votes")).alias("v"), "first_source", "value"))
    found = votes(rows).groupBy(*KEY).agg(best.alias("b"), F.count("*").alias("n_values"))
    return found.select(*KEY, F.col("b.value").alias("value"), (-F.col("b.v")).alias("votes"), (F.col("n_values") > 1).alias("has_conflict"))


def verified_fields(rows: DataFrame) -> DataFrame:
    """Per product, the sorted fields of which at least two sources say the same."""
    return votes(rows).filter("votes >= 2").groupBy("product_id").agg(F.array_sort(F.collect_set("field_name")).alias("fields"))


def conflicts(rows: DataFrame, least_confidence: float = 0.0) -> DataFrame:
    """Fields with two or more sources and different filled values, as compared by ``normal``; lists never conflict."""
    known = rows.filter(~F.col("field_name").isin(*ARRAY_FIELDS))
    if least_confidence > 0:
        known = known.filter(F.col("confidence") >= least_confidence)
    value = normal(F.col("extracted_value"), F.col("field_name"))
    found = known.groupBy(*KEY).agg(F.count("*").alias("source_count"), F.countDistinct(F.when(value != "", value)).alias("value_count"))
    return found.filter((F.col("source_count") >= 2) & (F.col("value_count") > 1))


def confident_conflicts(rows: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """(product_id, field_name) with different values as they are written, of which one is at least so sure."""
    found = rows.groupBy(*KEY).agg(F.countDistinct("extracted_value").alias("values"), F.max("confidence").alias("top"))
    return found.filter((F.col("values") > 1) & (F.col("top") >= least_confidence)).select(*KEY)


def auto_resolved(rows: DataFrame, gap: float = 0.2) -> DataFrame:
    """Conflicting fields whose best source is ahead of the second by ``gap``: the value it says."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("confidence"), "source_id")))
    top = ranked.filter("rn <= 2").groupBy(*KEY).agg(
        F.max(F.when(F.col("rn") == 1, F.col("confidence"))).alias("first"),
        F.max(F.when(F.col("rn") == 2, F.col("confidence"))).alias("second"),
        F.max(F.when(F.col("rn") == 1, F.col("extracted_value"))).alias("resolved_value"),
    )
    return conflicts(rows).join(top, KEY).filter(F.round(F.col("first") - F.col("second"), 6) >= gap).select(*KEY, "resolved_value")


def confidence_merge(rows: DataFrame) -> DataFrame:
    """Sources arrive by id; a filled value replaces one of strictly lower confidence: so the earliest of the best."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "source_id", "extracted_value"))
    found = rows.filter(filled(F.col("extracted_value"))).groupBy(*KEY).agg(best.alias("b"))
    return found.select(*KEY, F.col("b.extracted_value").alias("value"), (-F.col("b.c")).alias("confidence"), F.col("b.source_id").alias("source_id"))


def refresh_merge(rows: DataFrame, identity: list[str]) -> DataFrame:
    """As ``confidence_merge``, but what is said first of an identity field stays."""
    first = F.min(F.struct("source_id", "extracted_value", "confidence"))
    kept = rows.filter(F.col("field_name").isin(*identity) & filled(F.col("extracted_value"))).groupBy(*KEY).agg(first.alias("b"))
    kept = kept.select(*KEY, F.col("b.extracted_value").alias("value"), F.col("b.confidence").alias("confidence"), F.col("b.source_id").alias("source_id"))
    return kept.unionByName(confidence_merge(rows.filter(~F.col("field_name").isin(*identity))))


def first_wins(rows: DataFrame) -> DataFrame:
    """The first filled value by source, and whether a later one differs but for case and outer spaces."""
    said = rows.filter(filled(F.col("extracted_value"))).withColumn("folded", F.lower(F.trim("extracted_value")))
    found = said.groupBy(*KEY).agg(F.min(F.struct("source_id", "extracted_value")).alias("b"), F.countDistinct("folded").alias("n"))
    return found.select(*KEY, F.col("b.extracted_value").alias("value"), (F.col("n") > 1).alias("has_conflict"))


def verify_merge(existing: Column, new: Column) -> Column:
    """What becomes of a field: set (was empty), verified (same value), conflict, or none (nothing new).

    Numbers are compared as numbers, texts without case and outer spaces.
    """
    a, b = F.trim(existing), F.trim(new)
    x, y = a.try_cast("decimal(20,6)"), b.try_cast("decimal(20,6)")
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(a) == F.lower(b))
    return F.when(~filled(new), "none").when(~filled(existing), "set").when(same, "verified").otherwise("conflict")


def merged_list(values: Column) -> Column:
    """A list without repetitions that differ only in case and outer spaces; the first spelling stays, in order."""
    folded = F.transform(values, lambda v: F.lower(F.trim(v)))
    return F.filter(values, lambda v, i: F.array_position(folded, F.lower(F.trim(v))) == i + 1)


def coverage(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Per product and field group, filled and all fields and the percentage, with the total as group ``total``.

    One aggregation by product: the set of its filled fields is no larger than the configured ones.
    """
    known = sorted({f for fields in groups.values() for f in fields})
    counts = filled(F.col("extracted_value")) & F.col("field_name").isin(*known)
    have = rows.groupBy("product_id").agg(F.collect_set(F.when(counts, F.col("field_name"))).alias("have"))
    found = {g: F.size(F.array_intersect("have", F.array(*map(F.lit, fields)))) for g, fields in groups.items()}
    entry = lambda key, total, populated: F.struct(F.lit(key).alias("group_key"), F.lit(total).cast("bigint").alias("total"), populated.cast("bigint").alias("populated"))
    entries = [entry(g, len(fields), found[g]) for g, fields in groups.items()]
    entries.append(entry("total", sum(map(len, groups.values())), sum(found.values(), F.lit(0))))
    each = have.select("product_id", F.explode(F.array(*entries)).alias("e")).select("product_id", "e.*")
    return each.withColumn("percentage", F.round(F.col("populated") / F.col("total") * 100, 2))
