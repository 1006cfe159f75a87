"""Completeness scores, status rules, quality gates, priorities and confidences of product records.

Records are rows with a column for each field. Rules are Column expressions; what they need of the configuration is a
few literals, so a plan stays one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(value: Column, kind: str) -> Column:
    """Whether a scorer counts a value: texts that aren't empty, numbers other than 0, lists with entries."""
    if kind == "string":
        return F.coalesce(value != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return F.coalesce(value != 0, F.lit(False))


def points(*pairs: tuple[Column, int], most: int | None = None) -> Column:
    total = F.lit(0)
    for condition, value in pairs:
        total = total + F.when(condition, value).otherwise(0)
    return total if most is None else F.least(total, F.lit(most))


def completeness() -> Column:
    """0 to 100 over a product record's columns: identity 15, basics 15, palate 20, nose 10, finish 10, enrichment 20,
    sources 10.
    """
    text, number, listed = (lambda c, k=k: truthy(F.col(c), k) for k in ("string", "number", "array"))
    two = lambda c: F.coalesce(F.size(c) >= 2, F.lit(False))
    total = (
        points((text("name"), 10), (number("brand_id"), 5), (text("product_type"), 5), (number("abv"), 5), (text("description"), 5))
        + points((two("palate_flavors"), 10), (text("palate_description") | text("initial_taste"), 5), (text("mid_palate_evolution"), 3), (text("mouthfeel"), 2), most=20)
        + points((text("nose_description"), 5), (two("primary_aromas"), 5), most=10)
        + points((text("finish_description") | text("final_notes"), 5), (two("finish_flavors"), 3), (number("finish_length"), 2), most=10)
        + points((number("best_price"), 5), (listed("images"), 5), (listed("ratings"), 5), (listed("awards"), 5))
        + points((F.col("source_count") >= 2, 5), (F.col("source_count") >= 3, 5))
    )
    return F.least(total, F.lit(100))


def filled(name: str) -> Column:
    """Whether a text column has more than white space."""
    return F.coalesce(F.trim(name) != "", F.lit(False))


def completeness_service() -> Column:
    """0 to 100 by the service's rules, which differ: palate needs three flavours, finish counts flavours more, and
    category, appearance, ratings of taste and fewer points for pictures and awards come in."""
    text, number, listed = (lambda c, k=k: truthy(F.col(c), k) for k in ("string", "number", "array"))
    least = lambda c, n: F.coalesce(F.size(c) >= n, F.lit(False))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    looks = filled("color_description") | positive("color_intensity") | filled("clarity") | filled("viscosity")
    taste = positive("flavor_intensity") | positive("complexity") | positive("balance")
    total = (
        points((text("name"), 10), (number("brand_id"), 5), (text("product_type"), 5), (number("abv"), 5), (filled("category"), 3), (filled("description"), 5))
        + points((least("palate_flavors", 3), 10), (filled("palate_description") | filled("initial_taste"), 5), (filled("mid_palate_evolution"), 3), (filled("mouthfeel"), 2), most=20)
        + points((filled("nose_description"), 5), (least("primary_aromas", 2), 5), most=10)
        + points((least("finish_flavors", 2), 5), (filled("finish_description") | filled("final_notes"), 3), (positive("finish_length"), 2), most=10)
        + points((looks, 3), (taste, 5), (number("best_price"), 5), (listed("images"), 2), (listed("awards"), 2))
        + points((F.col("source_count") >= 2, 5), (F.col("source_count") >= 3, 5))
    )
    return F.least(total, F.lit(100))


def completeness_pipeline() -> Column:
    """0 to 100 by the pipeline's rules for what was extracted: as the record's, but the brand is a text, the price may
    be either of two, and an unknown number of sources is one."""
    text, number, listed = (lambda c, k=k: truthy(F.col(c), k) for k in ("string", "number", "array"))
    two = lambda c: F.coalesce(F.size(c) >= 2, F.lit(False))
    sources = F.coalesce("source_count", F.lit(1))
    total = (
        points((text("name"), 10), (text("brand"), 5), (text("product_type"), 5), (number("abv"), 5), (text("description"), 5))
        + points((two("palate_flavors"), 10), (text("palate_description") | text("initial_taste"), 5), (text("mid_palate_evolution"), 3), (text("mouthfeel"), 2), most=20)
        + points((text("nose_description"), 5), (two("primary_aromas"), 5), most=10)
        + points((text("finish_description") | text("final_notes"), 5), (two("finish_flavors"), 3), (number("finish_length"), 2), most=10)
        + points((number("best_price") | number("price"), 5), (listed("images"), 5), (listed("ratings"), 5), (listed("awards"), 5))
        + points((sources >= 2, 5), (sources >= 3, 5))
    )
    return F.least(total, F.lit(100))


def has_palate_service() -> Column:
    """The service's rule: two flavours, or a description that isn't blank."""
    return F.coalesce(F.size("palate_flavors") >= 2, F.lit(False)) | filled("palate_description") | filled("initial_taste")


# Weighted fields in the order in which missing ones are told.
WEIGHTED_FIELDS = {
    "name": 10, "brand": 10, "product_type": 8, "abv": 6, "age_statement": 5, "region": 5, "category": 5, "primary_cask": 4, "finishing_cask": 3,
    "nose_description": 4, "palate_flavors": 4, "finish_length": 3, "primary_aromas": 3, "color_description": 2, "maturation_notes": 2,
    "food_pairings": 2, "serving_recommendation": 2, "best_price": 7, "award_count": 5, "rating_count": 4,
}


def missing_weighted(present: dict[str, Column]) -> Column:
    """(field, weight) of the weighted fields that aren't filled, in order; fields without a column are missing.

    Counters have to be over 0; other numbers are filled if they are there, 0 included.
    """
    entry = lambda f: F.struct(F.lit(f).alias("field"), F.lit(WEIGHTED_FIELDS[f]).alias("weight"))
    return F.array_compact(F.array(*(F.when(~F.coalesce(present[f], F.lit(False)) if f in present else F.lit(True), entry(f)) for f in WEIGHTED_FIELDS)))


def has_palate() -> Column:
    """Any palate data; one flavour is enough for the status, though not for points."""
    return truthy(F.col("palate_flavors"), "array") | truthy(F.col("palate_description"), "string") | truthy(F.col("initial_taste"), "string")


def status(score: Column, palate: Column, current: Column, least_sources: Column | None = None) -> Column:
    """incomplete, partial, complete or verified; rejected and merged stay. Without palate data at most partial.

    ``least_sources``, where given, must hold for verified (the service's rule); otherwise it is complete.
    """
    low = F.when(score >= 30, "partial").otherwise("incomplete")
    top = F.lit("verified") if least_sources is None else F.when(least_sources, "verified").otherwise("complete")
    rated = F.when(score >= 80, top).when(score >= 60, "complete").otherwise(low)
    return F.when(current.isin("rejected", "merged"), current).when(palate, rated).otherwise(low)


def tier(score: Column) -> Column:
    return F.when(score >= 90, "complete").when(score >= 70, "good").when(score >= 40, "partial").otherwise("skeleton")


def enrichment_priority(score: Column, awards: Column, ratings: Column, is_new: Column) -> Column:
    """1 to 10; low scores, awards, ratings and new releases come first."""
    base = F.greatest(F.lit(1), 10 - F.floor(score / 11).cast("int"))
    boost = F.when(awards >= 3, 2).when(awards >= 1, 1).otherwise(0) + F.when(ratings >= 5, 1).otherwise(0) + F.when(is_new, 1).otherwise(0)
    return F.greatest(F.lit(1), F.least(F.lit(10), base + boost))


def named(value: Column, fussy: bool = True) -> Column:
    """Whether an extracted text says something; "unknown", "n/a" and "none" don't where ``fussy``."""
    says = F.coalesce(F.trim(value) != "", F.lit(False))
    return says & ~F.coalesce(F.lower(value).isin("unknown", "n/a", "none"), F.lit(False)) if fussy else says


def record_confidence(name: Column, important: list[Column], optional: list[Column]) -> Column:
    """0.5 for the name, 0.4 shared by the important fields, 0.1 by the others; at least 0.35 with a name."""
    share = lambda fields, fussy: sum((F.when(named(c, fussy), 1).otherwise(0) for c in fields), F.lit(0)) / F.lit(len(fields))
    score = F.when(named(name), 0.5).otherwise(0.0) + 0.4 * share(important, True) + 0.1 * share(optional, False)
    return F.round(F.when(named(name, False), F.greatest(score, F.lit(0.35))).otherwise(score), 2)


def all_of(populated: Column, fields: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, fields)), populated)) == 0 if fields else F.lit(True)


def any_of_each(populated: Column, groups: list[list[str]]) -> Column:
    out = F.lit(True)
    for group in groups:
        out = out & F.arrays_overlap(F.array(*map(F.lit, group)), populated)
    return out


# Categories that need neither a cask nor a region.
BLENDS = (
    "blended scotch whisky", "blended scotch", "blended whisky", "blended whiskey", "blended malt",
    "blended malt scotch whisky", "blended grain whisky", "canadian whisky", "canadian whiskey",
)


def gate_v3(populated: Column, coverage: Column, category: Column, style: Column, rules: dict) -> Column:
    """rejected < skeleton < partial < baseline < enriched < complete, from the set of populated fields.

    Coverage of 90 % is complete. ``rules`` has the lists of required fields and groups of which one is needed;
    ``waivers`` names styles that need no group with ``indication_age`` or ``harvest_year``. Some categories need no
    cask or region.
    """
    low = F.lower(F.trim(F.coalesce(category, F.lit(""))))
    without = lambda fields, *gone: [f for f in fields if f not in gone]

    def required(name: str, cask: bool) -> Column:
        fields = rules[name]
        out = F.when(low.isin(*BLENDS), all_of(populated, without(fields, *(("primary_cask",) if cask else ()), "region")))
        return out.otherwise(all_of(populated, fields))

    aged = [g for g in rules["baseline_or"] if {"indication_age", "harvest_year"} & set(g)]
    waived = F.lower(F.coalesce(style, F.lit(""))).isin(*rules.get("waivers", [])) if rules.get("waivers") else F.lit(False)
    groups = any_of_each(populated, [g for g in rules["baseline_or"] if g not in aged]) & (waived | any_of_each(populated, aged))
    baseline = required("baseline", True) & groups
    enriched = baseline & all_of(populated, rules["enriched"]) & any_of_each(populated, rules["enriched_or"])
    return (
        F.when(~F.array_contains(populated, "name"), "rejected")
        .when(coverage >= 90, "complete")
        .when(enriched, "enriched")
        .when(baseline, "baseline")
        .when(required("partial", False), "partial")
        .when(all_of(populated, rules["skeleton"]), "skeleton")
        .otherwise("rejected")
    )


def gate_v2(populated: Column, rules: list[tuple[str, list[str], int, list[str]]]) -> Column:
    """The first of ``rules`` (status, required fields, number, fields of which so many are needed) that holds."""
    out = F.when(~F.array_contains(populated, "name"), "rejected")
    for name, needed, least, among in rules:
        some = F.size(F.array_intersect(populated, F.array(*map(F.lit, among)))) >= least if least else F.lit(True)
        out = out.when(all_of(populated, needed) & some, name)
    return out.otherwise("skeleton")


def confident(confidences: Column, least: float = 0.5) -> Column:
    """Entries of a map of confidences that count; an unknown confidence counts as 1."""
    return F.map_filter(confidences, lambda _, v: F.coalesce(v, F.lit(1.0)) >= least)
