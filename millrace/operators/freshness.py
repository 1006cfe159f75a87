"""How fresh a product's data are: levels, a weighted score, and what to refresh first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days below which data are fresh or stale; points lost a day; weights of the score.
LEVEL_DAYS = {"price": (7, 30), "availability": (3, 14), "ratings": (30, 90), "awards": (90, 365), "product_details": (180, 365)}
DECAY = {"price": 3, "availability": 5, "ratings": 1, "awards": 0.3, "product_details": 0.3}
WEIGHTS = {"price": 0.35, "availability": 0.25, "ratings": 0.20, "awards": 0.10, "product_details": 0.10}
REFRESH_BELOW = 50


def whole_days(checked: Column, as_of: str) -> Column:
    """Full spans of 24 hours since ``checked``, rounded down."""
    return F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(checked)) / F.lit(86_400_000_000))


def freshness_level(kind: Column, checked: Column, as_of: str) -> Column:
    """fresh, stale or critical; never checked is critical; an unknown kind counts as product details."""
    days, level = whole_days(checked, as_of), None
    for name, (fresh, stale) in LEVEL_DAYS.items():
        value = F.when(days < fresh, "fresh").when(days < stale, "stale").otherwise("critical")
        if name == "product_details":
            level = level.otherwise(value)
        else:
            level = F.when(kind == name, value) if level is None else level.when(kind == name, value)
    return F.when(checked.isNull(), "critical").otherwise(level)


def component_score(kind: str, checked: Column, as_of: str) -> Column:
    """100 less what the days cost, cut to an integer; what was never checked has nothing stale and scores 100."""
    score = F.floor(F.greatest(F.lit(0.0), 100 - whole_days(checked, as_of) * F.lit(DECAY[kind])))
    return F.when(checked.isNull(), 100).otherwise(score).cast("int")


def freshness_score(price: Column, availability: Column, enriched: Column, as_of: str) -> Column:
    """The weighted score, cut to an integer from 1 to 100; enrichment stands for ratings, awards and details."""
    times = {"price": price, "availability": availability, "ratings": enriched, "awards": enriched, "product_details": enriched}
    total = F.lit(0.0)
    for kind, checked in times.items():
        total = total + component_score(kind, checked, as_of) * F.lit(WEIGHTS[kind])
    return F.greatest(F.lit(1), F.least(F.lit(100), F.floor(total).cast("int")))


def most_in_need(products: DataFrame, limit: int) -> DataFrame:
    """The products with the lowest scores; ties by product_id."""
    return products.orderBy("score", "product_id").limit(limit)
