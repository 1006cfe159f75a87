"""Price history: trends, stability, extremes, alerts, best prices.

A history has (product_id, price, observed_at) and columns that break ties of the time. All windows are by product,
so a product's history meets in one task; it is a few narrow columns a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISING, FALLING, STABLE = "rising", "falling", "stable"
#: A change beyond this percentage isn't stable.
TREND_PERCENT = 5
#: Fixed values: (largest coefficient of variation, score); beyond the last the score is 1.
STABILITY_STEPS = ((0.01, 10), (0.05, 9), (0.10, 8), (0.15, 7), (0.20, 6), (0.25, 5), (0.30, 4), (0.40, 3), (0.50, 2))


def since(history: DataFrame, as_of: str, days: int) -> DataFrame:
    """Observations of the ``days`` days up to ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    return history.filter((F.col("observed_at") >= end - F.expr(f"interval {days} days")) & (F.col("observed_at") <= end))


def price_trend(history: DataFrame, ties: list[str]) -> DataFrame:
    """(product_id, n, change_pct, trend): mean of the second half of the observations against that of the first.

    The middle is found over all observations; those without a price, or of price 0, then don't count in the means.
    Fewer than two observations, or a half without prices, give no trend.
    """
    by_time = Window.partitionBy("product_id").orderBy("observed_at", *ties)
    numbered = history.withColumn("rn", F.row_number().over(by_time)).withColumn("n", F.count("*").over(Window.partitionBy("product_id")))
    usable = F.when(F.col("price") != 0, F.col("price"))
    half = F.floor(F.col("n") / 2)
    means = numbered.groupBy("product_id").agg(
        F.max("n").alias("n"),
        F.avg(F.when(F.col("rn") <= half, usable)).alias("before"),
        F.avg(F.when(F.col("rn") > half, usable)).alias("after"),
    )
    change = F.when(F.col("n") >= 2, (F.col("after") - F.col("before")) / F.col("before") * 100)
    named = F.when(F.col("change") > TREND_PERCENT, RISING).when(F.col("change") < -TREND_PERCENT, FALLING).when(F.col("change").isNotNull(), STABLE)
    return means.withColumn("change", change).select("product_id", "n", F.round("change", 2).alias("change_pct"), named.alias("trend"))


def stability_score(variation: Column) -> Column:
    score = F.when(variation <= STABILITY_STEPS[0][0], STABILITY_STEPS[0][1])
    for most, value in STABILITY_STEPS[1:]:
        score = score.when(variation <= most, value)
    return F.when(variation.isNotNull(), score.otherwise(1))


def price_stability(history: DataFrame) -> DataFrame:
    """(product_id, n_prices, stability): 10 for prices that hardly vary, 1 for wild ones; from two prices on."""
    stats = history.filter("price is not null").groupBy("product_id").agg(F.count("*").alias("n_prices"), F.stddev_samp("price").alias("sd"), F.avg("price").alias("mean"))
    variation = F.when((F.col("n_prices") >= 2) & (F.col("mean") != 0), F.col("sd") / F.col("mean"))
    return stats.select("product_id", "n_prices", stability_score(variation).cast("int").alias("stability"))


def price_extremes(history: DataFrame, ties: list[str]) -> DataFrame:
    """The lowest and highest price ever with their first days. Missing prices are left out, on both ends."""
    first = F.struct("observed_at", *ties)
    priced = history.filter("price is not null")
    least = F.min(F.struct(F.col("price"), first.alias("at")))
    most = F.min(F.struct((-F.col("price")).alias("price"), first.alias("at")))
    found = priced.groupBy("product_id").agg(least.alias("least"), most.alias("most"))
    return found.select(
        "product_id",
        F.col("least.price").alias("lowest_price"),
        F.to_date("least.at.observed_at").alias("lowest_date"),
        (-F.col("most.price")).alias("highest_price"),
        F.to_date("most.at.observed_at").alias("highest_date"),
    )


def price_alerts(history: DataFrame, thresholds: DataFrame, ties: list[str]) -> DataFrame:
    """Alerts as prices arrive: ``new_low`` below all earlier prices, ``price_drop`` once, below the product's threshold.

    ``thresholds`` has (product_id, threshold); products without one have no drops.
    """
    by_time = Window.partitionBy("product_id").orderBy("observed_at", *ties)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    rows = history.filter("price is not null").join(thresholds, "product_id", "left")
    below = F.col("price") < F.col("threshold")
    marked = rows.withColumn("low_before", F.min("price").over(before)).withColumn("dropped_before", F.coalesce(F.max(below).over(before), F.lit(False)))
    kinds = F.array_compact(
        F.array(
            F.when(below & ~F.col("dropped_before"), F.lit("price_drop")),
            F.when(F.col("price") < F.col("low_before"), F.lit("new_low")),
        )
    )
    return marked.select("product_id", "observed_at", *ties, "price", F.explode(kinds).alias("alert_type"))


def best_price(offers: DataFrame, ties: list[str]) -> DataFrame:
    """(product_id, best_price, retailer_id): the least price above 0; among equals the first."""
    chosen = F.min(F.struct(F.col("price"), *ties, F.col("retailer_id")))
    found = offers.filter("price > 0").groupBy("product_id").agg(chosen.alias("o"))
    return found.select("product_id", F.col("o.price").alias("best_price"), F.col("o.retailer_id").alias("retailer_id"))


def availability(offers: DataFrame) -> DataFrame:
    """Per product: retailers, those in stock, and mean, least and largest price among known prices."""
    return offers.groupBy("product_id").agg(
        F.count("*").alias("retailer_count"),
        F.count_if("in_stock").alias("in_stock_count"),
        F.round(F.avg("price"), 2).alias("price_avg"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
    )
