"""Costs, error rates, streaks, moving averages, counters, quotas and schedules over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cost_by(costs: DataFrame, *keys: Column) -> DataFrame:
    """Sum of cents and number of requests by any keys; none gives one row, with a null sum where there are no rows."""
    sums = (F.sum("cost_cents").alias("total_cents"), F.count("*").alias("request_count"))
    return costs.groupBy(*keys).agg(*sums) if keys else costs.agg(*sums)


def within_days(rows: DataFrame, when: str, as_of: str, days: int) -> DataFrame:
    end = F.lit(as_of).cast("timestamp")
    return rows.filter(F.col(when) >= end - F.expr(f"interval {days} days"))


def error_rate(jobs: DataFrame, *keys: str) -> DataFrame:
    """Share of failed jobs by keys, to four digits; no jobs is a rate of 0. ``failed`` is a boolean column."""
    found = jobs.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("failed").alias("failed_count"))
    return found.withColumn("error_rate", F.round(F.when(F.col("total") > 0, F.col("failed_count") / F.col("total")).otherwise(0.0), 4))


def runs(rows: DataFrame, keys: list[str], order: list[str], hit: Column) -> DataFrame:
    """``rows`` with ``streak``: how many rows up to this one are hits without a break, by keys, in order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("__hit", hit).withColumn("__group", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(by))
    within = Window.partitionBy(*keys, "__group").orderBy(*order)
    return marked.withColumn("streak", F.when(F.col("__hit"), F.count_if("__hit").over(within)).otherwise(0)).drop("__hit", "__group")


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, alpha: float, start: float | None = None) -> DataFrame:
    """(key, n, ema): the exponential moving average of ``value`` in order; ``start`` or the first value begins it.

    The fold needs a key's values in order; they are collected as structs of the order and the value alone. So a key's
    whole history, two numbers an observation, stands in one row: that is inherent to the fold, whose result depends on
    the order, and bounds its use to keys of some millions of observations.
    """
    sorted_values = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v"))))
    lists = rows.groupBy(key).agg(F.transform(sorted_values, lambda s: s["v"]).alias("vs"))
    seed = F.element_at("vs", 1) if start is None else F.lit(float(start))
    rest = F.slice("vs", 2, F.size("vs")) if start is None else F.col("vs")
    fold = F.aggregate(rest, seed, lambda acc, v: F.lit(alpha) * v + F.lit(1 - alpha) * acc)
    return lists.select(key, F.size("vs").alias("n"), fold.alias("ema"))


def learned_timeout(ema: Column, n: Column, attempt: Column, base: int = 20000) -> Column:
    """Milliseconds: three times the average but at least 10 s once five are known, doubled each attempt, at most 60 s."""
    start = F.when(n >= 5, F.greatest((ema * 3).cast("int"), F.lit(10000))).otherwise(base)
    return F.least(start * F.pow(F.lit(2), attempt), F.lit(60000)).cast("int")


def yield_summary(pages: DataFrame, key: str, least_items: int, abort_at: int = 3) -> DataFrame:
    """Pages, items and status by source; ``pages`` has ``items`` and the ``streak`` of low pages."""
    found = pages.groupBy(key).agg(F.count("*").alias("pages"), F.sum("items").alias("items"), F.max("streak").alias("longest_low_run"))
    mean = F.col("items") / F.col("pages")
    status = F.when(F.col("longest_low_run") >= abort_at, "critical").when(mean < least_items, "warning").otherwise("healthy")
    return found.withColumns({"avg_items": F.round(mean, 4), "status": status})


def quota(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Used, remaining and percentage by (api, month); an api without a row has used nothing; a limit of 0 counts as
    fully used.
    """
    joined = limits.join(usage, "api", "left")
    used = F.coalesce(F.col("used"), F.lit(0))
    percent = F.when(F.col("quota") == 0, 100.0).otherwise(F.round(used / F.col("quota") * 100, 2))
    return joined.select("api", "month", used.alias("used"), F.greatest(F.col("quota") - used, F.lit(0)).alias("remaining"), percent.alias("percent"))


def next_run(schedule: Column, start: Column, errors: Column, paused_until: Column) -> Column:
    """Next run after ``start``: daily, weekly or monthly (30 days), doubled for each error, at most 7 days when there
    are errors; not before ``paused_until``; other schedules never run by themselves.
    """
    days = F.when(schedule == "daily", 1).when(schedule == "weekly", 7).when(schedule == "monthly", 30)
    # least() passes over nulls, so what never runs is kept apart.
    wait = F.when(days.isNotNull() & (errors > 0), F.least(days * F.pow(F.lit(2), errors), F.lit(7))).otherwise(days)
    due = start + F.make_dt_interval(wait.cast("int"))
    return F.when(paused_until > due, paused_until).otherwise(due)


def in_season(month: Column, start: Column, end: Column) -> Column:
    """Whether a month lies in a season, which may run over the year's end; no season is every month."""
    inside = F.when(start <= end, month.between(start, end)).otherwise((month >= start) | (month <= end))
    return F.when(start.isNull() | end.isNull(), F.lit(True)).otherwise(inside)


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """``parents`` with a count column for each child table, which has the column ``key``; none is 0."""
    out = parents
    for name, rows in children.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def changed(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``content_changed``: whether the value differs from the one before; the first is a change."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("content_changed", ~F.col(value).eqNullSafe(before))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the first by ``order``."""
    ranked = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter("__rn = 1").drop("__rn")
