"""Structured Streaming jobs over an event stream, each with the batch query whose result it reaches.

Sources are folders of Parquet files; state is bounded by watermarks or by one small value a key. Triggers are
``availableNow`` in tests and a processing time in service.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, timestamps as UTC instants."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def seen_once(stream: DataFrame, key: str, time: str = "ts", within: str | None = None) -> DataFrame:
    """The first row of each key; with ``within``, of each key in that span, and state older than it goes."""
    if within is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def hourly_requests(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Requests by key and hour; rows later than ``late`` are left out, closed hours leave the state."""
    window = F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(key, window).agg(F.count("*").alias("requests")).select(key, F.col("window.start").alias("hour"), "requests")


def child_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running counts and sums by parent, for output mode ``update``: what row triggers would maintain."""
    return stream.groupBy(key).agg(F.count("*").alias("children"), F.sum("value").alias("total"))


def failure_streaks(stream: DataFrame, key: str, failed: Column, alert_at: int = 3, expire: str = "1 day") -> DataFrame:
    """(key, ts, streak): an alert each time a key's failures in a row reach ``alert_at``; success resets, and so does
    a span of ``expire`` without events, by the events' own time. Rows of a batch are taken in order of time and id.
    """
    expire_ms = int(pd.Timedelta(expire).total_seconds() * 1000)

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak, last = state.get if state.exists else (0, None)
        alerts = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, hit in zip(rows["ts"], rows["failed"]):
            now = int(ts.timestamp() * 1000)
            if last is not None and now - last > expire_ms:
                streak = 0
            last = now if last is None else max(last, now)
            streak = streak + 1 if hit else 0
            if hit and streak == alert_at:
                alerts.append((keys[0], ts, streak))
        state.update((streak, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + expire_ms)
        yield pd.DataFrame(alerts, columns=[key, "ts", "streak"])

    marked = stream.select(key, "ts", "event_id", failed.alias("failed")).withWatermark("ts", expire)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} bigint, ts timestamp, streak int", "streak int, last long", "append", GroupStateTimeout.EventTimeTimeout)


def learned_profile(stream: DataFrame, key: str, value: str, alpha: float = 0.2) -> DataFrame:
    """(key, n, ema) after each batch: the moving average that starts with the first value."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(batches)).sort_values(["ts", "event_id"])[value]:
            ema = float(v) if n == 0 else alpha * float(v) + (1 - alpha) * ema
            n += 1
        state.update((n, ema))
        yield pd.DataFrame([(keys[0], n, ema)], columns=[key, "n", "ema"])

    return stream.select(key, "ts", "event_id", value).groupBy(key).applyInPandasWithState(step, f"{key} bigint, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)


def price_alerts(stream: DataFrame, key: str, value: str, threshold: float | None = None) -> DataFrame:
    """(key, ts, value): each value below all earlier ones of its key, and, with ``threshold``, a key's first value
    below that, once; the state is the lowest so far and whether the threshold has triggered."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lowest, triggered = state.get if state.exists else (None, False)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            v = getattr(r, value)
            if v is None or v != v:
                continue
            fell = threshold is not None and not triggered and v < threshold
            if fell or (lowest is not None and v < lowest):
                out.append((keys[0], r.ts, v))
            triggered = triggered or fell
            lowest = v if lowest is None else min(lowest, v)
        if lowest is not None:
            state.update((float(lowest), triggered))
        yield pd.DataFrame(out, columns=[key, "ts", value])

    return stream.select(key, "ts", "event_id", value).groupBy(key).applyInPandasWithState(step, f"{key} bigint, ts timestamp, {value} double", "lowest double, triggered boolean", "append", GroupStateTimeout.NoTimeout)


def domain_profiles(stream: DataFrame, key: str, alpha: float = 0.3, times: float = 0.2) -> DataFrame:
    """(key, fetches, success_1, success_2, success_3, response_ms, recommended) after each batch: for each domain the
    moving success rate of each fetch tier, which starts at 1, the moving response time, and the cheapest tier that
    mostly works. Rows: key, ts, event_id, tier, ok, response_ms."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *rates, ms = state.get if state.exists else (0, 1.0, 1.0, 1.0, 0.0)
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            i = int(r.tier) - 1
            rates[i] = alpha * float(r.ok) + (1 - alpha) * rates[i]
            ms = float(r.response_ms) if n == 0 else times * float(r.response_ms) + (1 - times) * ms
            n += 1
        state.update((n, *rates, ms))
        tier = 1 if rates[0] >= 0.5 else 2 if rates[1] >= 0.5 else 3
        yield pd.DataFrame([(keys[0], n, *rates, ms, tier)], columns=[key, "fetches", "success_1", "success_2", "success_3", "response_ms", "recommended"])

    fields = "success_1 double, success_2 double, success_3 double, response_ms double"
    rows = stream.select(key, "ts", "event_id", "tier", "ok", "response_ms")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, fetches long, {fields}, recommended int", f"n long, {fields}", "update", GroupStateTimeout.NoTimeout)


def low_yield_aborts(stream: DataFrame, key: str, value: str, least: float, run: int = 3) -> DataFrame:
    """(key, ts, pages, items): the moment at which ``run`` pages of a source in a row gave fewer than ``least`` items;
    later pages of a source that was given up are not counted."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        low, pages, items, over = state.get if state.exists else (0, 0, 0.0, False)
        out = []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if over:
                break
            v = float(getattr(r, value))
            pages, items, low = pages + 1, items + v, low + 1 if v < least else 0
            if low == run:
                over = True
                out.append((keys[0], r.ts, pages, items))
        state.update((low, pages, items, over))
        yield pd.DataFrame(out, columns=[key, "ts", "pages", "items"])

    rows = stream.select(key, "ts", "event_id", value)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} bigint, ts timestamp, pages long, items double", "low long, pages long, items double, over boolean", "append", GroupStateTimeout.NoTimeout)


def monthly_quota(stream: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, month, used, remaining) for output mode ``update``: requests of each month against a limit."""
    month = F.date_format(F.date_trunc("month", F.col("ts")), "yyyy-MM")
    used = stream.groupBy(key, month.alias("month")).agg(F.count("*").alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def polled(stream: DataFrame, every: str, work, checkpoint: str):
    """``work(batch, number)`` on what is new, at a fixed time: what a scheduler's beat would do."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drained(stream: DataFrame, mode: str, name: str, checkpoint: str) -> DataFrame:
    """What a stream gives for all that is there now, as a table in memory; for tests and small results."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def top_of_queue(stream: DataFrame, path: str, limit: int, checkpoint: str):
    """Each batch's ``limit`` most urgent rows, appended to ``path``: a queue's pop needs a sort, so it goes by batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.orderBy(F.desc("priority"), "url").limit(limit).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
