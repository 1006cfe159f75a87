import pytest
from pyspark.sql import functions as F

from millrace.operators import monitoring as M
from millrace.operators import prices as P
from millrace.streaming import jobs as S

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = spark.range(600).select(
        F.col("id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 7).cast("int"))).alias("ts"),
        (F.col("id") * 7 % 5).alias("user_id"),
        F.when(F.xxhash64("id") % 3 == 0, "view").otherwise("error").alias("event_type"),
        (F.abs(F.xxhash64("id", F.lit(1))) % 1000 / 10).alias("value"),
    )
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(4):  # files arrive in order of time
        rows.filter(f"event_id >= {150 * k} and event_id < {150 * (k + 1)}").coalesce(1).write.mode("append").parquet(path)
    return path


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_seen_once(spark, folder, tmp_path):
    got = S.drained(S.seen_once(S.events(spark, folder), "user_id"), "append", "seen", str(tmp_path / "c"))
    assert sorted(r.user_id for r in got.collect()) == [0, 1, 2, 3, 4]


def test_hourly_requests_reach_the_batch_result(spark, folder, tmp_path):
    got = S.drained(S.hourly_requests(S.events(spark, folder), "event_type"), "complete", "hourly", str(tmp_path / "c"))
    want = spark.read.parquet(folder).groupBy("event_type", F.window("ts", "1 hour").alias("w")).count().select("event_type", "w.start", "count")
    assert rows(got) == rows(want)


def test_child_counts(spark, folder, tmp_path):
    got = S.drained(S.child_counts(S.events(spark, folder), "user_id").select("user_id", "children"), "complete", "counts", str(tmp_path / "c"))
    assert rows(got) == rows(spark.read.parquet(folder).groupBy("user_id").count())


def test_failure_streaks_reach_the_batch_result(spark, folder, tmp_path):
    stream = S.failure_streaks(S.events(spark, folder, 1), "user_id", F.col("event_type") == "error")
    got = S.drained(stream, "append", "streaks", str(tmp_path / "c"))
    batch = M.runs(spark.read.parquet(folder), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    assert rows(got.select("user_id", "ts")) == rows(batch.filter("streak = 3").select("user_id", "ts"))


def test_learned_profile_reaches_the_batch_result(spark, folder, tmp_path):
    got = S.drained(S.learned_profile(S.events(spark, folder), "user_id", "value"), "update", "profile", str(tmp_path / "c"))
    last = got.groupBy("user_id").agg(F.max_by("ema", "n").alias("ema"))
    want = M.moving_average(spark.read.parquet(folder), "user_id", ["ts", "event_id"], "value", 0.2)
    both = last.join(want.withColumnRenamed("ema", "batch"), "user_id")
    assert both.count() == 5 and both.filter("abs(ema - batch) > 1e-9").count() == 0


def test_price_alerts_reach_the_batch_result(spark, folder, tmp_path):
    got = S.drained(S.price_alerts(S.events(spark, folder), "user_id", "value"), "append", "lows", str(tmp_path / "c"))
    history = spark.read.parquet(folder).select(F.col("user_id").alias("product_id"), F.col("ts").alias("observed_at"), "event_id", F.col("value").alias("price"))
    none = spark.createDataFrame([], "product_id bigint, threshold double")
    want = P.price_alerts(history, none, ["event_id"]).select("product_id", "observed_at", "price")
    assert rows(got) == rows(want)


def test_queue_pops_by_batch(spark, folder, tmp_path):
    stream = S.events(spark, folder).select(F.col("event_id").cast("string").alias("url"), "value").withColumnRenamed("value", "priority")
    S.top_of_queue(stream, str(tmp_path / "out"), 3, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def arriving(spark, path, rows, schema):
    """Rows as files, one after the other."""
    for r in rows:
        spark.createDataFrame([r], schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    return path


def test_a_streak_ends_after_a_long_gap_even_if_no_timer_fired(spark, tmp_path):
    times = ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-03 00:00:00", "2024-01-03 01:00:00", "2024-01-03 02:00:00"]
    rows = [(i, t, 1, "error", 1.0) for i, t in enumerate(times)]
    path = str(tmp_path / "e")
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(path)
    got = S.drained(S.failure_streaks(S.events(spark, path), "user_id", F.col("event_type") == "error"), "append", "gap", str(tmp_path / "c"))
    assert [str(r.ts) for r in got.collect()] == ["2024-01-03 02:00:00"]


def test_threshold_alerts_go_out_once(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "x", v) for i, v in enumerate([100.0, 95.0, 120.0, 94.0, 96.0])]
    path = arriving(spark, str(tmp_path / "e"), rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    got = S.drained(S.price_alerts(S.events(spark, path), "user_id", "value", 97.0), "append", "limits", str(tmp_path / "c"))
    assert sorted(r.value for r in got.collect()) == [94.0, 95.0]


def test_domain_profiles(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, tier, ok, ms) for i, (tier, ok, ms) in enumerate([(1, False, 100.0), (1, False, 200.0), (1, False, 200.0), (2, True, 300.0)])]
    path = arriving(spark, str(tmp_path / "e"), rows, "event_id bigint, ts string, domain bigint, tier int, ok boolean, response_ms double")
    got = S.drained(S.domain_profiles(S.events(spark, path), "domain"), "update", "profiles", str(tmp_path / "c"))
    last = got.orderBy(F.desc("fetches")).first()
    assert last.fetches == 4 and last.success_1 == pytest.approx(0.343) and last.success_2 == 1.0 and last.recommended == 2
    assert last.response_ms == pytest.approx(0.2 * 300 + 0.8 * (0.2 * 200 + 0.8 * (0.2 * 200 + 0.8 * 100)))


def test_low_yield_and_quota(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:0{i}", 1, "x", v) for i, v in enumerate([5.0, 1.0, 0.0, 1.0, 9.0])]
    path = arriving(spark, str(tmp_path / "e"), rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    got = S.drained(S.low_yield_aborts(S.events(spark, path), "user_id", "value", 2.0), "append", "yields", str(tmp_path / "c")).collect()
    assert [(r.pages, r["items"]) for r in got] == [(4, 7.0)]
    quota = S.drained(S.monthly_quota(S.events(spark, path), "user_id", 7), "complete", "quota", str(tmp_path / "d")).collect()
    assert [tuple(r) for r in quota] == [(1, "2024-01", 5, 2)]
