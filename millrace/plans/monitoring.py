"""Monitoring queries: events and orders in the roles of cost, crawl and job logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import freshness as R
from millrace.operators import monitoring as M
from millrace.registry import query
from millrace.sources.tables import table

EVENTS_AS_OF, JOBS_AS_OF = "2024-01-31", "1998-08-02"


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("ts", F.col("event_type").alias("service"), F.floor(F.col("value") * 100).cast("bigint").alias("cost_cents"))


COSTS_SQL = "c as (select ts, event_type as service, floor(value * 100)::bigint as cost_cents from events)"


@query("cost_daily", f"with {COSTS_SQL} select ts::date::varchar as day, service, sum(cost_cents)::bigint as total_cents, count(*) as request_count from c where ts >= timestamp '{EVENTS_AS_OF}' - interval 7 days group by 1, 2")
def cost_daily(spark, folder):
    recent = M.within_days(_costs(spark, folder), "ts", EVENTS_AS_OF, 7)
    return M.cost_by(recent, F.to_date("ts").cast("string").alias("day"), F.col("service")).orderBy(F.desc("day"), "service")


@query("cost_weekly", f"with {COSTS_SQL} select date_trunc('week', ts)::date::varchar as week, service, sum(cost_cents)::bigint as total_cents, count(*) as request_count from c where ts >= timestamp '{EVENTS_AS_OF}' - interval 30 days group by 1, 2")
def cost_weekly(spark, folder):
    recent = M.within_days(_costs(spark, folder), "ts", EVENTS_AS_OF, 30)
    return M.cost_by(recent, F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week"), F.col("service")).orderBy(F.desc("week"), "service")


@query("cost_by_service", f"with {COSTS_SQL} select service, sum(cost_cents)::bigint as total_cents, count(*) as request_count from c where ts >= timestamp '{EVENTS_AS_OF}' - interval 30 days group by 1")
def cost_by_service(spark, folder):
    return M.cost_by(M.within_days(_costs(spark, folder), "ts", EVENTS_AS_OF, 30), F.col("service"))


@query("cost_total", f"with {COSTS_SQL} select sum(cost_cents)::bigint as total_cents, count(*) as request_count from c where ts >= timestamp '{EVENTS_AS_OF}' - interval 30 days")
def cost_total(spark, folder):
    return M.cost_by(M.within_days(_costs(spark, folder), "ts", EVENTS_AS_OF, 30))


@query("error_rate_by_source", f"select user_id as source_id, count(*) as total, count(*) filter (where event_type = 'error') as failed_count, round(count(*) filter (where event_type = 'error') / count(*), 4) as error_rate from events where ts >= timestamp '{EVENTS_AS_OF}' - interval 14 days group by 1")
def error_rate_by_source(spark, folder):
    jobs = table(spark, folder, "events").select("ts", F.col("user_id").alias("source_id"), (F.col("event_type") == "error").alias("failed"))
    return M.error_rate(M.within_days(jobs, "ts", EVENTS_AS_OF, 14), "source_id")


@query("error_rate_daily", "select o_orderdate::date::varchar as day, count(*) as total, count(*) filter (where o_orderstatus = 'F') as failed_count, round(count(*) filter (where o_orderstatus = 'F') / count(*), 4) as error_rate, round(count(*) filter (where o_orderstatus = 'F') / count(*), 4) > 0.1 as over_threshold from orders group by 1")
def error_rate_daily(spark, folder):
    jobs = table(spark, folder, "orders").select(F.to_date("o_orderdate").cast("string").alias("day"), (F.col("o_orderstatus") == "F").alias("failed"))
    return M.error_rate(jobs, "day").withColumn("over_threshold", F.col("error_rate") > 0.1)


@query("failure_streaks", """
with m as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) as g from events),
s as (select *, case when event_type = 'error' then count(*) filter (where event_type = 'error') over (partition by user_id, g order by ts, event_id) else 0 end as streak from m)
select user_id, max(streak) as longest, count(*) filter (where streak = 3) as alerts from s group by user_id""")
def failure_streaks(spark, folder):
    """Longest run of failures by source, and how often a run reached three."""
    marked = M.runs(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return marked.groupBy("user_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("alerts"))


@query("low_yield_runs", """
with p as (select l_orderkey as source_id, l_linenumber as page, l_quantity::bigint as items from lineitem),
m as (select *, sum(case when items < 10 then 0 else 1 end) over (partition by source_id order by page) as g from p),
s as (select *, case when items < 10 then count(*) filter (where items < 10) over (partition by source_id, g order by page) else 0 end as streak from m),
a as (select source_id, count(*) as pages, sum(items)::bigint as items, max(streak) as longest_low_run from s group by source_id)
select *, round(items / pages, 4) as avg_items, case when longest_low_run >= 3 then 'critical' when items / pages < 10 then 'warning' else 'healthy' end as status from a""")
def low_yield_runs(spark, folder):
    pages = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").cast("bigint").alias("items"))
    return M.yield_summary(M.runs(pages, ["source_id"], ["page"], F.col("items") < 10), "source_id", 10)


_FOLD = """
with recursive o as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as n, {value} as v from events),
f as (select user_id, k, n, {first} as ema from o where k = 1
      union all select o.user_id, o.k, o.n, {alpha}::double * o.v + {rest}::double * f.ema from f join o on o.user_id = f.user_id and o.k = f.k + 1)
select user_id, n, round(ema, 6) as ema from f where k = n"""


@query("ema_latency", _FOLD.format(value="value", first="v", alpha=0.2, rest=0.8))
def ema_latency(spark, folder):
    found = M.moving_average(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "value", 0.2)
    return found.select("user_id", F.col("n").cast("bigint").alias("n"), F.round("ema", 6).alias("ema"))


@query("ema_success", _FOLD.format(value="case when event_type = 'error' then 0.0 else 1.0 end::double", first="0.3::double * v + 0.7::double", alpha=0.3, rest=0.7))
def ema_success(spark, folder):
    events = table(spark, folder, "events").withColumn("ok", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    found = M.moving_average(events, "user_id", ["ts", "event_id"], "ok", 0.3, 1.0)
    return found.select("user_id", F.col("n").cast("bigint").alias("n"), F.round("ema", 6).alias("ema"))


@query("rate_hourly", "select event_type as api, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') as hour, count(*) as requests, count(*) > 3 as over_limit from events group by 1, 2")
def rate_hourly(spark, folder):
    counted = table(spark, folder, "events").groupBy(F.col("event_type").alias("api"), F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("api", F.date_format("w.start", "yyyy-MM-dd HH:00").alias("hour"), "requests", (F.col("requests") > 3).alias("over_limit"))


@query("quota_stats", """
with l(api, quota) as (values ('click', 5000), ('error', 0), ('view', 100), ('imaginary', 10)),
u as (select event_type as api, strftime(ts, '%Y-%m') as month, count(*) as used from events group by 1, 2)
select l.api, month, coalesce(used, 0) as used, greatest(quota - coalesce(used, 0), 0) as remaining, case when quota = 0 then 100.0 else round(coalesce(used, 0) / quota * 100, 2) end::double as percent from l left join u using (api)""")
def quota_stats(spark, folder):
    limits = spark.createDataFrame([("click", 5000), ("error", 0), ("view", 100), ("imaginary", 10)], "api string, quota bigint")
    usage = table(spark, folder, "events").groupBy(F.col("event_type").alias("api"), F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("used"))
    return M.quota(usage, limits)


@query("backoff", """
with o as (select o_orderkey, o_orderdate, case o_orderkey % 4 when 0 then 'daily' when 1 then 'weekly' when 2 then 'monthly' else 'on_demand' end as schedule, o_custkey % 5 as errors,
  case when o_orderkey % 11 = 0 then o_orderdate + interval 20 days end as paused from orders),
d as (select *, case schedule when 'daily' then 1 when 'weekly' then 7 when 'monthly' then 30 end as days from o),
w as (select *, case when days is not null and errors > 0 then least(days * pow(2, errors), 7) else days end as wait from d),
n as (select *, o_orderdate + to_days(wait::int) as due from w)
select o_orderkey, case when paused > due then paused else due end as next_run from n""")
def backoff(spark, folder):
    orders = table(spark, folder, "orders")
    schedule = F.when(F.col("o_orderkey") % 4 == 0, "daily").when(F.col("o_orderkey") % 4 == 1, "weekly").when(F.col("o_orderkey") % 4 == 2, "monthly").otherwise("on_demand")
    paused = F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderdate") + F.expr("interval 20 days"))
    return orders.select("o_orderkey", M.next_run(schedule, F.col("o_orderdate"), F.col("o_custkey") % 5, paused).alias("next_run"))


@query("due_schedules", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'P' or o_orderdate <= timestamp '1996-01-01' order by o_orderpriority, o_orderdate, o_orderkey limit 50")
def due_schedules(spark, folder):
    """Never run or due: null in the due column counts as due, and sorts first."""
    orders = table(spark, folder, "orders").withColumn("next_run", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    due = orders.filter(F.col("next_run").isNull() | (F.col("next_run") <= F.lit("1996-01-01").cast("timestamp")))
    return due.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@query("in_season", """
with t as (select p_partkey, case when p_partkey % 7 = 0 then null else p_size % 12 + 1 end as a, case when p_partkey % 5 = 0 then null else p_partkey % 12 + 1 end as b from part)
select p_partkey, case when a is null or b is null then true when a <= b then 11 between a and b else 11 >= a or 11 <= b end as in_season from t""")
def in_season(spark, folder):
    a = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 12 + 1)
    b = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 12 + 1)
    return table(spark, folder, "part").select("p_partkey", M.in_season(F.lit(11), a, b).alias("in_season"))


@query("child_counts", """
with l as (select l_partkey as k, count(*) as line_count from lineitem group by 1), r as (select l_partkey as k, count(*) as return_count from lineitem where l_returnflag = 'R' group by 1)
select p_partkey, coalesce(line_count, 0) as line_count, coalesce(return_count, 0) as return_count from part left join l on l.k = p_partkey left join r on r.k = p_partkey""")
def child_counts(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return M.child_counts(table(spark, folder, "part").select("p_partkey"), "p_partkey", line_count=lines, return_count=lines.filter("l_returnflag = 'R'"))


@query("skeleton_stats", "select p_brand, count(distinct l_partkey) as products, count(*) as awards from lineitem join part on l_partkey = p_partkey group by 1 order by 2 desc, 1")
def skeleton_stats(spark, folder):
    joined = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.countDistinct("l_partkey").alias("products"), F.count("*").alias("awards")).orderBy(F.desc("products"), "p_brand")


@query("skeletons_by_comp_year", """
select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R') and exists (select 1 from lineitem where l_partkey = p_partkey and year(l_shipdate) = 1998)""")
def skeletons_by_comp_year(spark, folder):
    """Two independent existence tests: the rows that satisfy them may differ."""
    lines = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey")
    return parts.join(lines.filter("l_returnflag = 'R'"), "p_partkey", "left_semi").join(lines.filter(F.year("l_shipdate") == 1998), "p_partkey", "left_semi")


@query("products_without_details", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 49)")
def products_without_details(spark, folder):
    lines = table(spark, folder, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, folder, "part").select("p_partkey").join(lines, "p_partkey", "left_anti")


@query("content_changed", "select event_id, event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) as content_changed from events")
def content_changed(spark, folder):
    return M.changed(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "content_changed")


@query("source_health", """
with l as (select user_id, arg_max(event_type, (ts, event_id)) as last_event from events group by user_id),
s as (select r_regionkey as user_id, r_name from region union all select 100000, 'never seen')
select s.user_id, coalesce(last_event, 'unknown') as last_event, coalesce(last_event = 'error', false) as unhealthy, bool_or(coalesce(last_event = 'error', false)) over () as degraded from s left join l using (user_id)""")
def source_health(spark, folder):
    """The latest check of each listed source, and whether any is unhealthy."""
    last = table(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
    listed = table(spark, folder, "region").select(F.col("r_regionkey").cast("bigint").alias("user_id")).unionByName(spark.range(100_000, 100_001).withColumnRenamed("id", "user_id"))
    joined = listed.join(last, "user_id", "left").select("user_id", F.coalesce("last_event", F.lit("unknown")).alias("last_event"))
    joined = joined.withColumn("unhealthy", F.col("last_event") == "error")
    return joined.crossJoin(joined.agg(F.bool_or("unhealthy").alias("degraded")))  # one row on the right


def _checked(spark, folder):
    day = lambda n: F.expr(f"timestamp '1998-09-01' - make_dt_interval(cast({n} as int), 5)")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 9 != 0, day("p_partkey % 40")).alias("price_at"),
        F.when(F.col("p_partkey") % 8 != 0, day("p_size % 25")).alias("availability_at"),
        F.when(F.col("p_partkey") % 10 != 0, day("(p_partkey * 3) % 400")).alias("enriched_at"),
    )


_CHECKED_SQL = """
p as (select p_partkey as product_id, case when p_partkey % 9 <> 0 then p_partkey % 40 end as pd, case when p_partkey % 8 <> 0 then p_size % 25 end as ad, case when p_partkey % 10 <> 0 then (p_partkey * 3) % 400 end as ed from part),
q as (select product_id, pd, ad, ed,
  case when pd is null then 100 else floor(greatest(0, 100 - pd * 3)) end as s1, case when ad is null then 100 else floor(greatest(0, 100 - ad * 5)) end as s2,
  case when ed is null then 100 else floor(greatest(0, 100 - ed * 1)) end as s3, case when ed is null then 100 else floor(greatest(0, 100 - ed * 0.3::double)) end as s4 from p),
z as (select product_id, greatest(1, least(100, floor(0::double + s1 * 0.35::double + s2 * 0.25::double + s3 * 0.20::double + s4 * 0.10::double + s4 * 0.10::double)))::int as score from q)"""


@query("freshness", f"with {_CHECKED_SQL} select product_id, score, score < 50 as needs_refresh from z")
def freshness(spark, folder):
    score = R.freshness_score(F.col("price_at"), F.col("availability_at"), F.col("enriched_at"), "1998-09-01")
    return _checked(spark, folder).select("product_id", score.alias("score")).withColumn("needs_refresh", F.col("score") < R.REFRESH_BELOW)


@query("refresh_topk", f"with {_CHECKED_SQL} select product_id, score from z order by score, product_id limit 25")
def refresh_topk(spark, folder):
    return R.most_in_need(freshness(spark, folder).select("product_id", "score"), 25)


@query("freshness_level", f"""with {_CHECKED_SQL} select product_id, case when pd is null then 'critical' when pd < 7 then 'fresh' when pd < 30 then 'stale' else 'critical' end as price_level,
case when ed is null then 'critical' when ed < 180 then 'fresh' when ed < 365 then 'stale' else 'critical' end as other_level from p""")
def freshness_level(spark, folder):
    return _checked(spark, folder).select("product_id", R.freshness_level(F.lit("price"), F.col("price_at"), "1998-09-01").alias("price_level"), R.freshness_level(F.lit("unheard of"), F.col("enriched_at"), "1998-09-01").alias("other_level"))
