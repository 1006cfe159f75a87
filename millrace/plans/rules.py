"""Queries for the smaller rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import classify as C
from millrace.operators import rules as R
from millrace.plans.classify import links
from millrace.plans.texts import listed, listed_sql
from millrace.registry import ORACLE_SQL, query
from millrace.sources.tables import FIELD_SOURCES_SQL, field_sources, table


@query("links_by_type", f"select link_type, count(*) as links, count(distinct page_id) as pages from ({ORACLE_SQL['links']}) group by 1")
def links_by_type(spark, folder):
    return links(spark, folder).groupBy("link_type").agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


@query("producer_boost", f"with {FIELD_SOURCES_SQL} select product_id, source_id, field_name, round(least(confidence + 0.1, 0.95), 4)::double as confidence from f")
def producer_boost(spark, folder):
    return field_sources(spark, folder).select("product_id", "source_id", "field_name", F.round(R.boosted(F.col("confidence")), 4).alias("confidence"))


@query("missing_fields", "select p_partkey, concat_ws(',', case when p_partkey % 3 = 0 then 'name' end, case when p_size <= 10 then 'size' end, case when p_type is null then 'type' end) as missing from part")
def missing_fields(spark, folder):
    fields = {"name": F.col("p_partkey") % 3 != 0, "size": F.col("p_size") > 10, "type": F.col("p_type").isNotNull()}
    return table(spark, folder, "part").select("p_partkey", F.array_join(R.missing(fields), ",").alias("missing"))


VALUES = ["Gold", " SILVER ", "wood", "", None, "bronze"]


@query("enum_validate", f"with {listed_sql(VALUES)} select k, case when lower(trim(s)) in ('gold', 'silver', 'bronze') then lower(trim(s)) end as value, case when lower(trim(s)) not in ('gold', 'silver', 'bronze') and lower(trim(s)) <> '' then 'invalid: ' || s end as warning from t")
def enum_validate(spark, folder):
    return listed(spark, VALUES).select("k", R.enum_value(F.col("s"), ("gold", "silver", "bronze")).alias("e")).select("k", "e.value", "e.warning")


@query("job_rates", "select o_custkey, count(*) filter (where o_orderstatus = 'O') as new, count(*) filter (where o_orderstatus = 'F') as failed, round(case when count(*) filter (where o_orderstatus in ('O', 'F')) > 0 then count(*) filter (where o_orderstatus = 'O') / count(*) filter (where o_orderstatus in ('O', 'F')) else 0 end, 6)::double as success_rate from orders group by 1")
def job_rates(spark, folder):
    found = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("new"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))
    return found.withColumn("success_rate", F.round(R.success_rate(F.col("new"), F.col("failed")), 6))


@query("selector_health", "select user_id, count(*) as checks, count(*) filter (where event_type = 'error') as failed, count(*) filter (where event_type <> 'error') > count(*) * 0.5 as healthy, case when count(*) filter (where event_type = 'error') > 1 then 'critical' when count(*) filter (where event_type = 'error') = 1 then 'warning' else 'ok' end as severity from events group by 1")
def selector_health(spark, folder):
    """A source is healthy if over half of its selectors are; alerts go by the number that fail."""
    found = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("checks"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return found.select("user_id", "checks", "failed", ((F.col("checks") - F.col("failed")) > F.col("checks") * 0.5).alias("healthy"), R.severity(F.col("failed"), F.col("checks")).alias("severity"))


@query("unique_slugs", "with s as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part), k as (select *, row_number() over (partition by slug order by p_partkey) as n from s) select p_partkey, case when n = 1 then slug else slug || '-' || (n - 1) end as unique_slug from k")
def unique_slugs(spark, folder):
    slugs = table(spark, folder, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))
    return R.unique_slugs(slugs, "slug", ["p_partkey"]).select("p_partkey", "unique_slug")


@query("source_tracking", "select l_orderkey, array_to_string(list(distinct l_suppkey order by l_suppkey), ',') as sources, array_to_string(list(l_partkey order by l_partkey) filter (where l_returnflag = 'R'), ',') as rejected, max(l_linenumber)::int as steps from lineitem group by 1")
def source_tracking(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).alias("rejected"), F.col("l_linenumber").alias("steps"))
    found = R.tracked(rows, "l_orderkey")
    return found.select("l_orderkey", F.array_join("sources", ",").alias("sources"), F.when(F.size("rejected") > 0, F.array_join("rejected", ",")).alias("rejected"), F.col("steps").cast("int").alias("steps"))


@query("tracking_merge", """with l as (select o_orderkey as k, o_custkey % 5 as a, o_custkey % 7 as b, o_orderkey % 4 as s, o_orderkey % 6 as t from orders)
select k, array_to_string(list_sort(list_distinct(['s' || a, 's' || b, 'x'])), ',') as sources, case when s = 0 then 'r' || b else 'r' || a || ',r' || b end as rejected, 'name=new' || b || case when a <> b then ';' || 'f' || a || '=old' else '' end || ';f' || b || '=n' as provenance, greatest(case when s = 0 then 0 else s end, t)::int as steps from l""")
def tracking_merge(spark, folder):
    """What a second run's source tracking does to a record's."""
    k = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), *(x.cast("string").alias(n) for n, x in (("a", F.col("o_custkey") % 5), ("b", F.col("o_custkey") % 7))), (F.col("o_orderkey") % 4).alias("s"), (F.col("o_orderkey") % 6).alias("t"))
    tag = lambda p, c: F.concat(F.lit(p), F.col(c))
    old = {"sources": F.array(tag("s", "a"), F.lit("x")), "rejected": F.when(F.col("s") != 0, F.array(tag("r", "a"))), "provenance": F.create_map(F.lit("name"), F.lit("old"), tag("f", "a"), F.lit("old")), "steps": F.when(F.col("s") != 0, F.col("s")), "at": F.lit(1)}
    new = {"sources": F.array(tag("s", "b"), F.lit("x")), "rejected": F.array(tag("r", "b")), "provenance": F.create_map(F.lit("name"), tag("new", "b"), tag("f", "b"), F.lit("n")), "steps": F.col("t"), "at": F.lit(2)}
    m = R.tracking_merged(old, new)
    of = lambda key: F.concat(key, F.lit("="), F.try_element_at(m["provenance"], key))
    parts = F.concat_ws(";", of(F.lit("name")), F.when(F.col("a") != F.col("b"), of(tag("f", "a"))), of(tag("f", "b")))
    return k.select("k", F.array_join(m["sources"], ",").alias("sources"), F.array_join(m["rejected"], ",").alias("rejected"), parts.alias("provenance"), m["steps"].cast("int").alias("steps"))


@query("job_durations", "select o_orderkey, case when o_orderkey % 3 > 0 then (o_orderkey % 1000) * 7 else epoch(timestamp '1999-01-01')::bigint - epoch(o_orderdate)::bigint end as seconds from orders")
def job_durations(spark, folder):
    done = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 1000 * 7).cast("decimal(18,6)")))
    return table(spark, folder, "orders").select("o_orderkey", R.duration_seconds(F.col("o_orderdate"), done, F.lit("1999-01-01").cast("timestamp")).alias("seconds"))


@query("budget", "with s as (select l_orderkey, l_linenumber, l_partkey, sum(case when l_returnflag = 'R' then 0 else l_quantity::bigint end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between unbounded preceding and current row)::bigint as spent from lineitem) select l_orderkey, count(*) as paid, max(spent)::bigint as spent from s where spent <= 60 group by 1")
def budget(spark, folder):
    """Searches that a budget pays for, refunded ones at no cost."""
    rows = table(spark, folder, "lineitem").withColumn("cost", F.col("l_quantity").cast("bigint")).withColumn("refund", F.col("l_returnflag") == "R")
    paid = R.within_budget(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "cost", 60)
    return paid.groupBy("l_orderkey").agg(F.count("*").alias("paid"), F.max("spent").alias("spent"))


@query("recent_enrichment", "select o_orderkey, o_orderdate > timestamp '1998-08-02' - interval 90 days as skip from orders")
def recent_enrichment(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", R.recently(F.col("o_orderdate"), "1998-08-02", 90).alias("skip"))


TERMS = ["iwsc:2024", "sfwsc", "wwa:", "x:y", "dwwa:2020:z"]


@query("competition_terms", f"with {listed_sql(TERMS)} select k, split_part(s, ':', 1) as key, coalesce(try_cast(split_part(s, ':', 2) as int), 2025) as year from t")
def competition_terms(spark, folder):
    return listed(spark, TERMS).select("k", R.term_parts(F.col("s"), 2025).alias("p")).select("k", "p.key", "p.year")


IMAGES = ["Bottle front", "label detail", "lifestyle shot", "Packaging box", "other", None]


@query("image_type", f"with {listed_sql(IMAGES)} select k, case when contains(lower(coalesce(s, '')), 'bottle') then 'bottle' when contains(lower(coalesce(s, '')), 'label') then 'label' when contains(lower(coalesce(s, '')), 'pack') then 'packaging' when contains(lower(coalesce(s, '')), 'box') then 'packaging' when contains(lower(coalesce(s, '')), 'lifestyle') then 'lifestyle' else 'unknown' end as kind from t")
def image_type(spark, folder):
    return listed(spark, IMAGES).select("k", C.first_word(F.col("s"), [("bottle", "bottle"), ("label", "label"), ("pack", "packaging"), ("box", "packaging"), ("lifestyle", "lifestyle")], "unknown").alias("kind"))


@query("cost_rollup", "select event_type as service, ts::date::varchar as day, count(*) as request_count, grouping(event_type, ts::date)::int as level from events group by grouping sets ((event_type, ts::date), (event_type), ())")
def cost_rollup(spark, folder):
    """An extension: cost levels in one pass by grouping sets."""
    rows = table(spark, folder, "events").select(F.col("event_type").alias("service"), F.to_date("ts").cast("string").alias("day"))
    return rows.rollup("service", "day").agg(F.count("*").alias("request_count"), F.grouping_id().cast("int").alias("level"))


@query("should_enrich", "select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false else true end as v3 from orders")
def should_enrich(spark, folder):
    status = F.when(F.col("o_orderstatus") == "F", "skeleton").when(F.col("o_orderstatus") == "O", "complete").otherwise("baseline")
    return table(spark, folder, "orders").select("o_orderkey", R.should_enrich(status).alias("v3"))


@query("learned_timeout", "select event_id, least(case when event_id % 9 >= 5 then greatest(trunc(value * 30 * 3)::int, 10000) else 20000 end * pow(2, event_id % 4), 60000)::int as timeout_ms from events")
def learned_timeout(spark, folder):
    """A domain's timeout by its average response, doubled with each attempt."""
    from millrace.operators.monitoring import learned_timeout as learned

    return table(spark, folder, "events").select("event_id", learned(F.col("value") * 30, F.col("event_id") % 9, F.col("event_id") % 4).alias("timeout_ms"))


@query("populated_fields", "select p_partkey, trim(case p_partkey % 3 when 0 then ' ' when 1 then p_name end) <> '' and p_partkey % 3 = 1 as text, p_partkey % 4 > 0 as number, p_partkey % 5 > 1 as list from part")
def populated_fields(spark, folder):
    """Which fields count as filled: 0 does, blanks and empty lists don't."""
    from millrace.functions.texts import populated

    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("p_name"))
    listed = F.when(k % 5 == 1, F.array().cast("array<string>")).when(k % 5 > 1, F.split("p_name", " "))
    return table(spark, folder, "part").select("p_partkey", populated(text, "string").alias("text"), populated(F.when(k % 4 > 0, F.lit(0)), "number").alias("number"), populated(listed, "array").alias("list"))
