"""Merge, provenance and conflict queries over what suppliers say of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import merging as M
from millrace.registry import query
from millrace.sources.tables import FIELD_SOURCES_SQL, field_sources, table

FILLED = "trim(extracted_value) <> ''"


@query("field_provenance", f"""with {FIELD_SOURCES_SQL}, r as (select *, row_number() over (partition by product_id, field_name order by confidence desc, source_id) as k from f)
select product_id, field_name, count(*) as source_count, count(distinct extracted_value) > 1 as has_conflict, max(confidence) as top_confidence, max(extracted_value) filter (where k = 1) as top_value from r group by 1, 2""")
def field_provenance(spark, folder):
    return M.provenance(field_sources(spark, folder))


@query("majority_merge", f"""with {FIELD_SOURCES_SQL}, v as (select product_id, field_name, extracted_value as value, count(*) as votes, min(source_id) as s from f where {FILLED} group by 1, 2, 3),
r as (select *, row_number() over (partition by product_id, field_name order by votes desc, s) as k, count(*) over (partition by product_id, field_name) as n from v)
select product_id, field_name, value, votes, n > 1 as has_conflict from r where k = 1""")
def majority_merge(spark, folder):
    return M.majority(field_sources(spark, folder))


@query("verified_fields", f"""with {FIELD_SOURCES_SQL}, v as (select product_id, field_name, extracted_value from f where {FILLED} group by 1, 2, 3 having count(*) >= 2)
select product_id, array_to_string(list_sort(list(distinct field_name)), ',') as fields from v group by 1""")
def verified_fields(spark, folder):
    return M.verified_fields(field_sources(spark, folder)).withColumn("fields", F.array_join("fields", ","))


NORMAL = "case when field_name in ('name', 'brand', 'region', 'country') then lower(trim(coalesce(extracted_value, ''))) else trim(coalesce(extracted_value, '')) end"
CONFLICTS = f"select product_id, field_name, count(*) as source_count, count(distinct nullif({NORMAL}, '')) as value_count from f group by 1, 2 having count(*) >= 2 and count(distinct nullif({NORMAL}, '')) > 1"


@query("conflicts", f"with {FIELD_SOURCES_SQL} {CONFLICTS}")
def conflicts(spark, folder):
    return M.conflicts(field_sources(spark, folder))


@query("confident_conflicts", f"with {FIELD_SOURCES_SQL} select product_id, field_name from f group by 1, 2 having count(distinct extracted_value) > 1 and max(confidence) >= 0.95")
def confident_conflicts(spark, folder):
    """Fields of which sources say different things, one of them at least surely."""
    return M.confident_conflicts(field_sources(spark, folder), 0.95)


@query("auto_resolve", f"""with {FIELD_SOURCES_SQL}, c as ({CONFLICTS}), r as (select *, row_number() over (partition by product_id, field_name order by confidence desc, source_id) as k from f),
t as (select product_id, field_name, max(confidence) filter (where k = 1) as a, max(confidence) filter (where k = 2) as b, max(extracted_value) filter (where k = 1) as v from r group by 1, 2)
select product_id, field_name, v as resolved_value from c join t using (product_id, field_name) where round(a - b, 6) >= 0.03""")
def auto_resolve(spark, folder):
    return M.auto_resolved(field_sources(spark, folder), 0.03)


MERGE = f"select product_id, field_name, extracted_value as value, confidence, source_id from (select *, row_number() over (partition by product_id, field_name order by confidence desc, source_id) as k from f where {FILLED}) where k = 1"


@query("confidence_merge", f"with {FIELD_SOURCES_SQL} {MERGE}")
def confidence_merge(spark, folder):
    return M.confidence_merge(field_sources(spark, folder))


@query("refresh_merge", f"""with {FIELD_SOURCES_SQL}, m as ({MERGE}), i as (select product_id, field_name, extracted_value as value, confidence, source_id from (select *, row_number() over (partition by product_id, field_name order by source_id) as k from f where {FILLED}) where k = 1)
select * from m where field_name <> 'name' union all select * from i where field_name = 'name'""")
def refresh_merge(spark, folder):
    return M.refresh_merge(field_sources(spark, folder), ["name"])


@query("first_wins_merge", f"""with {FIELD_SOURCES_SQL}, r as (select *, row_number() over (partition by product_id, field_name order by source_id) as k from f where {FILLED})
select product_id, field_name, max(extracted_value) filter (where k = 1) as value, count(distinct lower(trim(extracted_value))) > 1 as has_conflict from r group by 1, 2""")
def first_wins_merge(spark, folder):
    return M.first_wins(field_sources(spark, folder))


@query("verify_merge", f"""with {FIELD_SOURCES_SQL}, p as (select p_partkey as product_id, p_name as name, case when p_partkey % 6 = 0 then '' else p_type end as type, p_size::varchar as size from part),
j as (select product_id, source_id, field_name, extracted_value as b, case field_name when 'name' then name when 'type' then type else size end as a from f join p using (product_id)),
o as (select field_name, case when not coalesce(trim(b) <> '', false) then 'none' when not coalesce(trim(a) <> '', false) then 'set'
  when case when try_cast(trim(a) as decimal(20,6)) is not null and try_cast(trim(b) as decimal(20,6)) is not null then try_cast(trim(a) as decimal(20,6)) = try_cast(trim(b) as decimal(20,6)) else lower(trim(a)) = lower(trim(b)) end then 'verified' else 'conflict' end as outcome from j)
select field_name, outcome, count(*) as n from o group by 1, 2""")
def verify_merge(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.col("p_type")).alias("type"), F.col("p_size").cast("string").alias("size"))
    known = parts.unpivot(["product_id"], ["name", "type", "size"], "field_name", "existing")
    rows = field_sources(spark, folder).join(known, ["product_id", "field_name"])
    outcome = M.verify_merge(F.col("existing"), F.col("extracted_value"))
    return rows.groupBy("field_name", outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("provenance_unpivot", "with p as (select p_partkey, p_name, p_brand, case when p_size > 25 then p_size::varchar end as p_size from part) select * from (unpivot p on p_name, p_brand, p_size into name field_name value extracted_value)")
def provenance_unpivot(spark, folder):
    """Each filled field of a wide record as a row of its own."""
    wide = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("p_size"))
    return wide.unpivot(["p_partkey"], ["p_name", "p_brand", "p_size"], "field_name", "extracted_value").filter("extracted_value is not null")


@query("array_merge_ci", """with a as (select l_partkey, list(v order by l_orderkey, l_linenumber) as vs from (select *, case l_linenumber % 3 when 0 then upper(l_returnflag) when 1 then ' ' || lower(l_returnflag) else l_linestatus end as v from lineitem) group by 1)
select l_partkey, array_to_string(list_filter(vs, lambda v, i: list_position([lower(trim(x)) for x in vs], lower(trim(v))) = i), '|') as merged from a""")
def array_merge_ci(spark, folder):
    lines = table(spark, folder, "lineitem")
    value = F.when(F.col("l_linenumber") % 3 == 0, F.upper("l_returnflag")).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit(" "), F.lower("l_returnflag"))).otherwise(F.col("l_linestatus"))
    # Null keys come last, as in the SQL; of lines with equal keys, whose order it leaves open, the smaller value is first.
    keys = [c for k in ("l_orderkey", "l_linenumber") for c in (F.col(k).isNull().alias(f"no_{k}"), F.col(k))]
    lists = lines.groupBy("l_partkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda s: s["v"]).alias("vs"))
    merged = M.merged_list(F.col("vs"))
    return lists.select("l_partkey", F.when(F.size(merged) > 0, F.array_join(merged, "|")).alias("merged"))


@query("ecp", f"""with {FIELD_SOURCES_SQL}, g(group_key, field_name) as (values ('identity', 'name'), ('identity', 'type'), ('identity', 'brand'), ('measures', 'size'), ('measures', 'abv')),
sz as (select group_key, count(*) as total from g group by 1), d as (select distinct product_id, field_name from f where {FILLED}), h as (select product_id, group_key, count(*) as populated from d join g using (field_name) group by 1, 2),
b as (select p.product_id, sz.group_key, sz.total, coalesce(populated, 0) as populated from (select distinct product_id from f) p cross join sz left join h using (product_id, group_key)),
u as (select * from b union all select product_id, 'total', sum(total)::bigint, sum(populated)::bigint from b group by 1)
select *, round(populated / total * 100, 2) as percentage from u""")
def ecp(spark, folder):
    return M.coverage(field_sources(spark, folder), {"identity": ["name", "type", "brand"], "measures": ["size", "abv"]})
