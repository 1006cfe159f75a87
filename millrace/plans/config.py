"""Configuration, import and extraction queries: the driver tables written as JSON and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.kinds import pick, pick_sql
from millrace.registry import query
from millrace.sources import config as C
from millrace.sources.tables import table


@query("seed_config", """with o as (select p_partkey as id, p_name as name, p_size as size from part where p_partkey % 3 > 0), n as (select p_partkey as id, case when p_partkey % 2 = 0 then p_name else upper(p_name) end as name, p_size as size from part where p_partkey % 4 > 0)
select coalesce(o.id, n.id) as id, coalesce(n.name, o.name) as name, coalesce(n.size, o.size) as size, case when n.id is null then 'kept' when o.id is null then 'created' when n.name = o.name and n.size = o.size then 'unchanged' else 'updated' end as action from o full join n on o.id = n.id""")
def seed_config(spark, folder):
    """Rows of a JSON configuration put over those of a table, and what became of each."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    line = F.to_json(F.struct("id", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("name"), "size"))
    new = C.parsed(parts.filter("id % 4 > 0").select(F.col("id").alias("k"), line.alias("line")), "k", "line", "struct<id:bigint,name:string,size:int>")
    return C.upserted(parts.filter("id % 3 > 0"), new, ["id"], [F.col("k")])


KINDS = ["whiskey", "port_wine", "beer", "gin"]


@query("import_terms_json", f"""with a as (select p_partkey, p_brand || ' ' || p_partkey % 50 as q, {pick_sql(KINDS)} as t, p_size as priority from part), x as (select *, case when p_partkey % 17 = 0 then ' ' else q end as query from a), o as (select distinct p_brand || ' ' || p_partkey % 50 as query, 'whiskey' as t from part where p_size > 40)
select p_partkey, x.query, x.t as product_type, priority, case when trim(x.query) = '' or x.t not in ('whiskey', 'port_wine', 'gin') then 'skipped' when o.query is not null then 'updated' else 'created' end as action from x left join o on o.query = x.query and o.t = x.t""")
def import_terms_json(spark, folder):
    """Search terms in JSON: skipped, updated or created by (query, kind)."""
    parts = table(spark, folder, "part")
    said = F.concat("p_brand", F.lit(" "), F.col("p_partkey") % 50)
    term = F.struct(F.when(F.col("p_partkey") % 17 == 0, " ").otherwise(said).alias("query"), pick(KINDS).alias("product_type"), F.col("p_size").alias("priority"))
    known = parts.filter("p_size > 40").select(said.alias("query"), F.lit("whiskey").alias("product_type"))
    return C.import_terms(parts.select("p_partkey", F.to_json(term).alias("line")), "p_partkey", "line", known, ["whiskey", "port_wine", "gin"]).select("p_partkey", "query", "product_type", "priority", "action")


GROUPS, TYPES = ["identity", "tasting", "origin"], ["text", "number", "list"]


@query("field_schema", f"""with f as (select 'f' || p_partkey as name, case when p_partkey % 6 > 0 then p_brand end as kind, {pick_sql(TYPES, step=2)} as type, {pick_sql(GROUPS)} as grp, p_size as ord from part where p_partkey <= 300 and p_partkey % 10 > 0),
k as (select distinct kind from f where kind is not null), e as (select k.kind, f.name, f.type, f.grp, f.ord from k join f on f.kind is null or f.kind = k.kind)
select kind as product_type, '[' || string_agg('{{"name":"' || name || '","type":"' || type || '"}}', ',' order by grp, ord, name) || ']' as schema from e group by 1""")
def field_schema(spark, folder):
    """A registry of fields, as one schema for each kind: its own and the common ones, active ones only, in order."""
    fields = table(spark, folder, "part").filter("p_partkey <= 300").select(
        F.concat(F.lit("f"), "p_partkey").alias("field_name"), F.when(F.col("p_partkey") % 6 > 0, F.col("p_brand")).alias("product_type"), pick(TYPES, step=2).alias("field_type"),
        pick(GROUPS).alias("field_group"), F.col("p_size").alias("sort_order"), (F.col("p_partkey") % 10 > 0).alias("is_active"),
    )
    return C.field_schemas(fields)


MEDALS = ["Gold ", "wood", "SILVER"]


@query("extraction_rows", f"""with a as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as pos, l_partkey, {pick_sql(MEDALS, 'l_partkey')} as medal, case when l_linenumber % 2 = 0 then 0.8 else 0 end as conf, case when l_partkey % 3 > 0 then 'brand ' || l_suppkey end as brand from lineitem)
select l_orderkey, pos::int as pos, 'part ' || l_partkey as name, case when lower(trim(medal)) in ('gold', 'silver') then lower(trim(medal)) end as medal, case when conf > 0 then conf else round(0.5 + 0.4 * (brand is not null)::int / 3, 2) end::double as confidence from a""")
def extraction_rows(spark, folder):
    """Products of extraction answers in JSON: enumerated values checked, missing confidences worked out."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    name = lambda s: F.concat(F.lit("part "), s["l_partkey"])
    medal = lambda s: F.element_at(F.array(*map(F.lit, MEDALS)), (s["l_partkey"] % 3 + 1).cast("int"))
    brand = lambda s: F.when(s["l_partkey"] % 3 > 0, F.concat(F.lit("brand "), s["l_suppkey"]))
    product = lambda s: F.struct(F.struct(name(s).alias("name"), medal(s).alias("medal"), brand(s).alias("brand")).alias("product_data"), F.when(s["l_linenumber"] % 2 == 0, 0.8).otherwise(0.0).alias("confidence"))
    answers = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    answers = answers.select("l_orderkey", F.to_json(F.struct(F.transform("lines", product).alias("products"))).alias("answer"))
    rows = C.extracted(answers, "l_orderkey", "answer", {"medal": ("gold", "silver", "bronze")})
    return rows.select("l_orderkey", "pos", F.col("data")["name"].alias("name"), F.try_element_at("data", F.lit("medal")).alias("medal"), "confidence")


@query("cost_events", "select event_type as service, (count(*) * case event_type when 'click' then 2 when 'view' then 1 else 0 end)::bigint as cost_cents, count(*) as request_count, user_id as crawl_job_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as timestamp from events group by event_type, user_id")
def cost_events(spark, folder):
    """What a job's requests of each service cost, as the rows that are appended to the log."""
    requests = table(spark, folder, "events").groupBy(F.col("event_type").alias("service"), F.col("user_id").alias("job_id")).agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    found = C.costs(requests, {"click": 2, "view": 1})
    return found.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("partial_update", "select p.p_partkey, p.p_name, p.p_brand, coalesce(l.size, p.p_size) as p_size, case when l.l_partkey is null then p.p_retailprice else l.price end as p_retailprice from part p left join (select l_partkey, max(l_linenumber)::int as size, max(case when l_linenumber > 3 then l_extendedprice end) as price from lineitem where l_partkey % 2 = 0 group by 1) l on l.l_partkey = p.p_partkey")
def partial_update(spark, folder):
    """Two of a record's columns written, the others as they are; a written null is a null."""
    lines = table(spark, folder, "lineitem").filter("l_partkey % 2 = 0").groupBy(F.col("l_partkey").alias("p_partkey"))
    new = lines.agg(F.max("l_linenumber").cast("int").alias("p_size"), F.max(F.when(F.col("l_linenumber") > 3, F.col("l_extendedprice"))).alias("p_retailprice"))
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return C.update_columns(parts, new, ["p_partkey"], ["p_size", "p_retailprice"])
