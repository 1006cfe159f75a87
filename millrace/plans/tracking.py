"""Queries of sources, skeletons, schedules, awards and alerts over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.operators import rules as R
from millrace.operators import tracking as K
from millrace.operators.kinds import PORT_WORDS, WHISKEY_WORDS
from millrace.plans.kinds import AWARD_CATEGORIES, AWARD_NAMES, COMPETITIONS, any_sql, pick, pick_sql, quoted
from millrace.registry import query
from millrace.sources.tables import table

HOSTS = ["facebook.com", "shop.example.com", "m.youtube.com", "whisky.com", "nytimes.com.example"]


@query("product_url", f"with a as (select page_id, {pick_sql(HOSTS, 'page_id')} as d from pages) select page_id, not {any_sql('d', K.SKIPPED_HOSTS)} as product from a")
def product_url(spark, folder):
    return table(spark, folder, "pages").select("page_id", K.is_product_url(U.host(F.concat(F.lit("https://www."), pick(HOSTS, "page_id"), F.lit("/x")))).alias("product"))


@query("needs_reorder", "select p_partkey, p_size from part where p_size <= p_partkey % 25")
def needs_reorder(spark, folder):
    return table(spark, folder, "part").filter(K.needs_reorder(F.col("p_size"), F.col("p_partkey") % 25)).select("p_partkey", "p_size")


@query("product_of_url", """with u as (select distinct url from pages), p as (select url, min(page_id * 10) as own from pages where page_id % 3 = 0 group by 1), l as (select page_id as s, min(l_partkey) as linked from pages join lineitem on l_suppkey = page_id group by 1),
c as (select url, min(page_id) as s from pages where page_id % 2 = 0 group by 1) select u.url, coalesce(own, linked) as product_id from u left join p on p.url = u.url left join c on c.url = u.url left join l on l.s = c.s""")
def product_of_url(spark, folder):
    """A URL's product: by its own address, else through the crawled source with that address."""
    pages = table(spark, folder, "pages")
    products = pages.filter("page_id % 3 = 0").select((F.col("page_id") * 10).alias("product_id"), F.col("url").alias("source_url"))
    sources = pages.filter("page_id % 2 = 0").select(F.col("page_id").alias("source_id"), "url")
    links = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("product_id"))
    return K.product_of_url(pages.select("url").distinct(), products, sources, links)


@query("source_reuse", "with g as (select url, arg_min(case when page_id % 5 = 0 then '' else html end, page_id) as content from pages where page_id % 4 in (0, 1) group by 1) select url, length(content) as chars from g where content <> ''")
def source_reuse(spark, folder):
    """URLs whose content can be used again: processed or under review, and not emptied."""
    pages = table(spark, folder, "pages")
    status = F.when(F.col("page_id") % 4 == 0, "processed").when(F.col("page_id") % 4 == 1, "needs_review").otherwise("failed")
    sources = pages.select(F.col("page_id").alias("source_id"), "url", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")).alias("content"), status.alias("status"))
    return K.reusable(pages.select("url").distinct(), sources).select("url", F.length("content").cast("bigint").alias("chars"))


@query("cleanup_rules", "select page_id, page_id % 2 = 0 as by_flag, page_id % 3 = 0 as by_archive, page_id % 3 = 0 and page_id % 4 > 0 as derived from pages")
def cleanup_rules(spark, folder):
    """Which sources' contents may go, by each of the three rules."""
    k = F.col("page_id")
    flag, archive, extraction = k % 2 == 0, F.when(k % 3 == 0, "saved").otherwise("pending"), F.when(k % 4 > 0, "processed").otherwise("failed")
    return table(spark, folder, "pages").select("page_id", *(K.cleanup_eligible(flag, archive, extraction, rule).alias(name) for rule, name in (("flag", "by_flag"), ("archive", "by_archive"), ("derived", "derived"))))


_KIND = f"case when {any_sql('x', PORT_WORDS)} then 'port_wine' when (x like '% port%' or x like 'port%' or lower(name) like '%port %') and not regexp_matches(x, 'brandy|cognac') then 'port_wine' when {any_sql('x', WHISKEY_WORDS)} then 'whiskey' end"


@query("skeleton_create", f"""with a as (select p_partkey as award_id, case when p_partkey % 23 = 0 then '' else {pick_sql(AWARD_NAMES)} || ' ' || p_partkey % 60 end as name, p_brand as producer, {pick_sql(AWARD_CATEGORIES, step=3)} as category, {pick_sql(COMPETITIONS, step=5)} as competition from part),
k as (select *, lower(name) || ' ' || lower(category) || ' ' || lower(competition) as x from a), v as (select *, {_KIND} as kind from k), w as (select *, name <> '' and kind is not null as valid from v),
p as (select award_id as product_id, upper(name) as name, case when award_id % 2 = 0 then sha256('{{"brand": "' || lower(producer) || '", "name": "' || lower(trim(name)) || '", "type": "skeleton"}}') else '' end as fp from a where award_id % 9 = 0),
j as (select w.award_id, any_value(w.kind) as kind, any_value(w.valid) as valid, any_value(lower(w.name)) as folded, min(p.product_id) as target from w left join p on lower(p.name) = lower(w.name) or p.fp = sha256('{{"brand": "' || lower(w.producer) || '", "name": "' || lower(trim(w.name)) || '", "type": "skeleton"}}') group by 1),
f as (select folded, min(award_id) as first from j where valid and target is null group by 1)
select award_id, kind, case when not valid then 'skipped' when target is not null or first <> award_id then 'added' else 'created' end as action, case when valid then target end as target, case when valid and target is null then first end as first from j left join f using (folded)""")
def skeleton_create(spark, folder):
    """What a batch of awards does: skeletons created, awards added to known products or to the batch's own, or skipped."""
    from millrace.functions.names import skeleton_fingerprint

    name = F.when(F.col("p_partkey") % 23 == 0, "").otherwise(F.concat(pick(AWARD_NAMES), F.lit(" "), F.col("p_partkey") % 60))
    awards = table(spark, folder, "part").select(F.col("p_partkey").alias("award_id"), name.alias("name"), F.col("p_brand").alias("producer"), pick(AWARD_CATEGORIES, step=3).alias("category"), pick(COMPETITIONS, step=5).alias("competition"))
    fp = F.when(F.col("award_id") % 2 == 0, skeleton_fingerprint(F.col("name"), F.col("producer"))).otherwise("")
    products = awards.filter("award_id % 9 = 0").select(F.col("award_id").alias("product_id"), F.upper("name").alias("name"), fp.alias("fingerprint"))
    return K.skeletons(awards, products)


@query("unenriched_skeletons", "select o_orderkey as product_id from orders where o_orderstatus = 'F' and o_orderkey % 3 > 0 order by o_orderdate, o_orderkey limit 50")
def unenriched_skeletons(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("product_id"), F.when(F.col("o_orderstatus") == "F", "skeleton").otherwise("pending").alias("status"), F.when(F.col("o_orderkey") % 3 > 0, "").otherwise("u").alias("source_url"), F.col("o_orderdate").alias("discovered_at"))
    return K.unenriched(rows, 50).select("product_id")


@query("search_terms", "select p_partkey as term_id, p_size as priority from part where p_partkey % 3 > 0 and p_brand in ('Brand#11', 'Brand#12', 'Brand#23') order by p_size desc, p_partkey limit 20")
def search_terms(spark, folder):
    """The twenty most important active search terms of some kinds."""
    terms = table(spark, folder, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_brand").alias("product_type"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 3 > 0).alias("is_active"))
    return K.active_terms(terms, ["Brand#11", "Brand#12", "Brand#23"]).select("term_id", "priority")


FREQUENCIES = [*K.FREQUENCY_HOURS, "never heard of"]


@query("next_runs", f"with a as (select o_orderkey, {pick_sql(FREQUENCIES, 'o_orderkey')} as f, case when o_orderkey % 7 > 0 then o_orderdate end as last from orders) select o_orderkey, strftime(coalesce(last, timestamp '2024-05-01') + to_hours(case f {' '.join(f'when {quoted(k)} then {v}' for k, v in K.FREQUENCY_HOURS.items())} else 24 end), '%Y-%m-%d %H:%M:%S') as next_run from a")
def next_runs(spark, folder):
    last = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate"))
    run = K.next_run(pick(FREQUENCIES, "o_orderkey"), last, F.lit("2024-05-01").cast("timestamp"))
    return table(spark, folder, "orders").select("o_orderkey", F.date_format(run, "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("schedule_counters", "select l_suppkey as schedule_id, count(*) as total_runs, sum(l_linenumber)::bigint as total_found, sum(case when l_returnflag = 'R' then 0 else l_quantity::bigint end)::bigint as total_new from lineitem group by 1")
def schedule_counters(spark, folder):
    runs = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("schedule_id"), F.col("l_linenumber").alias("found"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("bigint")).alias("new"))
    return K.schedule_counters(runs, ["found", "new"])


@query("source_history", """with s as (select distinct l_partkey, l_suppkey from lineitem), c as (select l_partkey as product_id, l_suppkey as source_id, (l_suppkey * 7 % 50) / 100.0 as confidence from s), r as (select *, row_number() over (partition by product_id order by confidence desc, source_id) as rank from c)
select product_id, source_id, rank::int as rank from r where rank <= 3""")
def source_history(spark, folder):
    """A product's sources, the surest first; the first three."""
    sources = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("source_id")).distinct().withColumn("confidence", F.col("source_id") * 7 % 50 / 100)
    return K.history(sources, ["product_id"], [F.desc("confidence"), "source_id"], 3).select("product_id", "source_id", "rank")


@query("last_pages", "with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select user_id, string_agg(event_id::varchar, ',' order by k desc) as events from r where k <= 5 group by 1")
def last_pages(spark, folder):
    """The last five entries of each key's history, in their order."""
    last = K.history(table(spark, folder, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    entries = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("o"), "event_id")))
    return last.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda s: s["event_id"].cast("string")), ",").alias("events"))


@query("either_set", "select p_partkey from part where p_brand = 'Brand#13' or lower(p_name) like '%brass%' or p_type like '%BRASS'")
def either_set(spark, folder):
    """The union of two sets of one table, as one filter: no row twice."""
    return table(spark, folder, "part").filter((F.col("p_brand") == "Brand#13") | F.contains(F.lower("p_name"), F.lit("brass")) | F.endswith("p_type", F.lit("BRASS"))).select("p_partkey")


@query("append_if_new", """with e as (select l_orderkey, l_suppkey as source, min((l_linenumber, l_partkey, l_quantity)) as place from lineitem where l_linenumber <= 4 group by 1, 2),
x as (select l_orderkey, l_suppkey as source from lineitem where l_linenumber = 5 qualify row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity) = 1), l as (select l_orderkey, list(source order by place) as s from e group by 1)
select l.l_orderkey, array_to_string(case when x.source is null or list_contains(l.s, x.source) then l.s else list_append(l.s, x.source) end, ',') as sources from l left join x using (l_orderkey)""")
def append_if_new(spark, folder):
    """An order's first four lines are a list of entries by supplier; its fifth is added if its supplier is new."""
    lines = table(spark, folder, "lineitem")
    at = F.struct("l_linenumber", "l_partkey", "l_quantity")
    known = lines.filter("l_linenumber <= 4").groupBy("l_orderkey", F.col("l_suppkey").alias("source")).agg(F.min(at).alias("at"))
    listed = known.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda s: F.struct(s["source"].alias("source"))).alias("entries"))
    new = lines.filter("l_linenumber = 5").groupBy("l_orderkey").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity"))["l_suppkey"].alias("source"))
    both = listed.join(new, "l_orderkey", "left")
    grown = F.when(F.col("source").isNull(), F.col("entries")).otherwise(R.appended(F.col("entries"), F.struct("source"), "source"))
    return both.select("l_orderkey", F.array_join(F.transform(grown, lambda s: s["source"].cast("string")), ",").alias("sources"))


@query("unique_names", """with a as (select p_partkey, split_part(lower(p_name), ' ', 1) as slug from part), t as (select distinct slug || case when p_partkey % 4 = 0 then '' else '-' || (p_partkey % 4 * 2) end as name from a where p_partkey % 5 = 0),
k as (select *, row_number() over (partition by slug order by p_partkey) as k from a), n as (select slug, unnest(range(0, 20000)) as n from (select distinct slug from a)),
free as (select slug, n, row_number() over (partition by slug order by n) as k from n where case when n = 0 then slug else slug || '-' || n end not in (select name from t))
select p_partkey, case when n = 0 then slug else slug || '-' || n end as unique_name from k join free using (slug, k)""")
def unique_names(spark, folder):
    """Names made unique against those in use and among themselves: the first free number for each."""
    slugs = table(spark, folder, "part").select("p_partkey", F.element_at(F.split(F.lower("p_name"), " "), 1).alias("slug"))
    taken = slugs.filter("p_partkey % 5 = 0").select(F.when(F.col("p_partkey") % 4 == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("p_partkey") % 4 * 2)).alias("name"))
    return K.unique_names(slugs, "slug", ["p_partkey"], taken).select("p_partkey", "unique_name")


@query("confidences", """with c as (select l_orderkey, 'f' || l_linenumber as f, list(round(l_discount * 10, 2) order by l_discount) filter (where l_returnflag <> 'R') as v from lineitem group by 1, 2), m as (select *, case when len(v) > 0 then list_sum(v) / len(v) end as mean from c)
select l_orderkey, coalesce(string_agg(f, ',' order by f) filter (where coalesce(mean, 0.5) < 0.5), '') as low, round(avg(coalesce(mean, 0.5)), 6) as mean from m group by 1""")
def confidences(spark, folder):
    """Fields that aren't sure, lists of confidences by their mean, and the mean of all fields."""
    per = table(spark, folder, "lineitem").groupBy("l_orderkey", F.concat(F.lit("f"), "l_linenumber").alias("f")).agg(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", F.round(F.col("l_discount") * 10, 2)))).alias("v"))
    maps = per.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m"))
    means = F.transform_values("m", lambda _, v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.5))
    return maps.select("l_orderkey", F.array_join(K.low_confidence(F.col("m")), ",").alias("low"), F.round(K.mean_confidence(means), 6).alias("mean"))


SAID_MEDALS = ["Gold", "double gold", "wood", "", "SILVER", "Category Winner"]


@query("award_rows", f"""with a as (select l_orderkey as product_id, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_suppkey % 6 = 0 then ' ' else 'c' || l_suppkey % 3 end as competition, case when l_partkey % 8 > 0 then year(l_shipdate) % 3 end as year, lower({pick_sql(SAID_MEDALS, 'l_partkey')}) as medal, case when l_linenumber % 2 = 0 then l_returnflag end as country from lineitem),
p as (select *, row_number() over (partition by product_id order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos, case medal when 'gold' then 'gold' when 'double gold' then 'double_gold' when 'silver' then 'silver' when 'category winner' then 'category_winner' end as key from a),
r as (select *, row_number() over (partition by product_id, competition, year, key order by pos) as k from p where trim(competition) <> '' and coalesce(year, 0) <> 0 and key is not null)
select product_id, pos, competition, year::int as year, key as medal, coalesce(country, 'Unknown') as country, 'General' as category from r where k = 1""")
def award_rows(spark, folder):
    """Awards that can be stored: complete, of a known medal, and once each."""
    k = ranked_lines(spark, folder)
    rows = k.select(
        F.col("l_orderkey").alias("product_id"), "pos", F.when(F.col("l_suppkey") % 6 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("l_suppkey") % 3)).alias("competition"),
        F.when(F.col("l_partkey") % 8 > 0, F.year("l_shipdate") % 3).alias("year"), pick(SAID_MEDALS, "l_partkey").alias("medal"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).alias("country"), F.lit("").alias("category"),
    )
    return K.awards_valid(rows)


def ranked_lines(spark, folder):
    from millrace.operators.matching import ranked

    lines = ranked(table(spark, folder, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    return lines.withColumn("pos", F.col("rank").cast("bigint")).drop("rank")


_LINES = "l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos from lineitem)"


@query("rating_rows", f"""with {_LINES}, a as (select l_orderkey as product_id, pos, case when l_suppkey % 9 > 0 then 's' || l_suppkey % 2 end as source, l_linenumber % 4 as score, 5 as max_score from l), r as (select *, row_number() over (partition by product_id, source, score order by pos) as k from a where source is not null and score <> 0)
select product_id, pos, source, score::int as score, max_score::int as max_score from r where k = 1""")
def rating_rows(spark, folder):
    rows = ranked_lines(spark, folder).select(F.col("l_orderkey").alias("product_id"), "pos", F.when(F.col("l_suppkey") % 9 > 0, F.concat(F.lit("s"), F.col("l_suppkey") % 2)).alias("source"), (F.col("l_linenumber") % 4).cast("int").alias("score"), F.lit(5).alias("max_score"))
    return K.ratings_valid(rows)


SHOWN = ["bottle", "label", "poster", "lifestyle"]


@query("image_rows", f"""with {_LINES}, a as (select l_orderkey as product_id, pos, 'u' || l_partkey % 3 as url, {pick_sql(SHOWN, 'l_suppkey')} as image_type, case when l_linenumber = 3 then '' else 'web' end as source from l), r as (select *, row_number() over (partition by product_id, url order by pos) as k from a where source <> '' and image_type <> 'poster')
select product_id, pos, url, image_type, source from r where k = 1""")
def image_rows(spark, folder):
    rows = ranked_lines(spark, folder).select(F.col("l_orderkey").alias("product_id"), "pos", F.concat(F.lit("u"), F.col("l_partkey") % 3).alias("url"), pick(SHOWN, "l_suppkey").alias("image_type"), F.when(F.col("l_linenumber") == 3, "").otherwise("web").alias("source"))
    return K.images_valid(rows)


@query("structure_alerts", """with c as (select user_id, count(*) as tested, list(distinct event_type order by event_type) filter (where event_type in ('error', 'click')) as failed from events group by 1), f as (select user_id, min(event_type) as old, max(event_type) as new from events group by 1), y as (select user_id, count(*) as pages, sum(value::int)::bigint as items from events group by 1 having count(*) % 5 = 0)
select user_id as source, case when len(failed) > 1 then 'critical' else 'warning' end as severity, 'selectors' as kind, len(failed) || ' of ' || tested || ': ' || array_to_string(failed, ', ') as detail from c where len(failed) > 0
union all select user_id, 'critical', 'fingerprint', old[1:8] || ' > ' || new[1:8] from f where old <> new union all select user_id, 'warning', 'low_yield', pages || ' items on ' || pages || ' pages' from y""")
def structure_alerts(spark, folder):
    """Alerts of failing selectors, changed pages and low yields, in one list."""
    by = table(spark, folder, "events").groupBy(F.col("user_id").alias("source"))
    checks = by.agg(F.count("*").alias("tested"), F.array_sort(F.collect_set(F.when(F.col("event_type").isin("error", "click"), F.col("event_type")))).alias("failed"))
    prints = by.agg(F.min("event_type").alias("old"), F.max("event_type").alias("new"))
    aborts = by.agg(F.count("*").alias("pages")).filter("pages % 5 = 0").withColumn("items", F.col("pages"))
    return K.structure_alerts(checks, prints, aborts)


@query("review_step", """with f as (select l_orderkey as product_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as pos, 'u' || l_suppkey as url, l_partkey % 4 > 0 as matches, 'f' || l_linenumber % 3 as field_name, case when l_quantity > 40 then '' else 'v' || l_partkey end as value from lineitem),
u as (select product_id, pos, row_number() over (partition by product_id order by pos) as k from f where matches), t as (select f.* from f join u using (product_id, pos) where k <= 3 and matches and value <> ''), g as (select product_id, field_name, arg_min(value, pos) as value, arg_min(url, pos) as url from t group by 1, 2)
select product_id, field_name, value, url from g where not (field_name = 'f0' and product_id % 2 = 0) and not (field_name = 'f1' and product_id % 3 > 0 and product_id % 10 / 10.0 >= 0.7)""")
def review_step(spark, folder):
    """What review pages add to products: matching pages, three at most, for fields that are empty or less sure."""
    lines = ranked_lines(spark, folder)
    found = lines.select(F.col("l_orderkey").alias("product_id"), "pos", F.concat(F.lit("u"), "l_suppkey").alias("url"), (F.col("l_partkey") % 4 > 0).alias("matches"), F.concat(F.lit("f"), F.col("l_linenumber") % 3).alias("field_name"), F.when(F.col("l_quantity") > 40, "").otherwise(F.concat(F.lit("v"), "l_partkey")).alias("value"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("product_id"))
    sure = orders.filter("product_id % 2 = 0").select("product_id", F.lit("f0").alias("field_name"), F.lit("known").alias("value"), F.lit(0.9).alias("confidence"))
    some = orders.select("product_id", F.lit("f1").alias("field_name"), F.when(F.col("product_id") % 3 > 0, "said").otherwise(" ").alias("value"), (F.col("product_id") % 10 / 10).alias("confidence"))
    return K.reviewed(sure.unionByName(some), found, 0.7, 3)
