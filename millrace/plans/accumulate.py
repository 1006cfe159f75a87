"""Queries that merge whole fields, lists and maps, over suppliers' lines and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import accumulate as A
from millrace.registry import query
from millrace.sources.tables import table

#: The lines of a part, in order of arrival: each says a list of two flags and a map of two entries, so sure of them.
LINES = "n as (select l_partkey as k, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity) as o, case when l_linenumber % 3 = 0 then lower(l_returnflag) else ' ' || l_returnflag end as a, case when l_linenumber % 2 = 0 then l_linestatus else 'x' || l_suppkey % 5 end as b, case when l_linenumber = 5 then '' else l_shipinstruct end as v, round(l_discount, 2) as c from (select *, 'v' || l_suppkey % 7 as l_shipinstruct from lineitem)), w as (select *, case when l then [] else [a, b] end as items from (select *, c = 0.05 as l from n))"


def _lines(spark, folder):
    from pyspark.sql import Window

    lines = table(spark, folder, "lineitem")
    order = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    a = F.when(F.col("l_linenumber") % 3 == 0, F.lower("l_returnflag")).otherwise(F.concat(F.lit(" "), "l_returnflag"))
    b = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise(F.concat(F.lit("x"), F.col("l_suppkey") % 5))
    v = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat(F.lit("v"), F.col("l_suppkey") % 7))
    c = F.round("l_discount", 2)
    items = F.when(c == 0.05, F.array().cast("array<string>")).otherwise(F.array(a, b))
    return lines.select(F.col("l_partkey").alias("k"), order.alias("o"), items.alias("items"), F.create_map(F.lower(F.trim(a)), v, F.concat(F.lit("s"), b), b).alias("entries"), c.alias("c"))


@query("merge_lists", f"""with {LINES}, t as (select * from w where len(items) > 0), m as (select k, max(c) as best from t group by 1), f as (select t.k, min(o) as first_o from t join m on t.k = m.k and c = best group by 1),
e as (select t.k, o, unnest(items) as item, unnest([1, 2]) as i from t join f on t.k = f.k and o >= first_o), g as (select k, lower(trim(item)) as key, arg_min(item, o * 10 + i) as item, min(o * 10 + i) as place from e group by 1, 2)
select k, string_agg(item, '|' order by place) as items from g group by 1""")
def merge_lists(spark, folder):
    """Lists of a product's sources in order: a surer one replaces what was there, others add to it."""
    return A.merge_lists(_lines(spark, folder), ["k"], "o", "items", "c").select("k", F.array_join("values", "|").alias("items"))


@query("merge_maps", f"""with {LINES}, m as (select k, max(c) as best from n group by 1), f as (select n.k, min(o) as first_o from n join m on n.k = m.k and c = best group by 1),
e as (select n.k, o, lower(trim(a)) as map_key, v as value from n join f on n.k = f.k and o >= first_o union all select n.k, o, 's' || b, b from n join f on n.k = f.k and o >= first_o),
r as (select *, row_number() over (partition by k, map_key order by case when trim(value) = '' then 1 else 0 end, o) as rn from e) select k, map_key, value from r where rn = 1""")
def merge_maps(spark, folder):
    """Maps of a product's sources in order: keys that are missing or empty are filled, nothing is replaced."""
    return A.merge_maps(_lines(spark, folder), ["k"], "o", "entries", "c")


@query("first_wins_lists", f"with {LINES}, e as (select k, o, unnest(items) as item, unnest([1, 2]) as i from w where len(items) > 0), g as (select k, item, min(o * 10 + i) as place from e group by 1, 2) select k, string_agg(item, '|' order by place) as items from g group by 1")
def first_wins_lists(spark, folder):
    return A.first_lists(_lines(spark, folder), ["k"], "o", "items").select("k", F.array_join("values", "|").alias("items"))


@query("refresh_lists", f"with {LINES}, e as (select k, o, unnest(items) as item, unnest([1, 2]) as i from w where len(items) > 0), g as (select k, lower(trim(item)) as key, arg_min(item, o * 10 + i) as item, min(o * 10 + i) as place from e group by 1, 2), l as (select k, string_agg(item, '|' order by place) as items from g group by 1) select n.k, any_value(l.items) as items, max(n.c) as confidence from n left join l on l.k = n.k group by 1")
def refresh_lists(spark, folder):
    """Lists refreshed: united whatever the confidence, of which the highest stays."""
    return A.refresh_lists(_lines(spark, folder), ["k"], "o", "items", "c").select("k", F.array_join("values", "|").alias("items"), "confidence")


#: Two records of a part: what is known, and what a source says.
PAIR = {
    "k": "p_partkey",
    "ot": "case p_partkey % 5 when 0 then null when 1 then ' ' else p_name end",
    "nt": "case p_partkey % 7 when 0 then null when 1 then '' when 2 then upper(p_name) else p_type end",
    "ol": "case p_partkey % 6 when 0 then null when 1 then split('', 'x') else split(p_name, ' ') end",
    "nl": "case p_partkey % 4 when 0 then null else split(concat(upper(p_type), ' ', p_name, ' ', p_brand, ' ', p_brand), ' ') end",
    "oc": "case when p_size % 9 > 0 then p_size / 50e0 end",
    "nc": "case when p_size % 11 > 0 then p_size % 10 / 10e0 end",
}
_PAIR_SQL = "r as (select " + ", ".join(f"{e.replace('split(', 'string_split(')} as {c}" for c, e in PAIR.items()) + " from part)"


def _pairs(spark, folder):
    return table(spark, folder, "part").selectExpr(*(f"{e} as {c}" for c, e in PAIR.items()))


_EMPTY_T, _EMPTY_L = "coalesce(trim({0}) = '', true)", "coalesce(len({0}) = 0, true)"


def _merge_sql(old: str, new: str, empty: str, grown: str) -> str:
    e, n = empty.format(old), empty.format(new)
    return f"case when {n} then {old} when {e} or coalesce(nc, 0) > coalesce(oc, 0) then {new} else {grown} end"


_ADDED = "list_filter(nl, lambda x, i: not list_contains([lower(trim(y)) for y in ol], lower(trim(x))) and list_position([lower(trim(y)) for y in nl], lower(trim(x))) = i)"
_ADDED_V2 = "list_filter(nl, lambda x, i: not list_contains(ol, x) and list_position(nl, x) = i)"


@query("merge_records", f"""with {_PAIR_SQL} select k, {_merge_sql('ot', 'nt', _EMPTY_T, 'ot')} as text, array_to_string({_merge_sql('ol', 'nl', _EMPTY_L, f'list_concat(ol, {_ADDED})')}, '|') as list,
 coalesce(not {_EMPTY_L.format('nl')} and ({_EMPTY_L.format('ol')} or coalesce(nc, 0) > coalesce(oc, 0) or len({_ADDED}) > 0), false) as list_enriched from r""")
def merge_records(spark, folder):
    """Two records merged by confidence: texts replaced by surer ones, lists grown by new items."""
    text = A.merge(F.col("ot"), F.col("oc"), F.col("nt"), F.coalesce("nc", F.lit(0.0)), "string")
    listed = A.merge(F.col("ol"), F.col("oc"), F.col("nl"), F.coalesce("nc", F.lit(0.0)), "array")
    return _pairs(spark, folder).select("k", text.alias("t"), listed.alias("l")).select("k", F.col("t.value").alias("text"), F.array_join("l.value", "|").alias("list"), F.col("l.enriched").alias("list_enriched"))


@query("merge_records_v2", f"""with {_PAIR_SQL} select k, case when nt is null then ot when ot is null or ot = '' or coalesce(nc, 0.5) > coalesce(oc, 0) then nt else ot end as text, round(case when nt is not null and (ot is null or ot = '' or coalesce(nc, 0.5) > coalesce(oc, 0)) then coalesce(nc, 0.5) else oc end, 6)::double as confidence,
 array_to_string(case when nl is null then ol when ol is null or len(ol) = 0 or coalesce(nc, 0.5) > coalesce(oc, 0) then nl else list_concat(ol, {_ADDED_V2}) end, '|') as list from r""")
def merge_records_v2(spark, folder):
    text = A.merge_v2(F.col("ot"), F.col("oc"), F.col("nt"), F.col("nc"), "string")
    listed = A.merge_v2(F.col("ol"), F.col("oc"), F.col("nl"), F.col("nc"), "array")
    return _pairs(spark, folder).select("k", text.alias("t"), listed.alias("l")).select("k", F.col("t.value").alias("text"), F.round("t.confidence", 6).alias("confidence"), F.array_join("l.value", "|").alias("list"))


@query("fill_missing", f"""with {_PAIR_SQL} select k, case when coalesce(ot, '') = '' then coalesce(nt, ot) else ot end as text, array_to_string(case when len(nl) > 0 then list_sort(list_distinct(list_concat(coalesce(ol, []), nl))) else ol end, '|') as list from r""")
def fill_missing(spark, folder):
    rows = _pairs(spark, folder)
    return rows.select("k", A.fill_missing(F.col("ot"), F.col("nt"), "string").alias("text"), F.array_join(A.fill_missing(F.col("ol"), F.col("nl"), "array"), "|").alias("list"))


@query("verified_update", """with r as (select p_partkey as k, p_name as n, case p_partkey % 3 when 0 then ' ' || upper(p_name) when 1 then '' else p_type end as m, p_size % 4 as s, p_partkey % 4 as z, string_split(p_name, ' ') as f, case when p_partkey % 2 = 0 then list_reverse(string_split(p_name, ' ')) else string_split(p_type, ' ') end as g, p_partkey % 10 = 0 as known from part)
select k, concat_ws(',', case when known then 'name' end, case when not known and n <> '' and m <> '' and lower(trim(n)) = lower(trim(m)) then 'name' end, case when s <> 0 and z <> 0 and s = z then 'volume_ml' end, case when list_sort(list_distinct(f)) = list_sort(list_distinct(g)) then 'palate_flavors' end) as verified from r""")
def verified_update(spark, folder):
    """Fields that a second source confirms, after those that were known."""
    words = lambda c: F.split(c, " ")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper("p_name"))).when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("p_type"))
    fields = {
        "name": (F.col("p_name"), said, "string"), "volume_ml": (F.col("p_size") % 4, F.col("p_partkey") % 4, "number"),
        "palate_flavors": (words("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.reverse(words("p_name"))).otherwise(words("p_type")), "array"),
    }
    known = F.when(F.col("p_partkey") % 10 == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("k"), F.array_join(A.newly_verified(known, fields), ",").alias("verified"))


@query("award_merge", """with a as (select p_partkey as k, p_size % 3 as y, case p_partkey % 4 when 0 then '' when 1 then null else 'gold' end as medal from part)
select k, 2 + (y = 2 and coalesce(medal, '') <> '')::int as awards, case when y = 2 and coalesce(medal, '') <> '' then 'iwsc:2022:gold' else 'iwsc:2021:silver' end as last_award from a""")
def award_merge(spark, folder):
    """An award added to a record's, unless its competition and year are there or its medal is missing."""
    award = lambda year, medal: F.struct(F.lit("iwsc").alias("competition"), year.cast("int").alias("year"), medal.cast("string").alias("medal"))
    known = F.array(award(F.lit(2020), F.lit("gold")), award(F.lit(2021), F.lit("silver")))
    medal = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.lit(None)).otherwise("gold")
    merged = A.add_award(known, award(2020 + F.col("p_size") % 3, medal))
    last = F.element_at("m", -1)
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), merged.alias("m"))
    return rows.select("k", F.size("m").alias("awards"), F.concat_ws(":", last["competition"], last["year"], last["medal"]).alias("last_award"))
