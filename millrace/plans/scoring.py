"""Scores, statuses and gates over product records made of part's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import scoring as S
from millrace.registry import query
from millrace.sources.tables import table

#: A record's columns as (name, expression that both engines read): which fields are filled follows from the key.
RECORD = {
    "product_id": "p_partkey",
    "name": "case when p_partkey % 31 = 0 then '' else p_name end",
    "brand_id": "p_partkey % 4",
    "product_type": "p_type",
    "abv": "case when p_size % 6 = 0 then 0.0e0 else p_size * 1.0e0 end",
    "description": "case when p_partkey % 3 = 0 then p_brand end",
    "palate_flavors": "split(case p_partkey % 5 when 0 then null when 1 then 'oak' else 'oak,smoke,salt' end, ',')",
    "palate_description": "case when p_partkey % 7 = 0 then 'rich' end",
    "initial_taste": "case when p_partkey % 11 = 0 then 'sweet' end",
    "mid_palate_evolution": "case when p_partkey % 2 = 0 then 'long' end",
    "mouthfeel": "case when p_partkey % 3 = 1 then 'oily' end",
    "nose_description": "case when p_size % 2 = 0 then 'peat' end",
    "primary_aromas": "split(case when p_size % 3 = 0 then 'a,b' else 'a' end, ',')",
    "finish_description": "case when p_size % 5 = 0 then 'dry' end",
    "final_notes": "case when p_size % 4 = 0 then 'ash' end",
    "finish_flavors": "split(case when p_partkey % 4 = 0 then 'x,y' end, ',')",
    "finish_length": "p_size % 3",
    "best_price": "case when p_partkey % 10 = 0 then 0.0e0 else p_retailprice end",
    "images": "split(case when p_partkey % 2 = 1 then 'i' end, ',')",
    "ratings": "split(case when p_partkey % 6 = 1 then 'r' end, ',')",
    "awards": "split(case when p_partkey % 6 = 2 then 'w' end, ',')",
    "source_count": "p_partkey % 4",
    "category": "case p_partkey % 3 when 0 then ' ' when 1 then p_brand end",
    "color_description": "case when p_partkey % 9 = 0 then 'amber' end",
    "color_intensity": "p_size % 4",
    "clarity": "case when p_partkey % 8 = 0 then ' ' end",
    "viscosity": "case when p_partkey % 13 = 0 then 'thick' end",
    "flavor_intensity": "case when p_size % 5 = 1 then p_size end",
    "complexity": "p_size % 2",
    "balance": "cast(null as int)",
    "brand": "case when p_partkey % 4 > 0 then p_brand else '' end",
    "price": "case when p_partkey % 20 = 0 then p_retailprice end",
    "current_status": "case p_partkey % 40 when 0 then 'rejected' when 1 then 'merged' else 'partial' end",
}
RECORD_SQL = "r as (select " + ", ".join(f"{e.replace('split(', 'string_split(')} as {c}" for c, e in RECORD.items()) + " from part)"


def record(spark, folder):
    return table(spark, folder, "part").selectExpr(*(f"{e} as {c}" for c, e in RECORD.items()))


_T = lambda c: f"coalesce({c} <> '', false)"
_N = lambda c: f"coalesce({c} <> 0, false)"
_L = lambda c, n=1: f"coalesce(len({c}) >= {n}, false)"
_P = lambda *pairs: " + ".join(f"case when {c} then {v} else 0 end" for c, v in pairs)
SCORE_SQL = f"""s as (select *, least(100, {_P((_T('name'), 10), (_N('brand_id'), 5), (_T('product_type'), 5), (_N('abv'), 5), (_T('description'), 5))}
 + least(20, {_P((_L('palate_flavors', 2), 10), (_T('palate_description') + ' or ' + _T('initial_taste'), 5), (_T('mid_palate_evolution'), 3), (_T('mouthfeel'), 2))})
 + least(10, {_P((_T('nose_description'), 5), (_L('primary_aromas', 2), 5))})
 + least(10, {_P((_T('finish_description') + ' or ' + _T('final_notes'), 5), (_L('finish_flavors', 2), 3), (_N('finish_length'), 2))})
 + {_P((_N('best_price'), 5), (_L('images'), 5), (_L('ratings'), 5), (_L('awards'), 5), ('source_count >= 2', 5), ('source_count >= 3', 5))}) as score from r)"""
PALATE_SQL = f"({_L('palate_flavors')} or {_T('palate_description')} or {_T('initial_taste')})"


_F = lambda c: f"coalesce(trim({c}) <> '', false)"
_G = lambda c: f"coalesce({c} > 0, false)"


@query("completeness_service", f"""with {RECORD_SQL}, s as (select *, least(100, {_P((_T('name'), 10), (_N('brand_id'), 5), (_T('product_type'), 5), (_N('abv'), 5), (_F('category'), 3), (_F('description'), 5))}
 + {_P((_L('palate_flavors', 3), 10), (_F('palate_description') + ' or ' + _F('initial_taste'), 5), (_F('mid_palate_evolution'), 3), (_F('mouthfeel'), 2))} + {_P((_F('nose_description'), 5), (_L('primary_aromas', 2), 5))}
 + {_P((_L('finish_flavors', 2), 5), (_F('finish_description') + ' or ' + _F('final_notes'), 3), (_G('finish_length'), 2))} + {_P((_F('color_description') + ' or ' + _G('color_intensity') + ' or ' + _F('clarity') + ' or ' + _F('viscosity'), 3), (_G('flavor_intensity') + ' or ' + _G('complexity'), 5))}
 + {_P((_N('best_price'), 5), (_L('images'), 2), (_L('awards'), 2), ('source_count >= 2', 5), ('source_count >= 3', 5))}) as score, {_L('palate_flavors', 2)} or {_F('palate_description')} or {_F('initial_taste')} as palate from r)
select product_id, score, case when current_status in ('rejected', 'merged') then current_status when not palate then case when score >= 30 then 'partial' else 'incomplete' end when score >= 80 and source_count >= 2 then 'verified' when score >= 60 then 'complete' when score >= 30 then 'partial' else 'incomplete' end as status from s""")
def completeness_service(spark, folder):
    """The service's score and status."""
    rows = record(spark, folder).withColumn("score", S.completeness_service())
    return rows.select("product_id", "score", S.status(F.col("score"), S.has_palate_service(), F.col("current_status"), F.col("source_count") >= 2).alias("status"))


@query("completeness_pipeline", f"""with {RECORD_SQL} select product_id, least(100, {_P((_T('name'), 10), (_T('brand'), 5), (_T('product_type'), 5), (_N('abv'), 5), (_T('description'), 5))}
 + {_P((_L('palate_flavors', 2), 10), (_T('palate_description') + ' or ' + _T('initial_taste'), 5), (_T('mid_palate_evolution'), 3), (_T('mouthfeel'), 2))} + {_P((_T('nose_description'), 5), (_L('primary_aromas', 2), 5))}
 + {_P((_T('finish_description') + ' or ' + _T('final_notes'), 5), (_L('finish_flavors', 2), 3), (_N('finish_length'), 2))} + {_P((_N('best_price') + ' or ' + _N('price'), 5), (_L('images'), 5), (_L('ratings'), 5), (_L('awards'), 5), ('coalesce(source_count, 1) >= 2', 5), ('coalesce(source_count, 1) >= 3', 5))}) as score from r""")
def completeness_pipeline(spark, folder):
    return record(spark, folder).select("product_id", S.completeness_pipeline().alias("score"))


_HAVE = {
    "name": "trim(name) <> ''", "brand": "brand_id is not null", "product_type": "trim(product_type) <> ''", "abv": "abv is not null", "category": "trim(category) <> ''", "nose_description": "trim(nose_description) <> ''",
    "palate_flavors": "{len}(palate_flavors) > 0", "finish_length": "finish_length is not null", "primary_aromas": "{len}(primary_aromas) > 0", "color_description": "trim(color_description) <> ''", "best_price": "best_price is not null",
    "award_count": "{len}(awards) > 0", "rating_count": "{len}(ratings) > 0",
}


def _have(field: str) -> str:
    return _HAVE[field].format(len="len") if field in _HAVE else "false"


@query("missing_weighted", f"with {RECORD_SQL}, m as (select product_id, unnest([{', '.join(f'case when coalesce({_have(f)}, false) then 0 else {w} end' for f, w in S.WEIGHTED_FIELDS.items())}]) as w, unnest([{', '.join(repr(f) for f in S.WEIGHTED_FIELDS)}]) as f, unnest(range({len(S.WEIGHTED_FIELDS)})) as i from r) select product_id, string_agg(f, ',' order by i) filter (where w > 0) as missing, sum(w)::int as weight from m group by 1")
def missing_weighted(spark, folder):
    """Weighted fields that a record hasn't, in order, and what they weigh together."""
    found = S.missing_weighted({f: F.expr(e.format(len="size")) for f, e in _HAVE.items()})
    rows = record(spark, folder).select("product_id", found.alias("m"))
    return rows.select("product_id", F.array_join(F.transform("m", lambda x: x["field"]), ",").alias("missing"), F.aggregate("m", F.lit(0), lambda a, x: a + x["weight"]).alias("weight"))


@query("completeness", f"with {RECORD_SQL}, {SCORE_SQL} select product_id, score, case when score >= 90 then 'complete' when score >= 70 then 'good' when score >= 40 then 'partial' else 'skeleton' end as tier from s")
def completeness(spark, folder):
    return record(spark, folder).select("product_id", S.completeness().alias("score")).withColumn("tier", S.tier(F.col("score")))


@query("product_status", f"""with {RECORD_SQL}, {SCORE_SQL}, l as (select *, case when score >= 30 then 'partial' else 'incomplete' end as low from s)
select product_id, case when current_status in ('rejected', 'merged') then current_status when not {PALATE_SQL} then low when score >= 80 then 'verified' when score >= 60 then 'complete' else low end as status,
case when current_status in ('rejected', 'merged') then current_status when not {PALATE_SQL} then low when score >= 80 then case when source_count >= 2 then 'verified' else 'complete' end when score >= 60 then 'complete' else low end as service_status from l""")
def product_status(spark, folder):
    scored = record(spark, folder).withColumn("score", S.completeness())
    both = (S.status(F.col("score"), S.has_palate(), F.col("current_status"), x) for x in (None, F.col("source_count") >= 2))
    return scored.select("product_id", next(both).alias("status"), next(both).alias("service_status"))


@query("enrich_priority", f"with {RECORD_SQL}, {SCORE_SQL} select product_id, greatest(1, least(10, greatest(1, 10 - floor(score / 11)::int) + case when source_count >= 3 then 2 when source_count >= 1 then 1 else 0 end + case when finish_length >= 2 then 1 else 0 end + case when product_id % 9 = 0 then 1 else 0 end))::int as priority from s")
def enrich_priority(spark, folder):
    scored = record(spark, folder).withColumn("score", S.completeness())
    return scored.select("product_id", S.enrichment_priority(F.col("score"), F.col("source_count"), F.col("finish_length") + 3, F.col("product_id") % 9 == 0).cast("int").alias("priority"))


_SAYS = lambda c: f"coalesce(trim({c}) <> '' and lower({c}) not in ('unknown', 'n/a', 'none'), false)"


@query("record_confidence", f"""with {RECORD_SQL}, q as (select product_id, case when product_id % 13 = 0 then 'Unknown' else name end as name, description, palate_description, mouthfeel, initial_taste, product_type from r)
select product_id, round(case when coalesce(trim(name) <> '', false) then greatest(0.35, x) else x end, 2)::double as confidence from (select *, case when {_SAYS('name')} then 0.5e0 else 0.0e0 end
 + 0.4e0 * (({_SAYS('description')})::int + ({_SAYS('palate_description')})::int + ({_SAYS('product_type')})::int) / 3 + 0.1e0 * (coalesce(trim(mouthfeel) <> '', false)::int + coalesce(trim(initial_taste) <> '', false)::int) / 2 as x from q)""")
def record_confidence(spark, folder):
    name = F.when(F.col("product_id") % 13 == 0, "Unknown").otherwise(F.col("name"))
    return record(spark, folder).select("product_id", S.record_confidence(name, [F.col("description"), F.col("palate_description"), F.col("product_type")], [F.col("mouthfeel"), F.col("initial_taste")]).alias("confidence"))


FIELDS = ["name", "brand", "region", "abv", "primary_cask", "indication_age", "harvest_year", "nose", "palate", "finish", "style_notes"]
#: Field k is populated unless the key's remainder by k + 2 is 0.
POPULATED = "filter(array(" + ", ".join(f"case when p_partkey % {k + 2} <> 0 then '{f}' end" for k, f in enumerate(FIELDS)) + "), x -> x is not null)"
POPULATED_SQL = "[x for x in [" + ", ".join(f"case when p_partkey % {k + 2} <> 0 then '{f}' end" for k, f in enumerate(FIELDS)) + "] if x is not null]"
RULES = {
    "skeleton": ["name"], "partial": ["name", "brand", "region"], "baseline": ["name", "brand", "region", "abv", "primary_cask"], "enriched": ["nose"],
    "baseline_or": [["indication_age", "harvest_year"], ["palate", "finish"]], "enriched_or": [["finish", "style_notes"]], "waivers": ["ruby", "reserve ruby"],
}
_HAS = lambda fields: f"list_has_all(p, {fields!r})"
_ANY = lambda fields: f"list_has_any(p, {fields!r})"


@query("quality_gate_v3", f"""with q as (select p_partkey, {POPULATED_SQL} as p, p_size * 2.0e0 as ecp, case when p_partkey % 2 = 0 then ' Blended Malt ' else p_type end as c, case when p_partkey % 9 < 3 then 'Ruby' end as style from part),
b as (select *, lower(trim(c)) = 'blended malt' as blend, coalesce(lower(style) in ('ruby', 'reserve ruby'), false) as waived from q),
z as (select *, case when blend then {_HAS(['name', 'brand', 'abv'])} else {_HAS(RULES['baseline'])} end and {_ANY(['palate', 'finish'])} and (waived or {_ANY(['indication_age', 'harvest_year'])}) as base from b)
select p_partkey, case when not list_contains(p, 'name') then 'rejected' when ecp >= 90 then 'complete' when base and {_HAS(['nose'])} and {_ANY(['finish', 'style_notes'])} then 'enriched' when base then 'baseline'
 when case when blend then {_HAS(['name', 'brand'])} else {_HAS(['name', 'brand', 'region'])} end then 'partial' else 'skeleton' end as status from z""")
def quality_gate_v3(spark, folder):
    rows = table(spark, folder, "part").withColumn("p", F.expr(POPULATED))
    category = F.when(F.col("p_partkey") % 2 == 0, " Blended Malt ").otherwise(F.col("p_type"))
    style = F.when(F.col("p_partkey") % 9 < 3, "Ruby")
    return rows.select("p_partkey", S.gate_v3(F.col("p"), F.col("p_size") * 2.0, category, style, RULES).alias("status"))


V2 = [("enriched", ["name", "brand", "abv"], 3, ["nose", "palate", "finish", "style_notes"]), ("complete", ["name", "brand", "abv"], 2, ["nose", "palate", "finish"]), ("partial", ["name", "brand"], 1, ["region", "abv"])]


@query("quality_gate_v2", f"with q as (select p_partkey, {POPULATED_SQL} as p from part) select p_partkey, case when not list_contains(p, 'name') then 'rejected' " + " ".join(f"when {_HAS(need)} and len(list_intersect(p, {among!r})) >= {n} then '{name}'" for name, need, n, among in V2) + " else 'skeleton' end as status from q")
def quality_gate_v2(spark, folder):
    return table(spark, folder, "part").withColumn("p", F.expr(POPULATED)).select("p_partkey", S.gate_v2(F.col("p"), V2).alias("status"))


@query("low_confidence_fields", "select event_id, array_to_string([k for k in ['k1', 'k2', 'k3'] if case k when 'k1' then value / 100 when 'k2' then 0.5e0 end < 0.5], ',') as low from events")
def low_confidence_fields(spark, folder):
    """Fields whose known confidence is below a half."""
    maps = F.create_map(F.lit("k1"), F.col("value") / 100, F.lit("k2"), F.lit(0.5), F.lit("k3"), F.lit(None).cast("double"))
    low = F.array_except(F.map_keys(maps), F.map_keys(S.confident(maps)))
    return table(spark, folder, "events").select("event_id", F.array_join(F.array_sort(low), ",").alias("low"))
