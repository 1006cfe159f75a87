"""Queries that tell kinds: the driver's names and hosts with words of the trade added in turn."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import names as N
from millrace.functions import urls as U
from millrace.operators import kinds as K
from millrace.plans.texts import listed, listed_sql
from millrace.registry import query
from millrace.sources.config import import_sources
from millrace.sources.tables import table


def pick(values: list[str], key: str = "p_partkey", step: int = 1):
    """The value whose turn it is."""
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(key) / step) % len(values) + 1).cast("int"))


def pick_sql(values: list[str], key: str = "p_partkey", step: int = 1) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[{key} // {step} % {len(values)} + 1]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(column: str, words) -> str:
    """One pattern of all words, so that it isn't the chain of tests that the operator makes."""
    return f"regexp_matches({column}, {quoted('|'.join(re.escape(w) for w in words))})"


def map_sql(column: str, rules, otherwise: str = "null") -> str:
    return "case " + " ".join(f"when {condition} then {quoted(kind)}" for condition, kind in rules) + f" else {otherwise} end"


AWARD_NAMES = [
    "Tawny Port", "Old Vintage Port", "Portobello Stout", "port charlotte", "Importer", "Highland Single Malt", "Straight Bourbon", "Cognac VSOP port", "London Dry", "Estate Wine Rouge",
    "Grain Whisky", "Calvados", "Chateau Port Lane", "Spiced Rum", "Chardonnay", "Late Bottled Vintage", "Blended Malt", "Mezcal",
]
AWARD_CATEGORIES = ["", "Scotch", "Port Wine", "Winery", "Gin", "Brandy", "Tennessee"]
COMPETITIONS = ["IWSC", "World Whiskies Awards", "Decanter", "Porto Challenge"]
_AWARDS = f"a as (select p_partkey, p_name || ' ' || {pick_sql(AWARD_NAMES)} as name, {pick_sql(AWARD_CATEGORIES, step=3)} as category, {pick_sql(COMPETITIONS, step=5)} as competition from part), l as (select *, lower(name) as n, lower(category) as c, lower(name) || ' ' || lower(category) || ' ' || lower(competition) as x from a)"


def _awards(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.concat("p_name", F.lit(" "), pick(AWARD_NAMES)).alias("name"), pick(AWARD_CATEGORIES, step=3).alias("category"), pick(COMPETITIONS, step=5).alias("competition"))


@query("award_kind", f"with {_AWARDS} select p_partkey, case when {any_sql('x', K.PORT_WORDS)} then 'port_wine' when (x like '% port%' or x like 'port%' or n like '%port %') and not regexp_matches(x, 'brandy|cognac') then 'port_wine' when {any_sql('x', K.WHISKEY_WORDS)} then 'whiskey' end as kind from l")
def award_kind(spark, folder):
    return _awards(spark, folder).select("p_partkey", K.award_kind(F.col("name"), F.col("category"), F.col("competition")).alias("kind"))


def _wanted(kinds) -> str:
    words = [w for k in kinds for w in K.WANTED_WORDS[k]]
    return f"({any_sql('n', words)} or {any_sql('c', words)}) and not {any_sql('(n || chr(32) || c)', K.UNWANTED_WORDS)}"


@query("award_type_filter", f"with {_AWARDS} select p_partkey, {_wanted(['whiskey', 'port_wine'])} as wanted, {_wanted(['gin', 'rum'])} as other, true as every from l")
def award_type_filter(spark, folder):
    """Awards of the wanted kinds; where no kind is known, all."""
    kept = lambda *k: K.wanted_award(F.col("name"), F.col("category"), list(k))
    return _awards(spark, folder).select("p_partkey", kept("Whisky", "port_wine").alias("wanted"), kept("gin", "rum").alias("other"), kept("beer").alias("every"))


COUNTRIES = ["Scotland", "UK", "USA", "America", "Ireland", "Japan", "Canadian", "India", "Taiwan", "Australia", "France", "", " scotland "]
WHISKEY_NAMES = ["Blended", "Kentucky Bourbon", "Tennessee Rye", "Rye", "Single Malt", "Single Pot Still", "Old", "blend of rye"]


def _country(place: str) -> str:
    rules = []
    for places, words, otherwise in K.COUNTRY_TYPES:
        here = f"{place} in ({', '.join(map(quoted, places))})"
        rules += [(f"{here} and strpos(n, {quoted(w)}) > 0", kind) for w, kind in words] + [(here, otherwise)]
    return f"case when {place} <> '' then {map_sql(place, rules, quoted('world_whiskey'))} end"


@query("whiskey_type", f"with a as (select p_partkey, lower(trim({pick_sql(COUNTRIES)})) as place, lower(p_name || ' ' || {pick_sql(WHISKEY_NAMES, step=13)}) as n from part) select p_partkey, {_country('place')} as whiskey_type from a")
def whiskey_type(spark, folder):
    name = F.concat("p_name", F.lit(" "), pick(WHISKEY_NAMES, step=13))
    return table(spark, folder, "part").select("p_partkey", K.whiskey_type(pick(COUNTRIES), name).alias("whiskey_type"))


SPELLINGS = [s for spellings in K.WHISKEY_TYPES.values() for s in spellings] + ["Single Malt Scotch ", "KENTUCKY BOURBON", "unheard of", "malt"]


@query("type_map", f"with a as (select p_partkey, case when p_partkey % 41 > 0 then {pick_sql(SPELLINGS)} end as s from part), m(kind, spelling) as (values {', '.join(f'({quoted(k)}, {quoted(s)})' for k, spellings in K.WHISKEY_TYPES.items() for s in spellings)}) select p_partkey, case when s is not null then coalesce(kind, 'world_whiskey') end as kind from a left join m on spelling = lower(trim(s))")
def type_map(spark, folder):
    said = F.when(F.col("p_partkey") % 41 > 0, pick(SPELLINGS))
    return table(spark, folder, "part").select("p_partkey", K.whiskey_class(said).alias("kind"))


PORTS = ["LBV 2018", "Late Bottled Vintage", "Colheita 1990", "Vintage 2000", "Tawny 10", "Ruby Reserve", "White", "Branco", "Rosé", "Rosso", "Pink", "Crusted", "Single Quinta Vintage", "Quinta do Vale", "Garrafeira", "Reserve", "white port", "rose port", "bottled vintage"]


@query("port_style", f"with a as (select p_partkey, lower({pick_sql(PORTS)}) as n from part) select p_partkey, {map_sql('n', [(f'strpos(n, {quoted(w)}) > 0', style) for w, style in K.PORT_STYLES])} as style from a")
def port_style(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.port_style(pick(PORTS)).alias("style"))


_PATTERNS = [(f"regexp_matches(t, {quoted('(?i)' + p)})", s) for s, p in K.PORT_PATTERNS[:-1]]
_PATTERNS.append(("regexp_matches(t, '(?i)\\bvintage\\s+port\\b') or regexp_matches(regexp_replace(t, '(?i)(bottled|quinta)\\svintage\\b', '', 'g'), '(?i)\\bvintage\\b')", "vintage"))
SCORED = ["Gold, 95 points", "Best in Show 97/100", "silver score: 90", "Bronze medal 250 points 88/100", "commended", "score 101, 99 points", "platinum golden"]


@query("award_text", f"""with a as (select p_partkey, {pick_sql(PORTS)} || ' ' || {pick_sql(SCORED, step=19)} as t from part), n as (select *, [try_cast(regexp_extract(t, '(?i)(\\d{{2,3}})\\s*points', 1) as int), try_cast(regexp_extract(t, '(?i)score[:\\s]+(\\d{{2,3}})', 1) as int), try_cast(regexp_extract(t, '(\\d{{2,3}})/100', 1) as int)] as found from a)
select p_partkey, {map_sql('t', _PATTERNS)} as style, {map_sql('t', [(f"regexp_matches(t, {quoted('(?i)' + p)})", m) for m, p in K.MEDAL_PATTERNS], quoted('Unknown'))} as medal, [x for x in found if x <= 100][1] as score from n""")
def award_text(spark, folder):
    """Style, medal and score that an award's text tells."""
    rows = table(spark, folder, "part").select("p_partkey", F.concat(pick(PORTS), F.lit(" "), pick(SCORED, step=19)).alias("t"))
    return rows.select("p_partkey", K.port_style_in(F.col("t")).alias("style"), K.medal_in(F.col("t")).alias("medal"), K.score_in(F.col("t")).alias("score"))


PRODUCERS = ["Taylor Fladgate & Yeatman", "graham's", "Quinta", "Nobody", " Morris ", "De Krans", "x", "", "dow"]


@query("fortified_producer", f"with a as (select p_partkey, lower(trim({pick_sql(PRODUCERS)})) as n from part), f(p) as (values {', '.join(f'({quoted(p)})' for p in K.FORTIFIED_PRODUCERS)}) select p_partkey, n <> '' and exists (select 1 from f where strpos(n, p) > 0 or strpos(p, n) > 0) as fortified from a")
def fortified_producer(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.fortified(pick(PRODUCERS)).alias("fortified"))


ENTRANTS = ["Highland Park Distillery 12", "Winery Gurjaani", "2024", "ab", "Acme Ltd", "Ruby Estate", "Castle Company", "Plain Name", "  2023 "]


@query("valid_name", f"with a as (select p_partkey, {pick_sql(ENTRANTS)} as n, {pick_sql(AWARD_CATEGORIES, step=9)} as c from part) select p_partkey, length(n) >= 3 and not regexp_matches(trim(n), '^\\d{{4}}$') and (not {any_sql('lower(n)', K.COMPANY_WORDS)} or {any_sql('lower(n)', K.KIND_WORDS)} or {any_sql('lower(c)', K.KIND_WORDS)}) as valid from a")
def valid_name(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.valid_name(pick(ENTRANTS), pick(AWARD_CATEGORIES, step=9)).alias("valid"))


SITES = ["whiskybase.com", "iwsc.net", "heavenhill.com", "masterofmalt.com", "ft.com", "forbes.com", "decanter.com", "gq.com", "ardbeg.com", "wine.com", "thewhiskywash.com", "lagavulin.com", "example.net", "drizly.com", "whiskyadvocate.com"]
TITLES = ["Official site", "Buy now", "Review and tasting", "", "Shop price $5", "notes"]
SEARCHES = ["price", "review", "official", "other"]


@query("source_import", f"""with a as (select page_id, {pick_sql(SITES, 'page_id')} as site, 'Source ' || page_id % 40 as name from pages), x as (select *, lower(name || ' https://www.' || site || '/') as t, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from a), r as (select *, row_number() over (partition by slug order by page_id) as k from x)
select page_id, slug, case when page_id % 40 < 5 or k > 1 then 'skipped' else 'created' end as action, {map_sql('t', [(any_sql('t', w), c) for c, w in K.SOURCE_CATEGORIES.items()], quoted('review'))} as category, {any_sql('site', K.SCRIPTED_SOURCES)} as javascript, {any_sql('site', K.PROXIED_SOURCES)} as proxy from r""")
def source_import(spark, folder):
    """A file of sources in JSON: their slugs, categories and needs; known slugs, in the table or above, are skipped."""
    pages = table(spark, folder, "pages").select("page_id", F.concat(F.lit("Source "), F.col("page_id") % 40).alias("name"), F.concat(F.lit("https://www."), pick(SITES, "page_id"), F.lit("/")).alias("base_url"))
    file = pages.select("page_id", F.to_json(F.struct("name", "base_url", F.lit("whiskey").alias("product_type"))).alias("line"))
    known = spark.range(5).select(F.concat(F.lit("source-"), "id").alias("slug"))
    return import_sources(file, "page_id", "line", known).select("page_id", "slug", "action", "category", "javascript", "proxy")


@query("source_class", f"with a as (select page_id, {pick_sql(SITES, 'page_id')} as d from pages) select page_id, case when {any_sql('d', K.OFFICIAL_HOSTS)} then 'official_brand' when d in ({', '.join(map(quoted, K.TRUSTED_HOSTS))}) then 'trusted_retailer' else 'other' end as class from a")
def source_class(spark, folder):
    return table(spark, folder, "pages").select("page_id", K.source_class(U.host(F.concat(F.lit("https://www."), pick(SITES, "page_id"), F.lit("/x")))).alias("class"))


@query("serp_category", f"""with a as (select page_id, {pick_sql(SITES, 'page_id')} as d, lower({pick_sql(TITLES, 'page_id', 2)}) as t, lower({pick_sql(TITLES, 'page_id', 5)}) as s, {pick_sql(SEARCHES, 'page_id', 3)} as q from pages)
select page_id, case when {any_sql('d', K.SHOP_HOSTS)} then 'retailer' when {any_sql('d', K.REVIEW_HOSTS)} then 'review' when strpos(t, 'official') + strpos(s, 'official') > 0 then 'official'
 when q = 'price' then case when regexp_matches(t || s, 'buy|shop|price|\\$|cart') then 'retailer' else 'unknown' end when q = 'review' then case when regexp_matches(t || s, 'review|tasting|notes|rating') then 'review' else 'unknown' end when q = 'official' then 'potential_official' else 'unknown' end as category from a""")
def serp_category(spark, folder):
    found = K.result_category(pick(SITES, "page_id"), pick(TITLES, "page_id", 2), pick(TITLES, "page_id", 5), pick(SEARCHES, "page_id", 3))
    return table(spark, folder, "pages").select("page_id", found.alias("category"))


QUERIES = ["best Rye 2024", "vintage PORT", "dark rum", "London gin", "vodka", "red wine bourbon", "grumpy"]


@query("query_kind", f"with a as (select p_partkey, lower({pick_sql(QUERIES)}) as q from part) select p_partkey, case when regexp_matches(q, 'whisky|whiskey|scotch|bourbon|rye') then 'whiskey' when regexp_matches(q, 'port|wine') then 'port_wine' when q like '%rum%' then 'rum' when q like '%gin%' then 'gin' else 'spirits' end as kind from a")
def query_kind(spark, folder):
    return table(spark, folder, "part").select("p_partkey", K.query_kind(pick(QUERIES)).alias("kind"))


PARTS = ['<div class="a product-card b">1</div>' * 4, "page 2 of 9 pagination", "Add to cart", "search_results", "<h1>Old whisky</h1> tasting notes", "", "product-detail abv"]


def _count_sql(patterns) -> str:
    return " + ".join(f"regexp_matches(t, {quoted('(?is)' + p)})::int" for p in patterns)


@query("page_type", f"""with a as (select page_id, html || {pick_sql(PARTS, 'page_id')} as h from pages), l as (select page_id, h, lower(h) as t from a)
select page_id, case when {_count_sql(K.LIST_PATTERNS)} + case when len(regexp_extract_all(h, {quoted('(?i)' + K.CARD_PATTERN)})) >= 3 then 3 else 0 end + 2 * regexp_matches(t, {quoted(K.PAGE_OF_PATTERN)})::int
 > {_count_sql(K.SINGLE_PATTERNS)} + 2 * regexp_matches(t, {quoted(K.CART_PATTERN)})::int then 'list' else 'single' end as kind from l""")
def page_type(spark, folder):
    return table(spark, folder, "pages").select("page_id", K.page_type(F.concat("html", pick(PARTS, "page_id"))).alias("kind"))


REASONS = ["JS rendering needed", "Cloudflare challenge", "status_403", "empty body", "js-heavy, captcha", "Robot page", ""]


@query("escalation_flags", f"with a as (select event_id, lower({pick_sql(REASONS, 'event_id')}) as r from events) select event_id, regexp_matches(r, 'javascript|js rendering|js placeholder|js-heavy') as js_heavy, regexp_matches(r, 'cloudflare|captcha|403|bot|challenge') as bot_protected from a")
def escalation_flags(spark, folder):
    return table(spark, folder, "events").select("event_id", K.escalation_flags(pick(REASONS, "event_id")).alias("f")).select("event_id", "f.*")


@query("tier_choice", "select event_id, case when value / 100 >= 0.5 then 1 when event_id % 10 / 10 >= 0.5 then 2 else 3 end::int as recommended, event_id % 3 > 0 and (event_id % 4 = 0 or epoch(timestamp '2024-06-01') - epoch(ts) >= 3 * 86400) as retries_lower from events")
def tier_choice(spark, folder):
    """The cheapest tier that works, and whether a source at the last tier is tried lower again."""
    last = F.when(F.col("event_id") % 4 != 0, F.col("ts"))
    recommended = K.recommended_tier(F.col("value") / 100, F.col("event_id") % 10 / 10)
    return table(spark, folder, "events").select("event_id", recommended.cast("int").alias("recommended"), K.retries_lower(F.col("event_id") % 3 > 0, last, "2024-06-01").alias("retries_lower"))


HOUSES = ["Ardbeg", "Oban", "Graham's", "Wine-Com", "xy", ""]
HOUSE_HOSTS = ["ardbeg.com", "grahams-port.com", "masterofmalt.com", "target.com", "blog.wine.com", "oban.com", "example.org"]


def _ranked_sql(retailers) -> str:
    plain = "translate(lower(b), ' ''-', '')"
    return f"case when {any_sql('d', retailers)} then 2 when length({plain}) > 3 and strpos(translate(d, '-.', ''), {plain}) > 0 then 0 else 1 end"


@query("producer_url_rank", f"""with a as (select page_id, page_id // 20 as q, {pick_sql(HOUSE_HOSTS, 'page_id')} as d, {pick_sql(HOUSES, 'page_id', 20)} as b from pages), c as (select *, {_ranked_sql(K.RETAILERS)} as class, {_ranked_sql(K.RETAILERS_V2)} as class_v2 from a)
select page_id, class::int as class, class_v2::int as class_v2, row_number() over (partition by q order by class, page_id)::int as rank, row_number() over (partition by q order by class_v2, page_id)::int as rank_v2 from c""")
def producer_url_rank(spark, folder):
    """Twenty results make a search for a producer's page: official hosts first, then others, then shops; both lists."""
    from millrace.operators.matching import ranked

    host, brand = pick(HOUSE_HOSTS, "page_id"), pick(HOUSES, "page_id", 20)
    none = F.lit(None).cast("string")
    rows = table(spark, folder, "pages").select("page_id", F.floor(F.col("page_id") / 20).alias("q"), K.producer_rank(host, brand, none).alias("class"), K.producer_rank(host, brand, none, K.RETAILERS_V2).alias("class_v2"))
    first = ranked(rows, ["q"], ["class", "page_id"])
    return ranked(first.withColumnRenamed("rank", "rank_v1"), ["q"], ["class_v2", "page_id"]).select("page_id", "class", "class_v2", F.col("rank_v1").alias("rank"), F.col("rank").alias("rank_v2"))


BOTTLES = ["Booker's Batch 2", "BULLEIT BOURBON rye", "The Macallan 12", "Macallan 12", "Arran Malt", "Arranged Malt 10", "Unknown Distillery 12 Year Old", "Mystery Single Malt", "1792 Full Proof", "Some Rye Whiskey Year", "", "  Oban 14 "]


@query("brand_from_name", f"""with a as (select p_partkey, trim({pick_sql(BOTTLES)} || case when p_partkey % 5 = 0 then '' else ' ' || p_name end) as n from part)
select p_partkey, case when n <> '' then coalesce({map_sql('n', [(f"lower(n) like {quoted(b.lower() + '%')}", b) for b in K.BRANDS] + [(f"regexp_matches(n, '(?i)^{b}\\b')", b) for b in K.WHOLE_WORD_BRANDS])}, nullif(regexp_replace(trim(regexp_extract(n, {quoted(K.BRAND_END)}, 1)), {quoted(K.KIND_ENDING)}, ''), '')) end as brand from a""")
def brand_from_name(spark, folder):
    name = F.concat(pick(BOTTLES), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(" "), "p_name")))
    return table(spark, folder, "part").select("p_partkey", K.brand_from_name(name).alias("brand"))


WRITTEN = ["The Macallan(R) 18 Years Old", "Glen 12yo Ltd Ed", "Oak 10 y.o. \"CS\"", "  Peat   15 yrs ", "Dalmore™ 12Y/O", "bourbon whiskey 8 years old", "Single Malt Scotch 20yo!", "Irish Whiskey"]
_W = f"w as (select p_partkey, {pick_sql(WRITTEN)} || ' ' || p_name as s from part)"


def _chain_sql(column: str, steps) -> str:
    for pattern, plain in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(plain)}, 'g')"
    return column


_MATCH = [(r"\(r\)|\(tm\)|®|™", ""), ("['\"`]", ""), (r"^the\s+", ""), (r"\byears\b", "year"), (r"\byrs\b", "year"), (r"(\d+)\s*y\.?o\.?", r"\1 year"), (r"(\d+)\s*y/o", r"\1 year"), (r"\s+", " ")]
_SKELETON = [(re.escape(w), "") for w in N.SKELETON_WORDS] + [(r"(\d+)\s*y\.?o\.?", r"\1 year old"), (r"(\d+)\s*years?\s*old", r"\1 year old"), (r"[^\w\s]", ""), (r"\s+", " ")]


@query("name_forms", f"""with {_W}, m as (select p_partkey, trim({_chain_sql('lower(trim(s))', _MATCH)}) as match_name, {_chain_sql('lower(trim(s))', [(rf'{chr(92)}b{a}{chr(92)}b', b) for a, b in N.ABBREVIATIONS.items()])} as expanded, trim({_chain_sql('lower(trim(s))', _SKELETON)}) as skeleton_name from w)
select m.*, lower(p_brand) || ':' || match_name || case when p_size > 10 then ':' || p_size else '' end as match_key from m join part using (p_partkey)""")
def name_forms(spark, folder):
    """One name in the forms that each matcher compares, and its key with brand and strength."""
    said = F.concat(pick(WRITTEN), F.lit(" "), "p_name")
    abv = F.when(F.col("p_size") > 10, F.col("p_size"))
    return table(spark, folder, "part").select("p_partkey", N.match_name(said).alias("match_name"), N.expanded(said).alias("expanded"), N.skeleton_name(said).alias("skeleton_name"), N.match_key(said, F.col("p_brand"), abv).alias("match_key"))


VINTAGES = ["2019", "2019 vintage", "N/A", "nv", "1899", "abc", "bottled 1998 and 2001", " 2031 ", "", "-5", "12", None]


@query("vintage_year", f"""with {listed_sql(VINTAGES)}, a as (select k, s from t union all select 100 + o_orderkey, 'Vintage ' || year(o_orderdate) from orders), x as (select k, trim(s) as s, regexp_extract(trim(s), '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1) as y from a),
v as (select k, s, case when y <> '' then y::int when regexp_matches(s, '^[+-]?\\d+$') then s::int end as y from x) select k, case when lower(s) not in ('n/a', 'na', 'none', 'nv', 'non-vintage', 'nonvintage', '-', '') and y between 1900 and 2025 then y end as year from v""")
def vintage_year(spark, folder):
    orders = table(spark, folder, "orders").select((100 + F.col("o_orderkey")).alias("k"), F.concat(F.lit("Vintage "), F.year("o_orderdate")).alias("s"))
    return listed(spark, VINTAGES).unionByName(orders).select("k", N.vintage_year(F.col("s"), 2025).alias("year"))


@query("fingerprints", """with a as (select p_partkey, lower(trim(case when p_partkey % 9 = 0 then '' else p_name end)) as n, lower(trim(p_brand)) as b, case p_partkey % 3 when 0 then 'whiskey' when 1 then 'port_wine' else 'gin' end as t, p_size as v, lower(p_type) as d from part)
select p_partkey, case when n <> '' then substr(sha256(n || '|' || b), 1, 32) end as matcher, sha256('{"brand": "' || b || '", "name": "' || n || '", "type": "skeleton"}') as skeleton,
 sha256(case t when 'whiskey' then '{"abv": null, "age_statement": null, "brand": "' || b || '", "distillery": "' || d || '", "name": "' || n || '", "product_type": "whiskey", "volume_ml": ' || v || '}'
  when 'port_wine' then '{"abv": null, "brand": "' || b || '", "harvest_year": ' || v || ', "name": "' || n || '", "product_type": "port_wine", "style": "' || d || '", "volume_ml": ' || v || '}'
  else '{"abv": null, "brand": "' || b || '", "name": "' || n || '", "product_type": "gin", "volume_ml": ' || v || '}' end) as product from a""")
def fingerprints(spark, folder):
    """The matcher's, the skeletons' and the products' fingerprints; they never agree with one another."""
    name = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "whiskey").when(F.col("p_partkey") % 3 == 1, "port_wine").otherwise("gin")
    size, style = F.col("p_size"), F.concat(F.lit('"'), F.lower("p_type"), F.lit('"'))
    details = {"whiskey": {"age_statement": F.lit("null"), "distillery": style}, "port_wine": {"harvest_year": size.cast("string"), "style": style}}
    none = F.lit(None).cast("double")
    return table(spark, folder, "part").select(
        "p_partkey", N.name_fingerprint(name, F.col("p_brand")).alias("matcher"), N.skeleton_fingerprint(name, F.col("p_brand")).alias("skeleton"),
        N.product_fingerprint(kind, name, F.col("p_brand"), size, none, details).alias("product"),
    )


@query("truncate_text", """with h as (select doc_id, coalesce(text, '') as t, substr(coalesce(text, ''), 1, 400 - 24) as h, substr(coalesce(text, ''), 1, 200 - 24) as g from documents),
e as (select *, [x for x in list_transform(['. ', '! ', '? ', '.' || chr(10), '!' || chr(10), '?' || chr(10)], lambda m: case when strpos(h, m) > 0 then length(h) - strpos(reverse(h), reverse(m)) - 1 else -1 end)] as ends, case when strpos(g, '>') > 0 then length(g) - strpos(reverse(g), '>') else -1 end as tag from h)
select doc_id, case when length(t) // 4 > 100 then regexp_replace(case when list_max(ends) > 188 then substr(h, 1, list_max(ends) + 1) else h end, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) || '[Content truncated...]' else t end as text,
 case when length(t) // 2 > 100 then case when tag > 88 then substr(g, 1, tag + 1) else g end || chr(10) || chr(10) || '[Content truncated...]' else t end as html from e""")
def truncate_text(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return table(spark, folder, "documents").select("doc_id", N.truncated(text, 100).alias("text"), N.truncated(text, 100, True).alias("html"))


PRICES = ["$45.99", "€1.234,56", "EUR 45,99", "free", "1,299", "¥5000", ""]


@query("plain_price", f"with a as (select p_partkey, {pick_sql(PRICES)} as s from part) select p_partkey, try_cast(nullif(regexp_extract(translate(s, '£€$¥₹,', ''), '(\\d+\\.?\\d*)', 1), '') as double) as price from a")
def plain_price(spark, folder):
    return table(spark, folder, "part").select("p_partkey", N.plain_price(pick(PRICES)).alias("price"))


@query("product_queries", """with a as (select p_partkey, case when p_partkey % 7 > 0 then p_name end as n, case when p_partkey % 5 > 0 then p_brand else ' ' end as b from part)
select p_partkey, coalesce('"' || n || '" ', '') || coalesce(nullif(trim(b), '') || ' ', '') || 'buy price' as price, coalesce('"' || n || '" ', '') || 'review tasting notes rating' as review, coalesce(n || ' ', '') || coalesce(nullif(trim(b), '') || ' ', '') || 'bottle whisky' as image, coalesce('"' || n || '" ', '') || 'whisky news' as news from a""")
def product_queries(spark, folder):
    name, brand = F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")), F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")).otherwise(" ")
    return table(spark, folder, "part").select("p_partkey", N.product_queries(name, brand).alias("q")).select("p_partkey", "q.*")


@query("value_text", """select l_orderkey, '[' || string_agg('"' || l_returnflag || '"', ', ' order by l_linenumber, l_partkey, l_suppkey, l_returnflag) || ']' as flags, case when bool_or(l_linestatus = 'F') then 'True' else 'False' end as open, max(l_linenumber)::varchar as lines, '' as nothing from lineitem group by 1""")
def value_text(spark, folder):
    lists = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("f"), F.bool_or(F.col("l_linestatus") == "F").alias("o"), F.max("l_linenumber").alias("n")
    )
    flags = F.transform("f", lambda s: s["l_returnflag"])
    return lists.select("l_orderkey", N.as_text(flags, "array").alias("flags"), N.as_text(F.col("o"), "boolean").alias("open"), N.as_text(F.col("n"), "number").alias("lines"), N.as_text(F.lit(None).cast("array<string>"), "array").alias("nothing"))


RESULT_HOSTS = [
    "ardbeg.com", "amazon.com", "whisky.com", "glenoak.example", "drizly.com", "example.org", "m.facebook.com", "whiskybase.com", "shop.oak-isle.net", "wine-searcher.com", "quora.com", "masterofmalt.com", "decanter.com",
]
SOUGHT = ["Ardbeg Ten", "Oak Isle 12", "Glen", "Whisky Sour Mix", "Example Malt"]
SNIPPETS = ["Best review of the top ten", "our distillery", "tasting score", "", "visit us at home"]
HEADS = ["Welcome to us", "Shop", "Official", "Prices", "Reviews"]
_R = f"p as (select page_id, page_id // 20 as q, row_number() over (partition by page_id // 20 order by page_id) as pos, {pick_sql(RESULT_HOSTS, 'page_id')} as d, {pick_sql(SOUGHT, 'page_id', 20)} as name, {pick_sql(SNIPPETS, 'page_id', 2)} as snippet, {pick_sql(HEADS, 'page_id', 3)} as title from pages)"


def _results(spark, folder):
    from millrace.operators.matching import ranked

    rows = table(spark, folder, "pages").select(
        "page_id", F.floor(F.col("page_id") / 20).alias("query_id"), U.host(F.concat(F.lit("https://www."), pick(RESULT_HOSTS, "page_id"), F.lit("/x"))).alias("d"), pick(SOUGHT, "page_id", 20).alias("name"),
        pick(SNIPPETS, "page_id", 2).alias("snippet"), pick(HEADS, "page_id", 3).alias("title"),
    )
    return ranked(rows, ["query_id"], ["page_id"]).withColumnRenamed("rank", "pos")


@query("serp_rank", f"""with {_R}, s as (select *, case when {any_sql('d', K.OFFICIAL_HOSTS)} then 0 when contains(d, string_split(lower(name), ' ')[1]) or coalesce(contains(d, string_split(lower(name), ' ')[2]), false) then 5 when list_contains([{', '.join(map(quoted, K.TRUSTED_HOSTS))}], d) then 9 + list_position([{', '.join(map(quoted, K.TRUSTED_HOSTS))}], d) else 50 end as prio from p where not {any_sql('d', K.SKIPPED_RESULTS)}),
r as (select *, row_number() over (partition by q order by prio, pos) as rank from s) select q as query_id, page_id, rank::int as rank, prio::int as priority from r where rank <= 10""")
def serp_rank(spark, folder):
    """Twenty results of a search for a product: own hosts, named ones, trusted shops, others; the first ten."""
    from millrace.operators.matching import ranked

    scored = _results(spark, folder).withColumn("priority", K.result_priority(F.col("d"), F.col("name"))).filter("priority is not null")
    return ranked(scored, ["query_id"], ["priority", "pos"], 10).select("query_id", "page_id", "rank", "priority")


@query("official_site", f"""with {_R}, k as (select *, contains(translate(d, '-.', ''), translate(lower(name), ' ' || chr(39), '')) or regexp_matches(lower(title), 'official|home|welcome to') or regexp_matches(lower(snippet), 'official|our distillery|our whisky|visit us') as ok from p where not {any_sql('d', K.NEVER_OFFICIAL)})
select q as query_id, arg_min(page_id, case when ok then pos else 1000 + pos end) as page_id from k where ok or pos <= 3 group by 1""")
def official_site(spark, folder):
    """The first result that looks official, else the first of the top three that may be."""
    usable = _results(spark, folder).filter(K.may_be_official(F.col("d"))).withColumn("ok", K.looks_official(F.col("d"), F.col("title"), F.col("snippet"), F.col("name")))
    usable = usable.filter(F.col("ok") | (F.col("pos") <= 3))
    return usable.groupBy("query_id").agg(F.min_by("page_id", F.when(F.col("ok"), F.col("pos")).otherwise(1000 + F.col("pos"))).alias("page_id"))


@query("target_priority", f"""with {_R}, s as (select *, 50 + 30 * {any_sql('d', K.PRIORITY_HOSTS)}::int + greatest(0, 20 - 2 * pos) + 5 * ({' + '.join(f"contains(lower(snippet), {quoted(w)})::int" for w in K.TARGET_WORDS)}) as priority from p where not {any_sql('d', K.EXCLUDED_HOSTS)}),
r as (select *, row_number() over (partition by q order by priority desc, pos) as rank from s) select q as query_id, page_id, priority::int as priority, rank::int as rank from r where rank <= 10""")
def target_priority(spark, folder):
    """Targets of a search by host, position and words; the best ten."""
    from millrace.operators.matching import ranked

    scored = _results(spark, folder).withColumn("priority", K.target_score(F.col("d"), F.col("pos"), F.col("snippet")).cast("int")).filter("priority is not null")
    return ranked(scored, ["query_id"], [F.desc("priority"), "pos"], 10).select("query_id", "page_id", "priority", "rank")


@query("domain_filter", f"with {_R} select page_id, {any_sql('d', K.PRIORITY_HOSTS)} as trusted, {any_sql('d', K.EXCLUDED_HOSTS)} as excluded, regexp_matches(url, '(?i)(?:/en/|\\d{{3}})') as wanted from p join pages using (page_id)")
def domain_filter(spark, folder):
    """Whether a host has any of the listed parts, and a URL any of the patterns that compile."""
    from millrace.sources.web import allowed

    rows = _results(spark, folder).join(table(spark, folder, "pages").select("page_id", "url"), "page_id")
    has = lambda hosts: K.contains_any(F.lower("d"), hosts)
    return rows.select("page_id", has(K.PRIORITY_HOSTS).alias("trusted"), has(K.EXCLUDED_HOSTS).alias("excluded"), allowed(F.col("url"), ["/en/", "(", r"\d{3}"]).alias("wanted"))
