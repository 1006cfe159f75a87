"""Matching and ranking queries: part names in the role of products, pages in that of search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fuzzy
from millrace.functions import names as N
from millrace.operators import matching as M
from millrace.registry import query
from millrace.sources.tables import table

_STOP = ", ".join(f"'{w}'" for w in (*M.STOPWORDS, *M.CATEGORY_WORDS))


def _telling(c: str) -> str:
    return f"list_distinct([w for w in string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[''’]s?\\b', '', 'g'), '[^\\w]+') if length(w) >= 3 and w not in ({_STOP})])"


def _brand(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(translate(lower(trim(coalesce({c}, ''))), '''’‘`', ''), '-', ' '), '\\s+', ' ', 'g'), '^the ', ''))"


def _any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


#: (brand, name, text) of a target and of what was extracted.
CASES = [
    ("Macallan", "The Macallan 12 Year", "sherry single malt", "The Macallan", "Macallan 12 Years Old Sherry Oak", "whisky"),
    ("Ballantine's", "Ballantine's 10 Blended", "scotch", "Ballantines", "Ballantine 10 Year", ""),
    ("Johnnie-Walker", "Black Label", "", "Johnnie Walker", "Blue Label", ""),
    ("", "Frank August Bourbon", "bourbon", "Frank August", "Frank August Rye", "straight rye"),
    ("Taylor", "Taylor Vintage Port", "vintage", "Taylor", "Taylor LBV", "lbv"),
    ("A", "Alpha Beta Gamma Delta", "", "B", "Alpha", ""),
    ("A", "Alpha Beta Gamma Delta", "", "A", "Alpha Zeta Theta Kappa", ""),
    (None, None, "", None, "Old Single Malt", ""),
    ("Tawny House", "Tawny 10", "tawny", "Tawny House", "Ruby 10", "ruby port"),
]


def _cases_sql() -> str:
    value = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    return "c(k, ab, an, atx, bb, bn, btx) as (values " + ", ".join(f"({i}, {', '.join(map(value, row))})" for i, row in enumerate(CASES)) + ")"


def _validate_sql() -> str:
    clash = " or ".join(f"({_any('lower(atx)', a)} and {_any('lower(btx)', b)}) or ({_any('lower(atx)', b)} and {_any('lower(btx)', a)})" for a, b in M.EXCLUSIVE)
    return f"""with {_cases_sql()}, k as (select *, {_brand('ab')} as x, {_brand('bb')} as y, {_telling('an')} as tw, {_telling('bn')} as ew from c)
select k, case when not (x = '' or y = '' or contains(x, y) or contains(y, x)) then 'brand_mismatch' when {clash} then 'product_type_mismatch'
 when len(tw) > 0 and len(ew) > 0 and len(list_intersect(tw, ew)) / greatest(len(tw), len(ew)) < 0.3 then 'name_mismatch' else 'product_match_validated' end as verdict from k"""


@query("match_validate", _validate_sql())
def match_validate(spark, folder):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(CASES)], "k bigint, ab string, an string, atx string, bb string, bn string, btx string")
    return rows.select("k", M.validation(*(F.col(c) for c in ("ab", "bb", "atx", "btx", "an", "bn"))).alias("verdict"))


_PLAIN_V2 = "lower(trim(coalesce({0}, '')))"
_CLASH_V2 = " or ".join(f"(contains(m, '{p}') and contains(n, '{q}') and not contains(n, '{p}'))" for one, other in M.EXCLUSIVE_V2 for p, q in ((one, other), (other, one)))
_TOKENS_V2 = "list_distinct([w for w in regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+') if length(w) > 2 and w not in ('the', 'a', 'an', 'and', 'of', 'for', 'with', 'by', 'from')])"
SAID = ["Bourbon 10 Year", "Rye 20 Year", "Single Malt 12 Year", "Blended 18 Year", "Irish Scotch", "Ruby Vintage", "Tawny LBV", ""]
_SAID = "([" + ", ".join(f"'{x}'" for x in SAID) + "])"


@query("match_validate_v2", f"""with {_cases_sql()}, p as (select -1 - k as k, ab, an, bb, bn from c union all select p_partkey, p_brand, p_name || ' ' || {_SAID}[p_partkey % 8 + 1], case p_partkey % 4 when 0 then upper(p_brand) || ' Co' when 1 then '' when 2 then p_brand else 'Other' end,
 case when p_partkey % 9 = 0 then '' else case when p_partkey % 5 = 0 then p_type else p_name end || ' ' || {_SAID}[p_partkey // 8 % 8 + 1] end from part),
x as (select k, {_PLAIN_V2.format('ab')} as x, {_PLAIN_V2.format('bb')} as y, {_PLAIN_V2.format('an')} as m, {_PLAIN_V2.format('bn')} as n from p), t as (select *, {_TOKENS_V2.format('m')} as tw, {_TOKENS_V2.format('n')} as ew from x)
select k, case when n = '' then 'no_name_extracted' when x <> '' and y <> '' and not contains(y, x) and not contains(x, y) then 'brand_mismatch' when {_CLASH_V2} then 'product_type_mismatch' when len(tw) > 0 and len(ew) > 0 and len(list_intersect(tw, ew)) / least(len(tw), len(ew)) < 0.3 then 'name_mismatch' else 'match' end as verdict from t""")
def match_validate_v2(spark, folder):
    """The second validator, by its own words, over parts and what is said of them in turn."""
    said = lambda step: F.element_at(F.array(*map(F.lit, SAID)), (F.floor(F.col("p_partkey") / step) % 8 + 1).cast("int"))
    key = F.col("p_partkey")
    brand = F.when(key % 4 == 0, F.concat(F.upper("p_brand"), F.lit(" Co"))).when(key % 4 == 1, "").when(key % 4 == 2, F.col("p_brand")).otherwise("Other")
    other = F.when(key % 9 == 0, "").otherwise(F.concat(F.when(key % 5 == 0, F.col("p_type")).otherwise(F.col("p_name")), F.lit(" "), said(8)))
    parts = table(spark, folder, "part").select(key.alias("k"), F.col("p_brand").alias("ab"), F.concat("p_name", F.lit(" "), said(1)).alias("an"), brand.alias("bb"), other.alias("bn"))
    cases = spark.createDataFrame([(-1 - i, ab, an, bb, bn) for i, (ab, an, _, bb, bn, _) in enumerate(CASES)], "k bigint, ab string, an string, bb string, bn string")
    rows = cases.unionByName(parts)
    return rows.select("k", M.validation_v2(*(F.col(c) for c in ("ab", "bb", "an", "bn"))).alias("verdict"))


_WORDS = lambda c: f"list_distinct([w for w in string_split_regex(lower(trim({c})), '\\s+') if w <> ''])"
_JACCARD = lambda a, b: f"coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"


@query("jaccard_name", f"""with n as (select distinct p_name from part), w as (select p_name, {_WORDS('p_name')} as ws from n), p as (select a.p_name as a, b.p_name as b, a.ws as x, b.ws as y from w a join w b on split_part(lower(a.p_name), ' ', 1) = split_part(lower(b.p_name), ' ', 1) and a.p_name < b.p_name)
select a, b, round({_JACCARD('x', 'y')}, 6)::double as similarity from p""")
def jaccard_name(spark, folder):
    """Pairs of different names with one first word, and the share of their words that they have in common."""
    names = table(spark, folder, "part").select("p_name").distinct().withColumn("ws", fuzzy.words(F.col("p_name"))).withColumn("block", F.element_at("ws", 1))
    a, b = (names.select(F.col("p_name").alias(n), F.col("ws").alias(f"{n}_ws"), "block") for n in ("a", "b"))
    return a.join(b, "block").filter("a < b").select("a", "b", F.round(fuzzy.jaccard(F.col("a_ws"), F.col("b_ws")), 6).alias("similarity"))


@query("product_matcher", f"""with a as (select *, split_part(p_type, ' ', 1) as kind from part), c as (select p_partkey as probe_id, p_name as name, case when p_partkey % 10 = 0 then '' else lower(p_brand) end as brand, kind, [w for w in [regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g') for w in string_split_regex(lower(p_name), '\\s+')] if w <> '' and w not in ('the', 'a', 'an', 'le', 'la', 'el', 'los', 'las')][1] as word from a where p_partkey % 2 = 0),
r as (select probe_id, p_partkey as product_id, name, p_name, brand, lower(p_brand) as p_brand, row_number() over (partition by probe_id order by p_partkey desc) as rn from c join a on p_partkey % 2 = 1 and a.kind = c.kind and (brand = '' or lower(p_brand) = brand) and contains(lower(p_name), word) and length(word) >= 3),
s as (select probe_id, product_id, rn, 0.7::double + case when brand = p_brand then 0.15::double else 0.0::double end + {_JACCARD(_WORDS('name'), _WORDS('p_name'))} * 0.15::double as confidence from r where rn <= 10),
k as (select *, row_number() over (partition by probe_id order by confidence desc, rn) as k from s where confidence >= 0.85)
select probe_id, product_id, confidence from k where k = 1""")
def product_matcher(spark, folder):
    """Even keys look for their match among odd ones of their kind and brand; a tenth have no brand."""
    parts = table(spark, folder, "part").withColumn("kind", F.element_at(F.split("p_type", " "), 1))
    brand = F.when(F.col("p_partkey") % 10 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    probes = parts.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("probe_id"), F.col("p_name").alias("name"), brand.alias("brand"), "kind")
    products = parts.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "kind", F.col("p_partkey").alias("discovered"))
    return M.block_matches(probes, products)


_EXACT = """p as (select p_partkey, case when p_partkey % 3 = 0 then '00-' || (p_partkey // 6) when p_partkey % 3 = 1 then '00 ' || (p_partkey // 6) end as gtin, sha256(p_name || p_size) as fp from part),
g as (select translate(gtin, ' -', '') as k, arg_max(p_partkey, p_partkey) as id from p where p_partkey % 4 < 2 and gtin is not null group by 1), f as (select fp as k, max(p_partkey) as id from p where p_partkey % 4 < 2 group by 1)"""


@query("match_exact", f"""with {_EXACT}
select p_partkey as probe_id, coalesce(g.id, f.id) as product_id, case when g.id is not null then 'gtin' when f.id is not null then 'fingerprint' else 'new' end as method, case when g.id is not null then 1.0 when f.id is not null then 0.95 else 0.0 end::double as confidence
from p left join g on g.k = translate(p.gtin, ' -', '') left join f on f.k = p.fp where p_partkey % 4 >= 2""")
def match_exact(spark, folder):
    key = F.floor(F.col("p_partkey") / 6).cast("string")
    gtin = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("00-"), key)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("00 "), key))
    rows = table(spark, folder, "part").select("p_partkey", gtin.alias("gtin"), F.sha2(F.concat("p_name", F.col("p_size").cast("string")), 256).alias("fingerprint"))
    products = rows.filter("p_partkey % 4 < 2").withColumnRenamed("p_partkey", "product_id").withColumn("discovered", F.col("product_id"))
    return M.cascade(rows.filter("p_partkey % 4 >= 2").withColumnRenamed("p_partkey", "probe_id"), products)


TAILS = ["", " Sherry Cask", " Limited Edition", " 10yo", " Cask Strength"]


def candidates(spark, folder):
    """(probes, products): every twentieth part is said again under a name of its own, some with a code or a print."""
    key = F.col("p_partkey")
    parts = table(spark, folder, "part").withColumn("kind", F.element_at(F.split("p_type", " "), 1)).withColumn("abv", F.col("p_size").cast("double"))
    print_of = F.sha2(F.concat("p_name", F.col("p_size").cast("string")), 256)
    products = parts.filter("p_partkey % 20 <> 7").select(key.alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), "abv", "kind", key.alias("discovered"), F.concat(F.lit("00"), key).alias("gtin"), print_of.alias("fingerprint"))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.floor(key / 20) % len(TAILS) + 1).cast("int"))
    probes = parts.filter("p_partkey % 20 = 7").select(
        key.alias("probe_id"), F.concat(F.upper("p_name"), tail).alias("name"), F.when(key % 120 == 7, "").otherwise(F.col("p_brand")).alias("brand"), "abv", "kind",
        F.when(key % 60 == 7, F.concat(F.lit("0-0 "), key - 1)).alias("gtin"), F.when(key % 60 == 27, print_of).alias("fingerprint"),
    )
    return probes, products


@query("match_pipeline")
def match_pipeline(spark, folder):
    """The whole pipeline: code, print, fuzzy name, variant, and what becomes of each candidate."""
    return M.resolve(*candidates(spark, folder))


@query("dedup_cascade")
def dedup_cascade(spark, folder):
    """The deduplication cascade, with its bands for review."""
    found = M.deduplicate(*candidates(spark, folder))
    return found.withColumn("confidence", F.round("confidence", 6))


@query("fuzzy_match")
def fuzzy_match(spark, folder):
    """The fuzzy stage alone: the best accepted of the hundred newest products of a brand and kind."""
    probes, products = candidates(spark, folder)
    found = M.fuzzy_matches(probes, products)
    return found.select("probe_id", "product_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"))


@query("source_similarity")
def source_similarity(spark, folder):
    """How alike the names of parts and of what was said of them are, kinds and years left out."""
    probes, products = candidates(spark, folder)
    pairs = probes.join(products.select((F.col("product_id") + 1).alias("probe_id"), F.col("name").alias("other")), "probe_id")
    return pairs.select("probe_id", F.round(fuzzy.source_similarity(F.col("name"), F.col("other")), 6).alias("similarity"))


_NAME = "trim(regexp_replace(regexp_replace(lower(trim({0})), '^the\\s+', ''), '\\s+', ' ', 'g'))"
_VARIANT = " ".join(f"when {' or '.join(f'(contains(a, {chr(39)}{w}{chr(39)}) and not contains(b, {chr(39)}{w}{chr(39)}))' for w in words)} then '{kind}'" for kind, words in M.VARIANTS.items())


@query("variant_detect", f"""with p as (select p_name, min(p_partkey) as id from part group by 1), n as (select id, p_name as x, p_name || case id % 4 when 0 then ' Sherry Cask' when 1 then ' Cask Strength' when 2 then ' Limited Edition' else '' end as y from p),
k as (select id, {_NAME.format('y')} as a, {_NAME.format('x')} as b, round_even(200.0 * length(x) / (length(x) + length(y)), 0) as ratio from n) select id, case when ratio <= 95 then case {_VARIANT} end end as variant_type from k""")
def variant_detect(spark, folder):
    """Variants of part names made by adding a finish or edition; the rest of the names are no variants."""
    parts = table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    tail = F.when(F.col("id") % 4 == 0, " Sherry Cask").when(F.col("id") % 4 == 1, " Cask Strength").when(F.col("id") % 4 == 2, " Limited Edition").otherwise("")
    rows = parts.withColumn("candidate", F.concat("p_name", tail)).withColumn("s", fuzzy.name_scores(F.lower("candidate"), F.lower("p_name")))
    return rows.select("id", M.variant_type(F.col("candidate"), F.col("p_name"), F.col("s.ratio")).alias("variant_type"))


@query("skeleton_match")
def skeleton_match(spark, folder):
    """Greedy one-to-one pairs of crawled names and skeletons, whatever their brands, by the best ratio from 85 on."""
    names = table(spark, folder, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id")).withColumn("n", N.skeleton_name(F.concat("p_brand", F.lit(" "), "p_name")))
    probes = names.filter("id % 20 = 0").select(F.col("n").alias("a"), F.col("id").alias("probe_id"))
    others = names.filter("id % 20 <> 0").select(F.col("n").alias("b"), F.col("id").alias("candidate_id"))
    pairs = M.rare_word_pairs(probes, others).join(probes, "probe_id").join(others, "candidate_id")
    scored = M.spread(pairs).withColumn("s", fuzzy.name_scores("a", "b"))
    scored = scored.withColumn("score", F.greatest("s.ratio", "s.partial", "s.token_sort", "s.token_set")).filter("score >= 85")
    return M.greedy_pairs(scored.select(F.col("probe_id").alias("probe_order"), "probe_id", "candidate_id", "score"))


@query("best_page_match", f"""with t as (select p_partkey, p_name, p_brand, p_type, {_WORDS('p_name')} as ws from part), q as (select a.p_partkey as target, b.p_partkey as found, a.ws as x, b.ws as y, a.p_brand = b.p_brand as sb, a.p_type = b.p_type as sc from t a join t b on b.p_partkey // 8 = a.p_partkey // 8 and b.p_partkey <> a.p_partkey),
s as (select *, 50.0::double * len(list_intersect(x, y)) / len(x) + case when sb then 30 else 0 end + case when sc then 20 else -40 end as score from q), r as (select *, row_number() over (partition by target order by score desc, found) as k from s where score >= 10)
select target, found, round(score, 4) as score from r where k = 1""")
def best_page_match(spark, folder):
    """Eight neighbouring parts make a page: the one that fits each target best, if any does."""
    parts = table(spark, folder, "part").withColumn("ws", fuzzy.words(F.col("p_name"))).withColumn("page", F.floor(F.col("p_partkey") / 8))
    a = parts.select("page", F.col("p_partkey").alias("target"), F.col("ws").alias("x"), F.col("p_brand").alias("ab"), F.col("p_type").alias("at"))
    b = parts.select("page", F.col("p_partkey").alias("found"), F.col("ws").alias("y"), F.col("p_brand").alias("bb"), F.col("p_type").alias("bt"))
    scored = a.join(b, "page").filter("target <> found").withColumn("score", M.page_score(F.col("x"), F.col("y"), F.col("ab") == F.col("bb"), F.lit(False), F.col("at") == F.col("bt"))).filter("score is not null")
    return M.ranked(scored, ["target"], [F.desc("score"), "found"], 1).select("target", "found", F.round("score", 4).alias("score"))


@query("brand_resolve", """with r as (select p_partkey, coalesce(nullif(trim(case when p_partkey % 3 = 0 then '' else p_brand end), ''), regexp_replace(nullif(trim(case when p_partkey % 5 > 0 then p_type || ' Distillery' end), ''), ' Distillery$', ''), 'none') as brand from part)
select p_partkey, brand, trim(regexp_replace(lower(brand), '[^a-z0-9]+', '-', 'g'), '-') as slug from r""")
def brand_resolve(spark, folder):
    """Brand, else distillery without that word, else a default; with its slug."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    brand = blank(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand")))
    distillery = F.regexp_replace(blank(F.when(F.col("p_partkey") % 5 > 0, F.concat("p_type", F.lit(" Distillery")))), " Distillery$", "")
    found = table(spark, folder, "part").select("p_partkey", F.coalesce(brand, distillery, F.lit("none")).alias("brand"))
    return found.withColumn("slug", F.trim(F.regexp_replace(F.lower("brand"), "[^a-z0-9]+", "-"), F.lit("-")))


@query("url_union_topk", """with a as (select url, 0 as q, row_number() over (order by page_id) as pos from pages where page_id % 2 = 0), b as (select url, 1 as q, row_number() over (order by page_id desc) as pos from pages where page_id % 3 = 0),
u as (select *, row_number() over (partition by url order by q, pos) as k from (select * from a union all select * from b)) select url from u where k = 1 order by q, pos limit 10""")
def url_union_topk(spark, folder):
    """Results of two searches, first places kept, without repetitions; the first ten."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    both = pages.filter("page_id % 2 = 0").select("url", F.struct(F.lit(0).alias("q"), F.col("page_id").alias("pos")).alias("at"))
    both = both.unionByName(pages.filter("page_id % 3 = 0").select("url", F.struct(F.lit(1).alias("q"), (-F.col("page_id")).alias("pos")).alias("at")))
    return both.groupBy("url").agg(F.min("at").alias("at")).orderBy("at").limit(10).select("url")


@query("sitemap_priority", "select page_id, url from pages order by coalesce(case when page_id % 4 > 0 then page_id % 30 end, 0) desc, coalesce(case when page_id % 3 > 0 then page_id % 10 end, 0) desc, page_id limit 40")
def sitemap_priority(spark, folder):
    """Newest first, then by priority; what is unknown counts as 0."""
    modified = F.coalesce(F.when(F.col("page_id") % 4 > 0, F.col("page_id") % 30), F.lit(0))
    priority = F.coalesce(F.when(F.col("page_id") % 3 > 0, F.col("page_id") % 10), F.lit(0))
    return table(spark, folder, "pages").orderBy(modified.desc(), priority.desc(), "page_id").limit(40).select("page_id", "url")
