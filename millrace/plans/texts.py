"""URL, text and page queries over pages, documents and part, and over lists of crafted strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import texts as T
from millrace.functions import urls as U
from millrace.operators.monitoring import latest
from millrace.operators.matching import known_by_first_word
from millrace.registry import query
from millrace.sources.tables import table

PARTS = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def listed(spark: SparkSession, strings: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(strings)), "k bigint, s string")


def listed_sql(strings: list[str | None]) -> str:
    rows = ", ".join(f"({i}, {'null' if s is None else chr(39) + s.replace(chr(39), chr(39) * 2) + chr(39)})" for i, s in enumerate(strings))
    return f"t(k, s) as (values {rows})"


def canonical_sql(url: str) -> str:
    part = lambda k: f"coalesce(regexp_extract({url}, {PARTS}, {k}), '')"
    tracking = ", ".join(f"'{x}'" for x in U.TRACKING)
    return f"""case when {url} is null then '' else
    case when {part(1)} <> '' then lower({part(1)}) || '://' else '' end || regexp_replace(lower({part(2)}), '^www\\.', '') || rtrim({part(3)}, '/') ||
    coalesce('?' || nullif(array_to_string([x[3] for x in list_sort([[split_part(p, '=', 1), lpad(i::varchar, 6, '0'), case when contains(p, '=') then p else p || '=' end] for p, i in string_split({part(4)}, '&')
      if p <> '' and lower(split_part(p, '=', 1)) not in ({tracking})])], '&'), ''), '') end"""


URLS = [
    None, "", "https://WWW.Example.com/page/?utm_source=test&b=2&a=1#section", "http://a.com", "http://a.com/", "HTTP://A.com/X//?REF=1", "https://a.com/p?b=1&a=&a=2&c",
    "https://www.www.a.com/?source=x", "/relative/path/?x=1", "https://a.com/?a=%20b&fbclid=9", "https://a.com?z=1&&y=2",
]


@query("url_canonical", f"select page_id, {canonical_sql('url')} as canonical from pages")
def url_canonical(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("url_canonical_cases", f"with {listed_sql(URLS)} select k, {canonical_sql('s')} as canonical from t")
def url_canonical_cases(spark, folder):
    return listed(spark, URLS).select("k", U.canonical(F.col("s")).alias("canonical"))


@query("url_domain", f"select page_id, regexp_replace(lower(regexp_extract(url, {PARTS}, 2)), '^www\\.', '') as domain, replace(lower(regexp_extract(url, {PARTS}, 2)), 'www.', '') as domain_anywhere from pages")
def url_domain(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.host(F.col("url")).alias("domain"), U.host_anywhere(F.col("url")).alias("domain_anywhere"))


@query("frontier_hash", "select page_id, sha256(rtrim(lower(trim(url)), '/')) as url_hash, sha256(url) as raw_hash from pages")
def frontier_hash(spark, folder):
    return table(spark, folder, "pages").select("page_id", U.frontier_hash(F.col("url")).alias("url_hash"), F.sha2("url", 256).alias("raw_hash"))


@query("url_dedup_first", f"select min(page_id) as page_id, canonical from (select page_id, {canonical_sql('url')} as canonical from pages) group by canonical")
def url_dedup_first(spark, folder):
    found = table(spark, folder, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))
    return found.groupBy("canonical").agg(F.min("page_id").alias("page_id"))


HASH_SQL = "case when coalesce(text, '') = '' then '' else sha256(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) end"


@query("content_dedup", f"select min(doc_id) as doc_id, h as content_hash, count(*) as copies from (select doc_id, {HASH_SQL} as h from documents) group by h")
def content_dedup(spark, folder):
    """One row for each content, its first document kept."""
    found = table(spark, folder, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return found.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "dedup_check_all",
    f"""with p as (select page_id, {canonical_sql('url')} as u, sha256(html) as c, p_name, case when page_id % 5 > 0 then p_brand end as p_brand from pages left join part on p_partkey = page_id % 100),
old as (select * from p where page_id % 3 = 0), new as (select * from p where page_id % 3 > 0)
select page_id, case when u in (select u from old) then 'url' when c in (select c from old) then 'content' when exists (select 1 from old where contains(lower(old.p_name), lower(string_split(new.p_name, ' ')[1])) and (new.p_brand is null or lower(old.p_brand) = lower(new.p_brand))) then 'product' end as duplicate_type from new""",
)
def dedup_check_all(spark, folder):
    """The first of URL, content and product by which a new page is known already; each test is an existence join.

    A product is known by its brand, if one is given, and its name's first word.
    """
    pages = table(spark, folder, "pages").join(table(spark, folder, "part"), F.col("p_partkey") == F.col("page_id") % 100, "left")
    rows = pages.select("page_id", U.canonical(F.col("url")).alias("u"), F.sha2("html", 256).alias("c"), F.col("p_name").alias("name"), F.when(F.col("page_id") % 5 > 0, F.col("p_brand")).alias("brand"))
    old, new = rows.filter("page_id % 3 = 0"), rows.filter("page_id % 3 > 0")
    product = known_by_first_word(new.select(F.col("page_id").alias("probe_id"), "name", "brand"), old.select("name", "brand")).select(F.col("probe_id").alias("page_id"), F.lit(True).alias("by_product"))
    for column, mark in (("u", "by_url"), ("c", "by_content")):
        new = new.join(old.select(column).distinct().withColumn(mark, F.lit(True)), column, "left")
    kind = F.when(F.col("by_url"), "url").when(F.col("by_content"), "content").when(F.col("by_product"), "product")
    return new.join(product, "page_id", "left").select("page_id", kind.alias("duplicate_type"))


NAMES = ["Lagavulin™ 16 Year  Single Malt Whisky", "Château d'Été®", "  The   Macallan 12 whisky ", "GIN rum", "", None, "Rum", "whisky-whiskey brandy", "Port & Wine!"]


@query(
    "name_norm",
    f"""with {listed_sql(NAMES)}, a as (select k, coalesce(s, '') as s from t union all select 1000 + p_partkey, p_name || case p_partkey % 3 when 0 then ' Whisky' when 1 then ' Rum ' else ' Single Malt' end from part),
b as (select k, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(translate(s, '™®©', '')), '[^\\x00-\\x7F]', '', 'g')), '[^\\w\\s-]', '', 'g'), '\\s+', ' ', 'g') as s from a)
select k, trim({"".join("regexp_replace(" for _ in T.SPIRIT_ENDINGS)}s{"".join(f", '\\b{w}\\b\\s*$', '')" for w in T.SPIRIT_ENDINGS)}) as name_key from b""",
)
def name_norm(spark, folder):
    tail = F.when(F.col("p_partkey") % 3 == 0, " Whisky").when(F.col("p_partkey") % 3 == 1, " Rum ").otherwise(" Single Malt")
    parts = table(spark, folder, "part").select((1000 + F.col("p_partkey")).alias("k"), F.concat("p_name", tail).alias("s"))
    return listed(spark, NAMES).unionByName(parts).select("k", T.name_key(F.col("s")).alias("name_key"))


@query("token_estimate", "select doc_id, length(text) // 4 as tokens, length(text) // 2 as structured_tokens from documents")
def token_estimate(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.token_estimate(F.col("text"), True).alias("structured_tokens"))


PRICES = ["$89.99", "£75.00", "€85,00", "$1,299.99", "€1.234,56", "€45,99", "12", "free", "", "£1,000", "$.50", "1.2.3", "EUR 5"]


@query(
    "price_parse",
    f"""with {listed_sql(PRICES)}, c as (select k, s, case when contains(s, '$') then 'USD' when contains(s, '£') then 'GBP' when contains(s, '€') then 'EUR' else 'USD' end as currency, regexp_extract(s, '([\\d,.]+)', 1) as n from t),
d as (select k, currency, case when currency = 'EUR' and contains(n, ',') and not contains(n, '.') then replace(n, ',', '.') else replace(n, ',', '') end as n from c)
select k, currency, coalesce(try_cast(n as double), 0) as price from d""",
)
def price_parse(spark, folder):
    return listed(spark, PRICES).select("k", T.currency(F.col("s")).alias("currency"), T.price(F.col("s")).alias("price"))


RATINGS = [("whiskyadvocate.com", "Scored 92 points"), ("masterofmalt.com", "4.5 / 5 from 20"), ("thewhiskyexchange.com", "4.5 out of 5"), ("other.com", "88/100 nose"), ("other.com", "3.5/5"), ("other.com", "4 Stars"), ("other.com", "45 points"), ("other.com", "95 Points"), ("other.com", "none"), ("whiskybase.com", "4/5"), ("totalwine.com", "")]


def _rating_sql() -> str:
    own = " ".join(f"when src = '{site}' and regexp_extract(s, '{p}', 1) <> '' then struct_pack(score := try_cast(regexp_extract(s, '{p}', 1) as double), max_score := {m})" for site, (m, p) in T.REVIEW_SITES.items())
    rest = " ".join(f"when regexp_extract(s, '{p}', 1) <> '' {x} then struct_pack(score := try_cast(regexp_extract(s, '{p}', 1) as double), max_score := {m})" for p, m, x in ((r"(\d+\.?\d*)\s*/\s*100", 100, ""), (r"(\d+\.?\d*)\s*/\s*5", 5, ""), (r"(?i)(\d+\.?\d*)\s*stars?", 5, ""), (r"(?i)(\d+)\s*points?", 100, "and try_cast(regexp_extract(s, '(?i)(\\d+)\\s*points?', 1) as int) between 50 and 100")))
    return f"case {own} {rest} end"


@query("rating_extract", f"with t(k, src, s) as (values {', '.join(f'({i}, {a!r}, {b!r})' for i, (a, b) in enumerate(RATINGS))}), r as (select k, {_rating_sql()} as r from t) select k, r.score as score, r.max_score as max_score from r")
def rating_extract(spark, folder):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(RATINGS)], "k bigint, src string, s string")
    return rows.select("k", T.rating(F.col("src"), F.col("s")).alias("r")).select("k", "r.score", "r.max_score")


AGES = ["3 weeks ago", "yesterday", "5 hours ago", "1 day ago", "2 Months ago", "1 year ago", "", None, "May 2020", "10 days  ago, 2 weeks ago"]


@query(
    "age_days",
    f"""with {listed_sql(AGES)}, l as (select k, lower(coalesce(s, '')) as s from t)
select k, case when contains(s, 'yesterday') then 1 when regexp_matches(s, '(\\d+)\\s*hours?\\s*ago') then 0 when regexp_matches(s, '(\\d+)\\s*days?\\s*ago') then regexp_extract(s, '(\\d+)\\s*days?\\s*ago', 1)::int
  when regexp_matches(s, '(\\d+)\\s*weeks?\\s*ago') then regexp_extract(s, '(\\d+)\\s*weeks?\\s*ago', 1)::int * 7 when regexp_matches(s, '(\\d+)\\s*months?\\s*ago') then regexp_extract(s, '(\\d+)\\s*months?\\s*ago', 1)::int * 30
  when regexp_matches(s, '(\\d+)\\s*years?\\s*ago') then regexp_extract(s, '(\\d+)\\s*years?\\s*ago', 1)::int * 365 else 9999 end as days from l""",
)
def age_days(spark, folder):
    return listed(spark, AGES).select("k", T.age_days(F.col("s")).alias("days"))


DESIGNATIONS = ["30 years", "25", "35 Year Old", "9", "N/A", "", None, "45", "12", "Tawny"]


@query("age_designation", f"""with {listed_sql(DESIGNATIONS)}, a as (select k, try_cast(regexp_extract(coalesce(s, ''), '(\\d+)', 1) as int) as a from t union all select 100 + p_partkey, p_size from part)
select k, case when a >= 10 then greatest(round_even(a / 10, 0)::int * 10, 10) end as age from a""")
def age_designation(spark, folder):
    parts = table(spark, folder, "part").select((100 + F.col("p_partkey")).alias("k"), F.col("p_size").cast("string").alias("s"))
    return listed(spark, DESIGNATIONS).unionByName(parts).select("k", T.age_designation(F.col("s")).alias("age"))


@query("fingerprint", """select p_partkey, sha256('{"brand": "' || lower(trim(p_brand)) || '", "name": "' || lower(trim(p_name)) || '", "size": ' || case when p_size % 7 = 0 then 'null' else p_size::varchar end || '}') as fingerprint from part""")
def fingerprint(spark, folder):
    clean = lambda c: T.json_text(F.lower(F.trim(F.col(c))))
    size = F.when(F.col("p_size") % 7 == 0, "null").otherwise(F.col("p_size").cast("string"))
    return table(spark, folder, "part").select("p_partkey", T.fingerprint(name=clean("p_name"), brand=clean("p_brand"), size=size).alias("fingerprint"))


MEDALS = ["Gold", " Double Gold ", "double gold winner", "Gold Medal 2020", "silver", "Best in Show", "Master", "master  blender", "", None, "Platinum!", "BRONZE award"]


def medal_sql(column: str) -> str:
    low = f"lower(trim(coalesce({column}, '')))"
    exact = " ".join(f"when {low} = '{a}' then '{b}'" for a, b in T.MEDALS.items())
    within = " ".join(f"when contains({low}, '{a}') then '{b}'" for a, b in T.MEDALS.items())
    return f"case when {low} = '' then '' {exact} {within} else regexp_replace({low}, '\\s+', '_', 'g') end"


@query("medal_norm", f"with {listed_sql(MEDALS)} select k, {medal_sql('s')} as medal from t")
def medal_norm(spark, folder):
    return listed(spark, MEDALS).select("k", T.medal(F.col("s")).alias("medal"))


@query(
    "award_dedup",
    f"""with a as (select l_partkey as product_id, p_brand as competition, year(l_shipdate) as y, case l_linenumber % 4 when 0 then 'Gold' when 1 then 'gold medal' when 2 then 'Silver' else 'Double Gold' end as medal, l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey),
n as (select *, {medal_sql('medal')} as m from a), r as (select *, row_number() over (partition by product_id, competition, y, m order by l_orderkey, l_linenumber) as k from n)
select product_id, y as year, m as medal_key, medal, l_orderkey, l_linenumber from r where k = 1""",
)
def award_dedup(spark, folder):
    """The first award of each product, competition, year and medal, in any spelling."""
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    medal = F.when(F.col("l_linenumber") % 4 == 0, "Gold").when(F.col("l_linenumber") % 4 == 1, "gold medal").when(F.col("l_linenumber") % 4 == 2, "Silver").otherwise("Double Gold")
    awards = rows.select(F.col("l_partkey").alias("product_id"), F.col("p_brand").alias("competition"), F.year("l_shipdate").alias("year"), medal.alias("medal"), "l_orderkey", "l_linenumber").withColumn("medal_key", T.medal(F.col("medal")))
    ranked = awards.withColumn("k", F.row_number().over(Window.partitionBy("product_id", "competition", "year", "medal_key").orderBy("l_orderkey", "l_linenumber")))
    return ranked.filter("k = 1").select("product_id", F.col("year").cast("bigint").alias("year"), "medal_key", "medal", "l_orderkey", "l_linenumber")


BASIC_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"""


@query("basic_text", f"""with a as (select page_id, replace(replace(replace(replace(replace(replace({BASIC_SQL}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') as t from pages)
select page_id, regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') as body from a""")
def basic_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.basic_text(F.col("html")).alias("body"))


@query("content_latest", "select source, max(doc_id) as doc_id from documents group by source")
def content_latest(spark, folder):
    """The newest document of each source."""
    return latest(table(spark, folder, "documents").select("source", "doc_id"), "source", [F.desc("doc_id")])


TITLES = ["Lagavulin 16 Year Old", "Old Pulteney 12", "The GlenDronach 12 Year", "x"]


@query("title_relevance", """with t(k, q) as (values (0, 'thinly of steel'), (1, 'the small brass widget'), (2, 'blue of')),
w as (select k, p_partkey, lower(p_name) as n, [x for x in string_split(q, ' ') if length(x) > 2] as ws from t cross join part)
select k, p_partkey, len([x for x in ws if contains(n, x)])::int as matched, len(ws) > 0 and len([x for x in ws if contains(n, x)]) >= len(ws) * 0.5 as relevant from w""")
def title_relevance(spark, folder):
    """Half of a query's words of over two letters in a title. The three queries are a constant, not a table."""
    queries = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(q).alias("q")) for k, q in enumerate(["thinly of steel", "the small brass widget", "blue of"]))))
    rows = table(spark, folder, "part").select("p_partkey", F.lower("p_name").alias("n"), queries.alias("t"))
    rows = rows.withColumn("ws", F.filter(F.split("t.q", " "), lambda x: F.length(x) > 2))
    matched = F.size(F.filter("ws", lambda x: F.contains(F.col("n"), x)))
    return rows.select("t.k", "p_partkey", matched.alias("matched"), ((F.size("ws") > 0) & (matched >= F.size("ws") * 0.5)).alias("relevant"))
