"""Classification of pages, links, errors and awards.

The driver's pages hold no login forms, age gates or challenges, so the rules also meet crafted strings, which stand
in the query and in its SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import texts as T
from millrace.functions import urls as U
from millrace.operators import classify as C
from millrace.plans.texts import listed, listed_sql
from millrace.registry import query
from millrace.sources.tables import table

LONG = "<p>" + "plain words of a page " * 40 + "</p>"
PAGES = [
    LONG, "short", "Please VERIFY your age " + LONG, LONG + "I am over 21 years old", "<div class='g-recaptcha' data-sitekey='x'></div>" + LONG, LONG + "We value GDPR. Accept all cookies",
    "Too many requests, slow down. " + LONG, LONG + "not available in your country", "<form action='/login'>" + LONG, LONG + "Members only: sign in to view", LONG + "paywall", "<input type='password'>" + LONG,
    "Just a moment... " + LONG, "Cloudflare Ray ID: 1", LONG + "Cloudflare Ray ID: 1", '<div id="root"></div><script>x</script>', '<div id="app"></div>' + LONG, "", LONG + "by entering this site you agree", "Subscription required",
]
CODE = "case when k % 5 = 0 then 429 when k % 7 = 0 then 403 else 200 end"


def _all(text: str, patterns: tuple[str, ...]) -> str:
    joined = "|".join(patterns).replace("'", "''")
    return f"regexp_matches({text}, '(?i)(?:{joined})')"


def _has(text: str, signs: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{x.replace(chr(39), chr(39) * 2)}')" for x in signs) + ")"


TRIMMED = r"regexp_replace(s, '^\s+|\s+$', '', 'g')"


@query("obstacles", f"""with {listed_sql(PAGES)}, c as (select k, s, {CODE} as code from t)
select k, concat_ws(',', case when code = 429 then 'rate_limited:1.0' end, case when code = 403 then 'geo_blocked:' || case when {_all('s', C.GEO_PATTERNS)} then '0.9' else '0.7' end end, case when {_all('s', C.AGE_GATE_PATTERNS)} then 'age_gate:0.9' end,
 case when {_all('s', C.CAPTCHA_PATTERNS)} then 'captcha:0.95' end, case when {_all('s', C.COOKIE_PATTERNS)} then 'cookie_consent:0.8' end, case when code <> 429 and {_all('s', C.RATE_PATTERNS)} then 'rate_limited:0.85' end, case when length({TRIMMED}) < 500 then 'js_rendered:0.7' end) as found from c""")
def obstacles(spark, folder):
    rows = listed(spark, PAGES).withColumn("code", F.expr(CODE))
    return rows.select("k", F.array_join(F.transform(C.obstacles(F.col("s"), F.col("code")), lambda o: F.concat(o["type"], F.lit(":"), o["confidence"].cast("string"))), ",").alias("found"))


@query("obstacles_pages", f"select page_id, {_all('html', C.COOKIE_PATTERNS)} as cookie_consent, {_all('html', C.CAPTCHA_PATTERNS)} as captcha, length({TRIMMED.replace('(s,', '(html,')}) < 500 as js_rendered from pages")
def obstacles_pages(spark, folder):
    found = F.transform(C.obstacles(F.col("html"), F.lit(200)), lambda o: o["type"])
    rows = table(spark, folder, "pages").select("page_id", found.alias("o"))
    return rows.select("page_id", *(F.array_contains("o", x).alias(x) for x in ("cookie_consent", "captcha", "js_rendered")))


@query("members_only", f"with {listed_sql(PAGES)} select k, coalesce({_all('s', C.MEMBERS_PATTERNS)}, false) or {CODE} in (401, 402, 403) as members_only from t union all select 1000 + page_id, {_all('html', C.MEMBERS_PATTERNS)} from pages")
def members_only(spark, folder):
    crafted = listed(spark, PAGES).select("k", C.members_only(F.col("s"), F.expr(CODE)).alias("members_only"))
    return crafted.unionByName(table(spark, folder, "pages").select((1000 + F.col("page_id")).alias("k"), C.members_only(F.col("html"), F.lit(200)).alias("members_only")))


@query("age_gate", f"with {listed_sql(PAGES)} select k, length(s) < 500 or {_has('lower(s)', C.AGE_GATE_WORDS)} as age_gate from t union all select 1000 + page_id, length(html) < 500 or {_has('lower(html)', C.AGE_GATE_WORDS)} from pages")
def age_gate(spark, folder):
    crafted = listed(spark, PAGES).select("k", C.age_gate(F.col("s")).alias("age_gate"))
    return crafted.unionByName(table(spark, folder, "pages").select((1000 + F.col("page_id")).alias("k"), C.age_gate(F.col("html")).alias("age_gate")))


def _escalation_sql(text: str, code: str, tier: str, rate: str) -> str:
    bare = lambda s: f"regexp_replace(regexp_replace({s}, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')"
    low = f"lower({text})"
    shell = " or ".join(f"(instr({low}, '{x}') > 0 and length({bare(f'substr({text}, instr({low}, {chr(39)}{x}{chr(39)}) + {len(x)})')}) < 100)" for x in C.EMPTY_SHELLS)
    return f"""case when {tier} >= 3 then null when {code} in (403, 429, 503) then 'status_' || {code}
 when {code} = 200 and length({text}) <= 50000 and ({_has(low, C.CLOUDFLARE_SIGNS)} or (length({text}) < 10000 and contains({low}, 'cloudflare ray id') and length({bare(text)}) < 1000)) then 'cloudflare'
 when {code} = 200 and {_has(low, C.CAPTCHA_SIGNS)} then 'captcha' when {code} = 200 and ({shell}) then 'javascript' when {code} = 200 and length({bare(text)}) < 200 then 'empty' when {rate} < 0.5 then 'low_success_rate' end"""


@query("escalation", f"with {listed_sql(PAGES)} select k, {_escalation_sql('s', '(' + CODE + ')', '(k % 4)', '(k / 20)')} as reason from t union all select 1000 + page_id, {_escalation_sql('html', '200', '1', '(page_id % 10 / 10)')} from pages")
def escalation(spark, folder):
    crafted = listed(spark, PAGES).select("k", C.escalation(F.col("s"), F.expr(CODE), F.col("k") % 4, F.col("k") / 20).alias("reason"))
    pages = table(spark, folder, "pages").select((1000 + F.col("page_id")).alias("k"), C.escalation(F.col("html"), F.lit(200), F.lit(1), F.col("page_id") % 10 / 10).alias("reason"))
    return crafted.unionByName(pages)


@query("start_tier", "select c_custkey, coalesce(case when c_custkey % 50 = 0 then 2 end, case when c_custkey % 17 = 0 or c_custkey % 13 = 0 then 3 when c_custkey % 11 = 0 then 2 when c_nationkey >= 5 then case when c_acctbal >= 3000 then 1 when c_acctbal >= 0 then 2 else 3 end else 1 end)::int as tier from customer")
def start_tier(spark, folder):
    k, rate = F.col("c_custkey"), F.col("c_acctbal")
    rates = [F.when(rate >= 3000, 0.9).otherwise(0.1), F.when(rate >= 0, 0.9).otherwise(0.1)]
    return table(spark, folder, "customer").select("c_custkey", C.start_tier(F.when(k % 50 == 0, 2), k % 17 == 0, k % 13 == 0, k % 11 == 0, F.col("c_nationkey"), rates).cast("int").alias("tier"))


ERRORS = ["ReadTimeout|x|200", "ConnectionError|refused|0", "ValueError|Age gate found|0", "JSONDecodeError|bad|0", "RuntimeError|API down|0", "X|y|403", "TimeoutError|z|429", "KeyError|k|0", "DNSFailure|timeout|0", "ApiError|no|0"]


@query("error_class", f"""with {listed_sql(ERRORS)}, e as (select k, lower(split_part(s, '|', 1)) as n, lower(split_part(s, '|', 2)) as m, split_part(s, '|', 3)::int as code from t)
select k, case when code = 403 then 'blocked' when code = 429 then 'rate_limit' when contains(n, 'timeout') or contains(m, 'timeout') then 'timeout' when regexp_matches(n, 'connection|socket|network|dns') then 'connection'
 when contains(m, 'age') and contains(m, 'gate') then 'age_gate' when regexp_matches(n, 'parse|json|decode') then 'parse' when contains(m, 'api') or contains(n, 'api') then 'api' else 'unknown' end as error_type from e""")
def error_class(spark, folder):
    parts = F.split("s", "[|]")
    return listed(spark, ERRORS).select("k", C.error_class(parts[0], parts[1], parts[2].cast("int")).alias("error_type"))


LINK = r"""(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>"""
PRODUCT = r"(?i)/en/\d+|/product|/th"
PARTS_OF = r"'^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


@query("links", f"""with a as (select page_id, url as base, unnest(regexp_extract_all(html, '{LINK}', 1)) as href, unnest(regexp_extract_all(html, '{LINK}', 2)) as label, generate_subscripts(regexp_extract_all(html, '{LINK}', 1), 1) as pos from pages),
b as (select *, regexp_extract(base, {PARTS_OF}, 1) as sch, regexp_extract(base, {PARTS_OF}, 2) as auth, regexp_extract(base, {PARTS_OF}, 3) as path from a where not regexp_matches(href, '{C.SKIPPED}')),
c as (select *, regexp_replace(case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when starts_with(href, '//') then sch || ':' || href when starts_with(href, '/') then sch || '://' || auth || href
  when starts_with(href, '?') or starts_with(href, '#') or href = '' then sch || '://' || auth || path || href else sch || '://' || auth || case when regexp_replace(path, '[^/]*$', '') = '' then '/' else regexp_replace(path, '[^/]*$', '') end || href end, '#.*$', '') as link from b),
d as (select *, case when regexp_matches(link, '{C.PAGINATION}') then 'pagination' when regexp_matches(link, '{PRODUCT}') then 'product' when regexp_matches(link, '{C.CATEGORY}') then 'category' when regexp_matches(link, '{C.RELATED}') or regexp_matches(lower(label), '{C.RELATED}') then 'related' else 'unknown' end as link_type,
  regexp_extract(link, {PARTS_OF}, 2) = auth as internal, regexp_matches(link, '{PRODUCT}') as product from c),
f as (select page_id, link, min(pos) as pos, any_value(link_type order by pos) as link_type, any_value(internal order by pos) as is_internal, any_value(product order by pos) as product from d group by 1, 2)
select page_id, link, link_type, is_internal, (case when not is_internal then 3 when link_type = 'related' then 9 when product or link_type = 'product' then 8 when link_type = 'category' then 6 else 5 end)::int as priority from f""")
def links(spark, folder):
    """Links of each page, absolute and without fragment, first of each kept, with type and priority."""
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("base"), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("hrefs"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("labels"))
    each = pages.select("page_id", "base", F.posexplode(F.arrays_zip("hrefs", "labels")).alias("pos", "a")).filter(~F.col("a.hrefs").rlike(C.SKIPPED))
    found = each.select("page_id", "base", "pos", F.col("a.labels").alias("label"), U.link_form(U.resolve(F.col("base"), F.col("a.hrefs"))).alias("link"))
    typed = found.select("page_id", "link", F.struct("pos", C.link_type(F.col("link"), F.col("label"), PRODUCT).alias("link_type"), (U.part(F.col("link"), 2) == U.part(F.col("base"), 2)).alias("is_internal"), F.col("link").rlike(PRODUCT).alias("product")).alias("x"))
    first = typed.groupBy("page_id", "link").agg(F.min("x").alias("x")).select("page_id", "link", "x.link_type", "x.is_internal", "x.product")
    return first.select("page_id", "link", "link_type", "is_internal", C.link_priority(F.col("link_type"), F.col("product") | (F.col("link_type") == "product"), F.col("is_internal")).alias("priority"))


HEADS_SQL = r"list_slice([h for h in [trim(regexp_replace(x, '<[^>]+>', '', 'g')) for x in regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)] if length(h) > 0 and length(h) < 200], 1, 20)"


@query("headings", f"select page_id, array_to_string({HEADS_SQL}, ' | ') as headings from pages")
def headings(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.array_join(C.headings(F.col("html")), " | ").alias("headings"))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(html, '{pattern.replace(chr(39), chr(39) * 2)}'))"


@query("page_structure", f"""select page_id, regexp_matches(url, '{C.CATEGORY}') or len({HEADS_SQL}) > 5 or {_count('(?i)<tr[^>]*>')} > 10 or ({_count('(?i)<li[^>]*>')} > 15 and {_count(r'(?is)<li[^>]*>.*?(?:price|add.?to.?cart|\$|buy|shop).*?</li>')} > 5)
 or {_count("(?i)data-product-id")} + {_count("(?i)data-sku")} + {_count('''(?i)class=["'][^"']*product[^"']*card[^"']*["']''')} + {_count('''(?i)class=["'][^"']*item[^"']*product[^"']*["']''')} > 5 as keeps_structure, {_count('(?i)<li[^>]*>')}::int as list_items from pages""")
def page_structure(spark, folder):
    html = F.col("html")
    return table(spark, folder, "pages").select("page_id", C.keeps_structure(html, C.headings(html), F.col("url")).alias("keeps_structure"), F.regexp_count(html, F.lit("(?i)<li[^>]*>")).alias("list_items"))


LEVELS = ["World's Best Single Malt", "Best Islay Single Malt", "BEST  Scotch Grain", "best new thing ", "Category gold", "Worlds best", "The Best Irish Pot", "best non-kentucky bourbon"]


@query("award_level", f"with {listed_sql(LEVELS)}, l as (select k, s, lower(trim(s)) as low from t) select k, case when contains(low, 'world''s best') or contains(low, 'worlds best') then 'World''s Best' " + " ".join(f"when regexp_matches(low, 'best\\s+{r.lower()}') then 'Best {r}'" for r in C.REGIONS) + " when starts_with(low, 'best ') then trim(s) else 'Winner' end as level from l")
def award_level(spark, folder):
    return listed(spark, LEVELS).select("k", C.award_level(F.col("s")).alias("level"))


@query("product_kind", "select p_partkey, case when contains(lower(p_name || ' ' || p_type), 'small') then 'mini' when contains(lower(p_name || ' ' || p_type), 'brass') then 'metal' when contains(lower(p_name || ' ' || p_type), 'steel') then 'metal' else 'other' end as kind from part")
def product_kind(spark, folder):
    """A class by the first word of an ordered list that a product's texts contain."""
    return table(spark, folder, "part").select("p_partkey", C.first_word(F.concat_ws(" ", "p_name", "p_type"), [("small", "mini"), ("brass", "metal"), ("steel", "metal")], "other").alias("kind"))


@query("page_title", "select page_id, coalesce(nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'untitled') as title, length(html) // 4 as tokens from pages")
def page_title(spark, folder):
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, folder, "pages").select("page_id", F.coalesce(F.nullif(title, F.lit("")), F.lit("untitled")).alias("title"), T.token_estimate(F.col("html")).alias("tokens"))
