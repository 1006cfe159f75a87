"""Frontier and registry queries: pages in the role of discovered URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.urls import frontier_hash
from millrace.operators import frontier as Q
from millrace.operators import rules as R
from millrace.plans.scoring import PALATE_SQL, RECORD_SQL, SCORE_SQL, record
from millrace.operators import scoring as S
from millrace.registry import query
from millrace.sources.tables import table

NEW_SQL = """u as (select page_id % 3 as queue, url, page_id % 10 as priority, sha256(rtrim(lower(trim(url)), '/')) as h from pages),
n as (select * from u where (queue, h) not in (select page_id % 3, sha256(rtrim(lower(trim(url)), '/')) from pages where page_id % 7 = 0) and h not in (select sha256(rtrim(lower(trim(url)), '/')) from pages where page_id % 11 = 0)),
r as (select *, row_number() over (partition by queue, h order by priority desc, url) as k from n)"""


def _new(spark, folder):
    pages = table(spark, folder, "pages")
    urls = pages.select((F.col("page_id") % 3).alias("queue"), "url", (F.col("page_id") % 10).alias("priority"))
    hashed = pages.withColumn("url_hash", frontier_hash(F.col("url")))
    seen = hashed.filter("page_id % 7 = 0").select((F.col("page_id") % 3).alias("queue"), "url_hash")
    return Q.unseen(urls, seen, hashed.filter("page_id % 11 = 0").select("url_hash"))


@query("frontier_new", f"with {NEW_SQL} select queue, h as url_hash, url, priority from r where k = 1")
def frontier_new(spark, folder):
    return _new(spark, folder)


@query("frontier_pop", f"with {NEW_SQL} select queue, h as url_hash, url, priority from r where k = 1 order by priority desc, url, queue limit 25")
def frontier_pop(spark, folder):
    return _new(spark, folder).orderBy(F.desc("priority"), "url", "queue").limit(25)


@query("spoke_register", r"""with k as (select regexp_replace(lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?', 2)), '^www\.', '') as host, min(page_id) as known_source from pages where page_id % 4 = 0 group by 1),
f as (select page_id as site_id, url, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 1) as s, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 2) as a, regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)', 3) as p from pages)
select site_id, s || '://' || a || case when p = '' then '/' else p end as address, known_source from f left join k on k.host = regexp_replace(lower(a), '^www\.', '')""")
def spoke_register(spark, folder):
    pages = table(spark, folder, "pages")
    known = pages.filter("page_id % 4 = 0").select(F.col("page_id").alias("source_id"), F.col("url").alias("base_url"))
    return Q.registered(pages.select(F.col("page_id").alias("site_id"), "url"), known)


@query("min_quality", f"""with {RECORD_SQL}, {SCORE_SQL}, c as (select product_id, concat_ws(',', case when not coalesce(len(palate_flavors) >= 3, false) then 'palate' end, case when not coalesce(trim(product_type) <> '', false) then 'category' end,
 case when {PALATE_SQL}::int + coalesce(nose_description <> '', false)::int + coalesce(finish_description <> '' or final_notes <> '', false)::int < 2 then 'tasting' end, case when not coalesce(best_price <> 0, false) then 'price' end,
 case when not (coalesce(name <> '', false) and coalesce(brand_id <> 0, false) and coalesce(abv <> 0, false)) then 'identity' end, case when score < 60 then 'score' end) as reasons from s)
select product_id, reasons = '' as enough, reasons from c""")
def min_quality(spark, folder):
    """Whether a product needs no further sources, and if it does, why."""
    text = lambda c: S.truthy(F.col(c), "string")
    number = lambda c: S.truthy(F.col(c), "number")
    either = F.coalesce((F.col("finish_description") != "") | (F.col("final_notes") != ""), F.lit(False))
    tasting = S.has_palate().cast("int") + text("nose_description").cast("int") + either.cast("int")
    checks = {
        "palate": F.size("palate_flavors") >= 3, "category": F.trim("product_type") != "", "tasting": tasting >= 2, "price": number("best_price"),
        "identity": text("name") & number("brand_id") & number("abv"), "score": F.col("score") >= 60,
    }
    rows = record(spark, folder).withColumn("score", S.completeness())
    reasons = R.failures(checks)
    return rows.select("product_id", (F.size(reasons) == 0).alias("enough"), F.array_join(reasons, ",").alias("reasons"))
