"""Queries over whole pages: product sections and structural signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import html as H
from millrace.registry import query
from millrace.sources.tables import table


@query("sha_url", "select page_id, sha256(url) as url_sha256, sha256(html) as content_sha256 from pages")
def sha_url(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.sha2("url", 256).alias("url_sha256"), F.sha2("html", 256).alias("content_sha256"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?is)<svg[^>]*>.*?</svg>', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g'), '\\s+', ' ', 'g')"


@query("page_product_section", f"""with c as (select page_id, 'Title: ' || nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as told, {_CLEAN} as s from pages),
f as (select *, regexp_extract(s, '(?is)<main[^>]*>(.*?)</main>', 1) as a, regexp_extract(s, '(?is)<article[^>]*>(.*?)</article>', 1) as b from c)
select page_id, substr(case when length(told) > 100 then told when length(a) > 500 then a when length(b) > 500 then b else s end, 1, 30000) as section from f""")
def page_product_section(spark, folder):
    return table(spark, folder, "pages").select("page_id", H.product_section(F.col("html")).alias("section"))


@query("made_signature", "select page_id, md5('html|div:class=a,b' || page_id % 3 || ':id=x:data-k|p|img:data-z|div:class=a,b' || page_id % 3) as signature from pages")
def made_signature(spark, folder):
    """Signatures of made pages: elements, sorted classes, ids and names of data attributes, no texts or values."""
    cls = F.concat(F.lit("b"), (F.col("page_id") % 3).cast("string"))
    page = F.concat(F.lit('<html><div data-k="'), F.col("page_id").cast("string"), F.lit('" id="x" class="'), cls, F.lit(' a"><p>'), "url", F.lit('</p><img data-z src="'), "url", F.lit('"></div><div class="a '), cls, F.lit('"></div></html>'))
    return table(spark, folder, "pages").select("page_id", H.dom_signature(page).alias("signature"))


@query("dom_signature")
def dom_signature(spark, folder):
    return table(spark, folder, "pages").select("page_id", H.dom_signature("html").alias("signature"))
