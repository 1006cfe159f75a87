"""Record, sitemap and search-result queries: JSON and XML made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import records as R
from millrace.plans.texts import listed, listed_sql
from millrace.registry import query
from millrace.sources import web as W
from millrace.sources.tables import table

CASTS = ["12", "1,234", "45.5%", "abc", "", None, "-7", "2024-03-01", "01/03/2024", "yes", "No", "a, b,,c "]


@query("safe_cast", f"""with {listed_sql(CASTS)} select k, try_cast(regexp_extract(replace(trim(s), ',', ''), '^(-?\\d+)', 1) as int) as i, try_cast(replace(replace(trim(s), ',', ''), '%', '') as double) as f, case when lower(trim(s)) in ('true', 'yes', '1') then true when lower(trim(s)) in ('false', 'no', '0') then false end::varchar as b,
 coalesce(case when regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then s end, case when regexp_matches(s, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') then strftime(strptime(s, '%d/%m/%Y'), '%Y-%m-%d') end) as d, array_to_string([trim(x) for x in string_split(coalesce(s, ''), ',') if trim(x) <> ''], '|') as l from t""")
def safe_cast(spark, folder):
    s = F.col("s")
    return listed(spark, CASTS).select("k", R.safe_int(s).alias("i"), R.safe_float(s).alias("f"), R.safe_bool(s).cast("string").alias("b"), R.safe_date(s).cast("string").alias("d"), F.array_join(R.safe_list(s), "|").alias("l"))


@query("events_json", "select event_id, (props->>'$.k')::int as k from events")
def events_json(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("normalize_extracted", "select p_partkey, coalesce(nullif(trim(case when p_partkey % 2 = 0 then p_name else '' end), ''), nullif(trim(case when p_partkey % 3 = 0 then p_brand end), ''), nullif(trim(p_type), '')) as name from part")
def normalize_extracted(spark, folder):
    """A field from its name, an alias, or a nested object, whichever is filled first."""
    nested = F.to_json(F.struct(F.struct(F.col("p_type").alias("name")).alias("product")))
    rows = table(spark, folder, "part").withColumn("j", nested)
    name = R.first_of(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), F.get_json_object("j", "$.product.name"))
    return rows.select("p_partkey", name.alias("name"))


@query("awards_explode", "select l_orderkey as product_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, year(l_shipdate)) - 1)::int as pos, l_returnflag as medal, year(l_shipdate)::int as year from lineitem")
def awards_explode(spark, folder):
    """A list of awards in JSON, one list a product, to rows with their place."""
    entry = F.struct("l_linenumber", F.col("l_returnflag").alias("medal"), F.year("l_shipdate").alias("year"))
    lists = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("product_id")).agg(F.concat(F.lit(" "), F.to_json(F.sort_array(F.collect_list(entry)))).alias("awards"))
    return R.exploded(lists, "product_id", "awards", "struct<medal:string,year:int>")


@query("serp_parse", "select page_id // 10 as query_id, row_number() over (partition by page_id // 10 order by page_id)::int as rank, url as link, case when page_id % 4 = 0 then '' else 'page ' || page_id end as title from pages")
def serp_parse(spark, folder):
    """Ten pages make a search response in JSON; its results as rows, missing titles as empty ones."""
    entry = F.struct("page_id", F.col("url").alias("link"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("page "), "page_id")).alias("title"))
    made = table(spark, folder, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("query_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("organic_results"))).alias("response"))
    return W.search_results(made, "query_id", "response", "organic_results").select("query_id", "rank", "link", "title")


@query("sitemap_parse", "select page_id // 50 as file_id, url, case when page_id % 3 > 0 then strftime(timestamp '2024-01-01' + to_days((page_id % 200)::int), '%Y-%m-%d') end as lastmod, case when page_id % 5 > 0 and page_id % 13 <= 10 then (page_id % 13) / 10 end as priority from pages")
def sitemap_parse(spark, folder):
    """Fifty pages make a sitemap in XML; its entries as rows, with what can't be read as null."""
    day = F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("page_id") % 200).cast("int")), "yyyy-MM-dd")
    xml = F.concat(
        F.lit("<url><loc>"), F.col("url"), F.lit("</loc><lastmod>"), F.when(F.col("page_id") % 3 > 0, day).otherwise("soon"),
        F.lit("</lastmod><priority>"), F.when(F.col("page_id") % 5 > 0, (F.col("page_id") % 13 / 10).cast("string")).otherwise("high"), F.lit("</priority></url>"),
    )
    files = table(spark, folder, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("file_id")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(xml), ""), F.lit("</urlset>")).alias("xml"))
    rows = W.sitemap_entries(files, "file_id", "xml")
    return rows.select("file_id", "url", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"), "priority")


@query("source_record", """select page_id, length(substr(html, 1, 500000))::int as chars, substr(list_extract(string_split(rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z]+://[^/]*', ''), '/'), '/'), -1), 1, 100) as title from pages""")
def source_record(spark, folder):
    rows = table(spark, folder, "pages").select("page_id", R.source_record(F.col("url"), F.col("html")).alias("r"))
    return rows.select("page_id", F.length("r.content").alias("chars"), "r.title")


@query("import_terms", "select p_partkey, case when p_size <= 0 or p_type is null then 'skipped' when p_partkey in (select l_partkey from lineitem where l_returnflag = 'R') then 'updated' else 'created' end as action from part")
def import_terms(spark, folder):
    """What an import does with each row: skipped, updated, or created."""
    old = table(spark, folder, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    valid = (F.col("p_size") > 0) & F.col("p_type").isNotNull()
    return R.import_action(table(spark, folder, "part"), old, ["p_partkey"], valid).select("p_partkey", "action")


@query("upsert_latest", """with n as (select o_custkey as c_custkey, o_totalprice as c_acctbal, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders)
select c_custkey, c_acctbal from n where k = 1 union all select c_custkey, c_acctbal from customer where c_custkey not in (select o_custkey from orders)""")
def upsert_latest(spark, folder):
    """Balances, with each customer's last order's amount in place of the old one."""
    new = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderdate", "o_orderkey")
    return R.upserted(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("cleanup_raw_content", "select page_id, cast(null as varchar) as raw_content from pages where page_id % 3 = 0 and html <> ''")
def cleanup_raw_content(spark, folder):
    """Archived and processed sources lose their raw content."""
    rows = table(spark, folder, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("raw_content"), F.col("page_id").alias("crawled_at"))
    return R.cleaned_up(rows, F.col("source_id") % 3 == 0).select(F.col("source_id").alias("page_id"), "raw_content")


@query("normalize_record", """with a as (select p_partkey as k, case when p_partkey % 2 = 0 then p_name end as name, p_type as product_name, case when p_partkey % 3 = 0 then p_brand end as brand, case when p_partkey % 5 > 0 then 'House' end as producer, case p_partkey % 4 when 0 then 'bourbon' when 1 then 'single_cask' end as kind, case when p_partkey % 7 = 0 then 'Own' end as category, case when p_partkey % 3 = 1 then p_size end as top_size from part)
select k, coalesce(name, product_name) as name, coalesce(brand, producer) as brand, coalesce(category, case kind when 'bourbon' then 'Bourbon' when 'single_cask' then 'Single Cask' end) as category, case when k % 2 = 0 then 'own nose' else 'note' end as nose_description, coalesce(top_size, 7)::varchar as color_intensity from a""")
def normalize_record(spark, folder):
    """Records in JSON by their aliases, nested objects and tasting notes."""
    k = F.col("p_partkey")
    record = F.struct(
        F.when(k % 2 == 0, F.col("p_name")).alias("name"), F.col("p_type").alias("product_name"), F.when(k % 3 == 0, F.col("p_brand")).alias("brand"), F.when(k % 5 > 0, "House").alias("producer"),
        F.when(k % 4 == 0, "bourbon").when(k % 4 == 1, "single_cask").alias("whiskey_type"), F.when(k % 7 == 0, "Own").otherwise("").alias("category"), F.when(k % 2 == 0, "own nose").alias("nose_description"),
        F.struct(F.lit("note").alias("nose")).alias("tasting_notes"), F.struct(F.lit(7).alias("color_intensity")).alias("appearance"), F.when(k % 3 == 1, F.col("p_size")).alias("color_intensity"),
    )
    rows = table(spark, folder, "part").select(k.alias("k"), F.to_json(record).alias("data"))
    fields = R.normalized("data")
    return rows.select("k", *(fields[f].alias(f) for f in ("name", "brand", "category", "nose_description")), R.nested_field("data", "color_intensity").alias("color_intensity"))


@query("field_mapping", "select p_partkey, nullif(trim(case when p_partkey % 4 = 0 then ' ' else p_name end), '') as title, p_size::int as size, (p_retailprice)::double as price, case p_partkey % 3 when 0 then true when 1 then false end as peated, case when p_partkey % 2 = 0 then 2 else 0 end::int as tags from part")
def field_mapping(spark, folder):
    """A JSON record's fields under their own names and types, as a mapping table says."""
    k = F.col("p_partkey")
    record = F.struct(
        F.when(k % 4 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.concat(F.col("p_size").cast("string"), F.lit(" ml")).alias("vol"), F.concat(F.col("p_retailprice").cast("string"), F.lit("%")).alias("cost"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "no").otherwise("?").alias("smoke"), F.when(k % 2 == 0, "a, b,").otherwise("").alias("labels"),
    )
    rows = table(spark, folder, "part").select("p_partkey", F.to_json(record).alias("data"))
    mapping = {"title": ("name", "string"), "size": ("vol", "int"), "price": ("cost", "float"), "peated": ("smoke", "bool"), "tags": ("labels", "list")}
    return R.mapped_fields(rows, "p_partkey", "data", mapping).withColumn("tags", F.size("tags"))


@query("store_sources", """with o as (select url, min(page_id) as p from pages where page_id % 2 = 0 group by 1), n as (select url, max(page_id) as p from pages where page_id % 3 = 0 group by 1)
select coalesce(n.url, o.url) as url, case when n.p is not null then 'new ' || n.p else 'old ' || o.p end as title, case when n.p is not null then sha256('content ' || n.p) else 'hash' end as content_hash, case when n.p % 2 = 1 then 'pre' when o.p is not null then 'old pre' end as preprocessed from o full join n on n.url = o.url""")
def store_sources(spark, folder):
    """Crawled pages stored by URL: new ones added, known ones replaced but for what the crawl didn't make."""
    pages = table(spark, folder, "pages")
    old = pages.filter("page_id % 2 = 0").groupBy("url").agg(F.min("page_id").alias("p")).select("url", F.concat(F.lit("old "), "p").alias("title"), F.lit("x").alias("raw_content"), F.lit("hash").alias("content_hash"), F.lit("page").alias("source_type"), F.lit("old pre").alias("preprocessed"))
    new = pages.filter("page_id % 3 = 0").select("url", F.concat(F.lit("new "), "page_id").alias("title"), F.concat(F.lit("content "), "page_id").alias("raw_content"), F.lit("page").alias("source_type"), F.when(F.col("page_id") % 2 == 1, "pre").alias("preprocessed"), F.col("page_id").alias("crawled_at"))
    return R.stored_source(old, new).select("url", "title", "content_hash", "preprocessed")


@query("brand_match", """with r as (select p_partkey as record_id, case when p_partkey % 3 = 0 then ' ' else case when p_partkey % 2 = 0 then upper(p_brand) else replace(p_brand, '#', ' ') end end as brand, case when p_partkey % 4 > 0 then split_part(p_name, ' ', 1) || ' Distillery' end as distillery, case when p_partkey % 5 > 0 then p_type end as producer from part),
n as (select record_id, coalesce(nullif(trim(brand), ''), nullif(trim(replace(trim(distillery), ' Distillery', '')), ''), producer) as name from r), s as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug from n),
b as (select p_brand as name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug, min(p_partkey) as id from part where p_size > 10 group by 1)
select record_id, s.name, s.slug, coalesce((select min(id) from b where lower(b.name) = lower(s.name)), (select min(id) from b where b.slug = s.slug)) as brand_id, case when s.name is not null then coalesce((select min(id) from b where lower(b.name) = lower(s.name)), (select min(id) from b where b.slug = s.slug)) is null end as created from s""")
def brand_match(spark, folder):
    """Records' brands by the first name that is filled, matched with known brands by name, then by slug."""
    parts, k = table(spark, folder, "part"), F.col("p_partkey")
    brand = F.when(k % 3 == 0, " ").when(k % 2 == 0, F.upper("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit(" ")))
    distillery = F.when(k % 4 > 0, F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" Distillery")))
    records = parts.select(k.alias("record_id"), brand.alias("brand"), distillery.alias("distillery"), F.when(k % 5 > 0, F.col("p_type")).alias("producer"), F.lit(None).cast("string").alias("producer_house"))
    slug = F.trim(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), F.lit("-"))
    brands = parts.filter("p_size > 10").groupBy("p_brand").agg(F.min("p_partkey").alias("brand_id")).select("brand_id", F.col("p_brand").alias("name"), slug.alias("slug"))
    return R.resolve_brands(records, brands)


@query("serp_shopping", "select page_id // 10 as query_id, row_number() over (partition by page_id // 10 order by page_id)::int as rank, 'item ' || page_id as title, (page_id + 0.5)::double as price, 'USD' as currency, case when page_id % 3 > 0 then 'shop' else '' end as source from pages")
def serp_shopping(spark, folder):
    """Shopping results with their prices as numbers."""
    from millrace.functions.texts import currency, price

    entry = F.struct("page_id", F.concat(F.lit("item "), "page_id").alias("title"), F.concat(F.lit("$"), (F.col("page_id") + 0.5).cast("string")).alias("price"), F.when(F.col("page_id") % 3 > 0, "shop").alias("source"))
    rows = W.search_results(_response(spark, folder, entry, "shopping_results"), "query_id", "response", "shopping_results")
    return rows.select("query_id", "rank", "title", price(F.col("price")).alias("price"), currency(F.col("price")).alias("currency"), "source")


def _response(spark, folder, entry, kind):
    """Ten pages make a search response of a kind in JSON."""
    return table(spark, folder, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("query_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias(kind))).alias("response"))


@query("serp_images", "select page_id // 10 as query_id, row_number() over (partition by page_id // 10 order by page_id)::int as rank, 'https://i.example/' || page_id as original, case page_id % 3 when 0 then 'bottle' when 1 then 'label' else 'unknown' end as kind from pages")
def serp_images(spark, folder):
    """Picture results with their kind by title."""
    from millrace.operators.classify import first_word

    title = F.when(F.col("page_id") % 3 == 0, "Front of the Bottle").when(F.col("page_id") % 3 == 1, "label")
    entry = F.struct("page_id", title.alias("title"), F.concat(F.lit("https://i.example/"), "page_id").alias("original"))
    rows = W.search_results(_response(spark, folder, entry, "images_results"), "query_id", "response", "images_results")
    return rows.select("query_id", "rank", "original", first_word(F.col("title"), [("bottle", "bottle"), ("label", "label"), ("pack", "packaging"), ("box", "packaging"), ("lifestyle", "lifestyle")], "unknown").alias("kind"))


@query("serp_news", "select page_id // 10 as query_id, row_number() over (partition by page_id // 10 order by page_id)::int as rank, url as link, (page_id % 6) * 7 as age from pages")
def serp_news(spark, folder):
    """News results with their age in days."""
    from millrace.functions.texts import age_days

    entry = F.struct("page_id", F.col("url").alias("link"), F.concat((F.col("page_id") % 6).cast("string"), F.lit(" weeks ago")).alias("date"))
    rows = W.search_results(_response(spark, folder, entry, "news_results"), "query_id", "response", "news_results")
    return rows.select("query_id", "rank", "link", age_days(F.col("date")).cast("bigint").alias("age"))


@query("robots_sitemaps", "select page_id, 1 + (page_id % 2)::int as sitemaps, 'https://s.example/' || page_id || '.xml' as first from pages")
def robots_sitemaps(spark, folder):
    """The sitemaps that robots files name."""
    text = F.concat(F.lit("User-agent: *\nDisallow: /sitemap: no\nSITEMAP:  https://s.example/"), "page_id", F.lit(".xml \n"), F.when(F.col("page_id") % 2 == 1, "sitemap: b\n").otherwise(""))
    rows = table(spark, folder, "pages").select("page_id", W.robots_sitemaps(text).alias("s"))
    return rows.select("page_id", F.size("s").alias("sitemaps"), F.element_at("s", 1).alias("first"))
