"""Flow queries: what is pending, what a clean-up would delete, which sources a product is built from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millrace.functions import fuzzy
from millrace.operators.matching import first_significant_word, ranked
from millrace.registry import query
from millrace.sources.tables import table

TABLES = ["lineitem", "orders", "part", "pages"]


@query("clear_dry_run", " union all ".join(f"select '{t}' as table_name, count(*) as deleted from {t}" for t in TABLES))
def clear_dry_run(spark, folder):
    """What a clean-up would delete, children before parents; counts from the files' footers."""
    counts = [table(spark, folder, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("deleted")) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("pending_archive", "select page_id from pages where page_id % 3 = 0 and page_id % 4 > 0 order by page_id limit 20")
def pending_archive(spark, folder):
    """Processed pages that aren't archived yet, oldest first."""
    return table(spark, folder, "pages").filter("page_id % 3 = 0 and page_id % 4 > 0").orderBy("page_id").limit(20).select("page_id")


_WORDS = lambda c: f"list_distinct([w for w in string_split_regex(lower(trim({c})), '\\s+') if w <> ''])"


@query("multi_source_pick", f"""with s as (select l_partkey, l_suppkey, p_name, case l_suppkey % 3 when 0 then p_name when 1 then p_name || ' extra' else 'other thing' end as said from (select distinct l_partkey, l_suppkey from lineitem) join part on p_partkey = l_partkey),
w as (select l_partkey, l_suppkey, {_WORDS('p_name')} as x, {_WORDS('said')} as y from s), k as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_suppkey) as rank from w where len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.6)
select l_partkey, l_suppkey, rank::int as rank from k where rank <= 3""")
def multi_source_pick(spark, folder):
    """The first three sources of a product whose name is similar enough."""
    said = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct().join(table(spark, folder, "part"), F.col("p_partkey") == F.col("l_partkey"))
    name = F.when(F.col("l_suppkey") % 3 == 0, F.col("p_name")).when(F.col("l_suppkey") % 3 == 1, F.concat("p_name", F.lit(" extra"))).otherwise("other thing")
    near = said.filter(fuzzy.jaccard(fuzzy.words(F.col("p_name")), fuzzy.words(name)) >= 0.6)
    return ranked(near, ["l_partkey"], ["l_suppkey"], 3).select("l_partkey", "l_suppkey", "rank")


@query("hub_resolve", "select s_suppkey, coalesce(case when s_suppkey % 3 > 0 then 'https://' || n_name || '.example' end, 'search:' || s_name) as site from supplier join nation on n_nationkey = s_nationkey")
def hub_resolve(spark, folder):
    """A brand's site: the link that its hub page has, else a search for its name."""
    joined = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    link = F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("https://"), "n_name", F.lit(".example")))
    return joined.select("s_suppkey", F.coalesce(link, F.concat(F.lit("search:"), "s_name")).alias("site"))


@query("job_outcomes", "select o_orderpriority, count(*) filter (where o_orderstatus = 'O') as created, count(*) filter (where o_orderstatus = 'P') as updated, count(*) filter (where o_orderstatus = 'F') as failed, count(*) as total from orders group by 1")
def job_outcomes(spark, folder):
    """Jobs by outcome, one pass."""
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(status("O").alias("created"), status("P").alias("updated"), status("F").alias("failed"), F.count("*").alias("total"))


@query("first_word_match", "with w as (select p_partkey, p_brand, lower(p_name) as n, [x for x in [regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g') for x in string_split_regex(lower(p_name), '\\s+')] if x <> '' and x not in ('the', 'a', 'an', 'le', 'la', 'el', 'los', 'las')][1] as word from part) select p_brand, word, min(p_partkey) as first_product, count(*) as products from w group by 1, 2")
def first_word_match(spark, folder):
    """Products of one brand whose names begin with one word count as known by the first of them."""
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", first_significant_word(F.col("p_name")).alias("word"))
    return rows.groupBy("p_brand", "word").agg(F.min("p_partkey").alias("first_product"), F.count("*").alias("products"))
