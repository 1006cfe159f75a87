"""Price queries: unit prices of lineitem in the role of price observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import prices as P
from millrace.registry import query
from millrace.sources.tables import PRICE_HISTORY_SQL, price_history, table

AS_OF, SHORT, LONG = "1998-09-01", 360, 1080
TIES = ["seq_a", "seq_b"]


def _trend_sql(days: int) -> str:
    return f"""
  select product_id, count(*) as n, avg(case when rn <= n_all // 2 and price <> 0 then price end) as a, avg(case when rn > n_all // 2 and price <> 0 then price end) as b
  from (select *, row_number() over (partition by product_id order by observed_at, seq_a, seq_b) as rn, count(*) over (partition by product_id) as n_all
        from h where observed_at >= timestamp '{AS_OF}' - interval {days} days and observed_at <= timestamp '{AS_OF}') group by product_id"""


@query(
    "price_trend",
    f"""with {PRICE_HISTORY_SQL}, m as ({_trend_sql(SHORT)}), c as (select *, case when n >= 2 then (b - a) / a * 100 end as change from m)
select product_id, n, round(change, 2) + 0 as change_pct, case when change > 5 then 'rising' when change < -5 then 'falling' when change is not null then 'stable' end as trend from c""",
)
def price_trend(spark: SparkSession, folder: str) -> DataFrame:
    return P.price_trend(P.since(price_history(spark, folder), AS_OF, SHORT), TIES)


@query(
    "price_trend_long",
    f"""with {PRICE_HISTORY_SQL}, m as ({_trend_sql(LONG)}), c as (select *, case when n >= 2 then (b - a) / a * 100 end as change from m)
select product_id, n, round(change, 2) + 0 as change_pct, case when change > 5 then 'rising' when change < -5 then 'falling' when change is not null then 'stable' end as trend from c""",
)
def price_trend_long(spark: SparkSession, folder: str) -> DataFrame:
    return P.price_trend(P.since(price_history(spark, folder), AS_OF, LONG), TIES)


@query(
    "price_stability",
    f"""with {PRICE_HISTORY_SQL}, m as (select product_id, count(price) as n_prices, stddev_samp(price) / avg(price) as v from h where price is not null group by product_id)
select product_id, n_prices, case when n_prices < 2 then null when v <= 0.01 then 10 when v <= 0.05 then 9 when v <= 0.10 then 8 when v <= 0.15 then 7 when v <= 0.20 then 6
  when v <= 0.25 then 5 when v <= 0.30 then 4 when v <= 0.40 then 3 when v <= 0.50 then 2 else 1 end as stability from m""",
)
def price_stability(spark: SparkSession, folder: str) -> DataFrame:
    return P.price_stability(price_history(spark, folder))


@query(
    "price_extremes",
    f"""with {PRICE_HISTORY_SQL}, lo as (select *, row_number() over (partition by product_id order by price, observed_at, seq_a, seq_b) as r from h where price is not null),
hi as (select *, row_number() over (partition by product_id order by price desc, observed_at, seq_a, seq_b) as r from h where price is not null)
select lo.product_id, lo.price as lowest_price, lo.observed_at::date::varchar as lowest_date, hi.price as highest_price, hi.observed_at::date::varchar as highest_date
from lo join hi using (product_id) where lo.r = 1 and hi.r = 1""",
)
def price_extremes(spark: SparkSession, folder: str) -> DataFrame:
    days = {c: F.col(c).cast("string") for c in ("lowest_date", "highest_date")}
    return P.price_extremes(price_history(spark, folder), TIES).withColumns(days)


@query(
    "price_alerts",
    f"""with {PRICE_HISTORY_SQL}, t as (select p_partkey as product_id, p_retailprice * 0.95 as threshold from part where p_partkey % 3 > 0),
r as (select h.*, threshold, min(price) over w as low_before, coalesce(max(case when price < threshold then 1 else 0 end) over w, 0) as dropped
      from h left join t using (product_id) where price is not null
      window w as (partition by h.product_id order by observed_at, seq_a, seq_b rows between unbounded preceding and 1 preceding))
select product_id, observed_at, seq_a, seq_b, price, 'price_drop' as alert_type from r where price < threshold and dropped = 0
union all select product_id, observed_at, seq_a, seq_b, price, 'new_low' from r where price < low_before""",
)
def price_alerts(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").filter("p_partkey % 3 > 0")
    thresholds = parts.select(F.col("p_partkey").alias("product_id"), (F.col("p_retailprice") * 0.95).alias("threshold"))
    return P.price_alerts(price_history(spark, folder), thresholds, TIES)


@query(
    "best_price",
    f"""with {PRICE_HISTORY_SQL}, r as (select *, row_number() over (partition by product_id order by price, seq_a, seq_b) as k from h where price > 0)
select product_id, price as best_price, retailer_id from r where k = 1""",
)
def best_price(spark: SparkSession, folder: str) -> DataFrame:
    return P.best_price(price_history(spark, folder), TIES)


@query(
    "availability_agg",
    f"""with {PRICE_HISTORY_SQL}
select product_id, count(*) as retailer_count, count(*) filter (where retailer_id % 4 > 0) as in_stock_count, round(avg(price), 2) as price_avg, min(price) as price_min, max(price) as price_max
from h group by product_id""",
)
def availability_agg(spark: SparkSession, folder: str) -> DataFrame:
    return P.availability(price_history(spark, folder).withColumn("in_stock", F.col("retailer_id") % 4 > 0))


@query("products_with_prices", "select p_partkey as product_id from part where exists (select 1 from lineitem where l_partkey = p_partkey)")
def products_with_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Existence, not a join: one row a product however many prices it has."""
    lines = table(spark, folder, "lineitem").select("l_partkey")
    return table(spark, folder, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_partkey").alias("product_id"))
