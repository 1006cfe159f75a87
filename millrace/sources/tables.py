"""The driver tables, read through Spark with one rule for timestamps: UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``name`` of ``folder``; timestamps without a zone become UTC instants (the session's zone has to be UTC)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def price_history(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, retailer_id, price, observed_at, seq_a, seq_b): unit prices from lineitem, in the role of price
    observations; every seventh line of an order has no price. (seq_a, seq_b) breaks ties of the time.
    """
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("retailer_id"),
        F.when(F.col("l_linenumber") != 7, unit).alias("price"),
        F.col("l_shipdate").alias("observed_at"),
        F.col("l_orderkey").alias("seq_a"),
        F.col("l_linenumber").alias("seq_b"),
    )


PRICE_HISTORY_SQL = """
h as (
  select l_partkey as product_id, l_suppkey as retailer_id,
    case when l_linenumber <> 7 then l_extendedprice / l_quantity end as price,
    l_shipdate as observed_at, l_orderkey as seq_a, l_linenumber as seq_b
  from lineitem
)"""


def field_sources(spark: SparkSession, folder: str) -> DataFrame:
    """(product_id, source_id, field_name, extracted_value, confidence): what suppliers say of parts, in long form.

    A supplier's name, type and size of a part differ by supplier in a fixed way, so that fields agree or conflict.
    """
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    parts = table(spark, folder, "part")
    said = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    odd = F.col("l_suppkey") % 5
    wide = said.select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("source_id"),
        F.when(odd == 0, F.upper("p_name")).when(odd == 1, F.concat(F.lit(" "), "p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(odd == 2, F.lit("")).when(odd == 4, F.lit(None)).otherwise(F.col("p_type")).alias("type"),
        F.when(odd == 3, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.col("p_size").cast("string")).alias("size"),
    )
    long = wide.unpivot(["product_id", "source_id"], ["name", "type", "size"], "field_name", "extracted_value")
    confidence = (F.lit(50) + (F.col("source_id") * 7 + F.length("field_name")) % 50) / F.lit(100.0)
    return long.withColumn("confidence", F.round(confidence, 2))


FIELD_SOURCES_SQL = """
s as (select distinct l_partkey, l_suppkey from lineitem),
w as (
  select l_partkey as product_id, l_suppkey as source_id,
    case l_suppkey % 5 when 0 then upper(p_name) when 1 then ' ' || p_name else p_name end as name,
    case l_suppkey % 5 when 2 then '' when 4 then null else p_type end as type,
    case when l_suppkey % 5 = 3 then p_size::varchar || '.0' else p_size::varchar end as size
  from s join part on l_partkey = p_partkey
),
f as (
  select product_id, source_id, field_name, extracted_value,
    round((50 + (source_id * 7 + length(field_name)) % 50) / 100.0, 2) as confidence
  from (select product_id, source_id, 'name' as field_name, name as extracted_value from w
        union all select product_id, source_id, 'type', type from w
        union all select product_id, source_id, 'size', size from w)
)"""
