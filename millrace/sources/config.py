"""Configuration from JSON: files, upserts with what became of each row, sources, search terms, extraction answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import kinds as K

SOURCE = "struct<name:string,base_url:string,product_type:string>"
TERM = "struct<query:string,product_type:string,priority:int>"
FIELD = "struct<field_name:string,product_type:string,field_type:string,field_group:string,sort_order:int,is_active:boolean>"
# What every imported source starts with.
SOURCE_DEFAULTS = {"priority": 5, "crawl_frequency_hours": 168, "rate_limit_requests_per_minute": 5}


def read_config(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, or folder of files, that hold a JSON list each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All rows after an upsert, with ``action``: created, updated, unchanged, or kept (not in ``new``).

    Of several new rows of a key the last by ``order`` counts; columns are ``old``'s.
    """
    values = [c for c in old.columns if c not in key]
    last = new.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__k = 1").select(*old.columns)
    was, now = (df.select(*key, F.struct(*values).alias(n)) for df, n in ((old, "was"), (last, "now")))
    action = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "created").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    both = was.join(now, key, "full").withColumn("action", action).withColumn("v", F.coalesce("now", "was"))
    return both.select(*key, "v.*", "action")


def parsed(rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """(key, the fields) of a JSON object in each row; rows that aren't objects are left out."""
    return rows.select(key, F.from_json(column, schema).alias("x")).filter("x is not null").select(key, "x.*")


def import_sources(file: DataFrame, key: str, column: str, known: DataFrame) -> DataFrame:
    """Sources of a file (one JSON object a row) as records, with ``action``: skipped where the slug is known, in the
    table (``known``: slug) or in an earlier row of the file by ``key``; else created.
    """
    rows = parsed(file, key, column, SOURCE)
    slug = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    address = F.lower("base_url")
    rows = rows.withColumn("slug", slug).withColumn("category", K.source_category(F.col("name"), F.col("base_url")))
    rows = rows.withColumn("javascript", K.contains_any(address, K.SCRIPTED_SOURCES)).withColumn("proxy", K.contains_any(address, K.PROXIED_SOURCES))
    rows = rows.withColumns({c: F.lit(v) for c, v in SOURCE_DEFAULTS.items()})
    first = F.row_number().over(Window.partitionBy("slug").orderBy(key)) == 1
    marked = rows.withColumn("first", first).join(known.select("slug").distinct().withColumn("known", F.lit(True)), "slug", "left")
    return marked.withColumn("action", F.when(F.col("known") | ~F.col("first"), "skipped").otherwise("created")).drop("known", "first")


def import_terms(file: DataFrame, key: str, column: str, known: DataFrame, kinds: list[str]) -> DataFrame:
    """Search terms of a file with ``action``: skipped without a query or with an unknown kind, updated where
    (query, product_type) is known, else created."""
    rows = parsed(file, key, column, TERM)
    valid = F.coalesce((F.trim("query") != "") & F.col("product_type").isin(*kinds), F.lit(False))
    marked = rows.join(known.select("query", "product_type").distinct().withColumn("known", F.lit(True)), ["query", "product_type"], "left")
    return marked.withColumn("action", F.when(~valid, "skipped").when(F.col("known"), "updated").otherwise("created")).drop("known")


def field_schemas(fields: DataFrame) -> DataFrame:
    """(product_type, schema): each kind's active fields, with those common to all (no kind), by group, order and name,
    as a JSON list of names and types."""
    active = fields.filter("is_active")
    own = active.filter("product_type is not null")
    kinds = [r["product_type"] for r in own.select("product_type").distinct().collect()]  # configuration: a few kinds
    common = active.filter("product_type is null").withColumn("product_type", F.explode(F.array(*map(F.lit, kinds)).cast("array<string>")))
    every = own.unionByName(common)
    entry = F.struct("field_group", "sort_order", "field_name", "field_type")
    listed = every.groupBy("product_type").agg(F.array_sort(F.collect_set(entry)).alias("f"))
    named = F.transform("f", lambda x: F.struct(x["field_name"].alias("name"), x["field_type"].alias("type")))
    return listed.select("product_type", F.to_json(named).alias("schema"))


PRODUCT = "struct<product_data:map<string,string>,field_confidences:map<string,double>,confidence:double>"
IMPORTANT, OPTIONAL = ["brand", "abv", "country"], ["region", "description"]


def extracted(responses: DataFrame, key: str, column: str, enums: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, pos, data, confidences, confidence) of an extraction answer's ``products``.

    Values of enumerated fields become the known spelling or go; a missing or zero confidence is worked out from the
    fields that are filled.
    """
    from millrace.operators.scoring import record_confidence

    parsed_list = F.from_json(F.get_json_object(column, "$.products"), f"array<{PRODUCT}>")
    rows = responses.select(key, F.posexplode(parsed_list).alias("pos", "p")).select(key, "pos", "p.*")

    def known(field: Column, value: Column) -> Column:
        out = value
        for name, allowed in enums.items():
            plain = F.lower(F.trim(value))
            out = F.when(field == name, F.when(plain.isin(*allowed), plain)).otherwise(out)
        return out

    data = F.map_filter(F.transform_values("product_data", known), lambda _, v: v.isNotNull())
    rows = rows.withColumn("data", data)
    of = lambda f: F.try_element_at("data", F.lit(f))
    told = record_confidence(of("name"), [of(f) for f in IMPORTANT], [of(f) for f in OPTIONAL])
    sure = F.when(F.coalesce("confidence", F.lit(0.0)) > 0, F.col("confidence")).otherwise(told)
    return rows.select(key, "pos", "data", F.col("field_confidences").alias("confidences"), sure.alias("confidence"))


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Events (costs, errors) added to a table of Parquet files, in a folder for each value of ``by``."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def costs(requests: DataFrame, prices: dict[str, int]) -> DataFrame:
    """(service, cost_cents, request_count, crawl_job_id, timestamp): what requests (service, n, job_id, ts) cost."""
    price = reduce(lambda out, p: F.when(F.col("service") == p[0], p[1]).otherwise(out), prices.items(), F.lit(0))
    return requests.select("service", (price * F.col("n")).cast("bigint").alias("cost_cents"), F.col("n").alias("request_count"), F.col("job_id").alias("crawl_job_id"), F.col("ts").alias("timestamp"))


def update_columns(target: DataFrame, updates: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``target`` with only the given columns taken from ``updates`` (one row a key), where there is one."""
    new = updates.select(*key, F.struct(*columns).alias("__new"))
    return target.join(new, key, "left").select(*(F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))
