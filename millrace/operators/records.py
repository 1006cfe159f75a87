"""Records as they come from extraction: casts, aliases, nested fields, lists to rows, upserts, source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_int(text: Column) -> Column:
    """The integer a text begins its digits with, signs and thousands commas allowed; null if there is none."""
    return F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit("")), r"^(-?\d+)", 1).try_cast("int")


def safe_float(text: Column) -> Column:
    return F.replace(F.replace(F.trim(text), F.lit(","), F.lit("")), F.lit("%"), F.lit("")).try_cast("double")


def safe_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def safe_date(text: Column) -> Column:
    """Year-month-day or day/month/year."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"))


def safe_list(text: Column) -> Column:
    """A comma-separated list without blanks; never null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def first_of(*values: Column) -> Column:
    """The first value that isn't blank: aliases and nested spellings of one field."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def exploded(rows: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """A JSON list's entries as rows, with their place; what isn't a list of objects gives none."""
    parsed = rows.select(key, F.posexplode(F.from_json(column, f"array<{schema}>")).alias("pos", "x"))
    return parsed.select(key, "pos", "x.*")


def upserted(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``old`` with each key's last row of ``new`` (by ``order``) in place of its own, and new keys added."""
    from .monitoring import latest

    keyed = new.withColumn("__key", F.struct(*key))
    last = latest(keyed, "__key", order).drop("__key")
    return old.join(last, key, "left_anti").unionByName(last.select(*old.columns))


def import_action(new: DataFrame, old: DataFrame, key: list[str], valid: Column) -> DataFrame:
    """``new`` with ``action``: skipped (not valid), updated (known key), or created."""
    known = old.select(*key).distinct().withColumn("__known", F.lit(True))
    action = F.when(~valid, "skipped").when(F.col("__known"), "updated").otherwise("created")
    return new.join(known, key, "left").withColumn("action", action).drop("__known")


def source_record(url: Column, content: Column) -> Column:
    """struct(content, title): at most 500,000 characters, and the last path part as title, at most 100."""
    path = F.rtrim(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z]+://[^/]*", ""), F.lit("/"))
    return F.struct(F.substring(content, 1, 500_000).alias("content"), F.substring(F.element_at(F.split(path, "/"), -1), 1, 100).alias("title"))


def cleaned_up(sources: DataFrame, eligible: Column, limit: int | None = None) -> DataFrame:
    """Sources whose raw content can go: eligible, archived, and not empty already; oldest first."""
    due = sources.filter(eligible).filter("raw_content is not null and raw_content <> ''")
    due = due if limit is None else due.orderBy("crawled_at", "source_id").limit(limit)
    return due.withColumn("raw_content", F.lit(None).cast("string"))


# Names of categories by whiskey type, and objects whose fields belong to the record itself.
CATEGORY_NAMES = {
    "scotch_single_malt": "Single Malt Scotch Whisky", "scotch_blend": "Blended Scotch Whisky", "bourbon": "Bourbon", "tennessee": "Tennessee Whiskey",
    "rye": "Rye Whiskey", "american_single_malt": "American Single Malt", "irish_single_pot": "Irish Single Pot Still",
    "irish_single_malt": "Irish Single Malt", "irish_blend": "Blended Irish Whiskey", "japanese": "Japanese Whisky", "canadian": "Canadian Whisky",
    "indian": "Indian Whisky", "taiwanese": "Taiwanese Whisky", "australian": "Australian Whisky", "world_whiskey": "World Whisky",
}
NESTED = ("appearance", "tasting_evolution", "ratings", "production")
NOTES = {"nose_description": "nose", "palate_description": "palate", "finish_description": "finish"}
NOTE_LISTS = {"primary_aromas": "nose_aromas", "palate_flavors": "palate_flavors", "finish_flavors": "finish_flavors"}


def normalized(data: str) -> dict[str, Column]:
    """Columns of a record in JSON: names by their aliases, notes from the tasting notes, the category from the whiskey
    type where none is given; further fields are found at the top or, unless they are there, in a nested object."""
    at = lambda path: F.nullif(F.get_json_object(data, f"$.{path}"), F.lit(""))
    kind = at("whiskey_type")
    named = F.create_map(*(F.lit(x) for pair in CATEGORY_NAMES.items() for x in pair))
    derived = F.coalesce(F.try_element_at(named, kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))
    out = {"name": F.coalesce(at("name"), at("product_name")), "brand": F.coalesce(at("brand"), at("producer")), "category": F.coalesce(at("category"), derived)}
    out |= {field: F.coalesce(at(field), at(f"tasting_notes.{note}")) for field, note in (NOTES | NOTE_LISTS).items()}
    return out


def nested_field(data: str, field: str) -> Column:
    """A field of a record in JSON, from the top, else from the first nested object that has it."""
    return F.coalesce(F.get_json_object(data, f"$.{field}"), *(F.get_json_object(data, f"$.{o}.{field}") for o in NESTED))


CASTS = {"string": lambda c: F.nullif(F.trim(c), F.lit("")), "int": safe_int, "float": safe_float, "bool": safe_bool, "date": safe_date, "list": safe_list}


def mapped_fields(rows: DataFrame, key: str, data: str, mapping: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, the mapping's fields): each from its key in a JSON record, by its kind of cast."""
    return rows.select(key, *(CASTS[kind](F.get_json_object(data, f"$.{source}")).alias(field) for field, (source, kind) in mapping.items()))


def cleared(tables: dict[str, DataFrame], order: list[str], dry_run: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables afterwards, (table_name, deleted)): all rows of the tables in ``order``, children first, deleted;
    a dry run leaves the tables as they are."""
    from functools import reduce

    counts = [tables[t].agg(F.lit(t).alias("table_name"), F.count("*").alias("deleted")) for t in order]
    after = tables if dry_run else {n: df.limit(0) if n in order else df for n, df in tables.items()}
    return after, reduce(lambda a, b: a.unionByName(b), counts)


def stored_source(sources: DataFrame, crawled: DataFrame) -> DataFrame:
    """Crawled sources (url, title, raw_content, content_hash, source_type, preprocessed) after an upsert by URL: what
    was crawled last (by ``crawled_at``) replaces; preprocessed content and its time stay where none is new."""
    from .monitoring import latest

    new = latest(crawled, "url", [F.desc("crawled_at"), F.desc("raw_content")]).withColumn("content_hash", F.sha2("raw_content", 256))
    both = sources.alias("o").join(new.alias("n"), "url", "full")
    hit = F.col("n.raw_content").isNotNull()
    take = lambda c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select("url", *(take(c) for c in ("title", "raw_content", "content_hash", "source_type")), F.coalesce("n.preprocessed", "o.preprocessed").alias("preprocessed"))


def resolve_brands(records: DataFrame, brands: DataFrame) -> DataFrame:
    """records (record_id, brand, distillery, producer, producer_house) with ``name``, ``slug`` and the known
    ``brand_id``, by name without case, then by slug; ``created`` where neither is known, null without any name.

    The name is the first of the four that is filled; a distillery's goes without that word.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    plain = F.trim(F.replace(said("distillery"), F.lit(" Distillery"), F.lit("")))
    rows = records.withColumn("name", F.coalesce(said("brand"), F.nullif(plain, F.lit("")), said("producer"), said("producer_house")))
    rows = rows.withColumn("folded", F.lower("name")).withColumn("slug", F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-")))
    by_name = brands.groupBy(F.lower("name").alias("folded")).agg(F.min("brand_id").alias("a"))
    by_slug = brands.groupBy("slug").agg(F.min("brand_id").alias("b"))
    found = rows.join(by_name, "folded", "left").join(by_slug, "slug", "left").withColumn("brand_id", F.coalesce("a", "b"))
    return found.select("record_id", "name", "slug", "brand_id", F.when(F.col("name").isNotNull(), F.col("brand_id").isNull()).alias("created"))
