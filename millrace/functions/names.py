"""Names in the several forms that matchers compare, their fingerprints, and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import fingerprint, json_text

# Abbreviations in names, in the order in which they are written out.
ABBREVIATIONS = {
    "ltd": "limited", "ed": "edition", "sgl": "single", "dist": "distillery", "vint": "vintage", "bbl": "barrel", "cs": "cask strength",
    "sc": "single cask", "ib": "independent bottler", "nr": "new release", "le": "limited edition",
}
# Kinds that don't tell skeleton names apart, in the order in which they are taken out.
SKELETON_WORDS = (
    "single malt", "single malt scotch", "single malt whisky", "single malt whiskey", "scotch whisky", "scotch whiskey", "blended scotch",
    "blended whisky", "blended whiskey", "irish whiskey", "irish whisky", "bourbon whiskey", "bourbon", "rye whiskey", "rye whisky",
    "japanese whisky", "japanese whiskey",
)
# What stands for no vintage.
NO_VINTAGE = ("n/a", "na", "none", "nv", "non-vintage", "nonvintage", "-", "")
MARKER = "\n\n[Content truncated...]"


def match_name(name: Column) -> Column:
    """A name for matching: lower case, without marks, quotes and a leading "the", years and spaces in one form."""
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for pattern, plain in ((r"\(r\)|\(tm\)|®|™", ""), (r"['\"`]", ""), (r"^the\s+", ""), (r"\byears\b", "year"), (r"\byrs\b", "year"), (r"(\d+)\s*y\.?o\.?", "$1 year"), (r"(\d+)\s*y/o", "$1 year"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, plain)
    return F.trim(out)


def expanded(name: Column) -> Column:
    """A name in lower case with its abbreviations written out."""
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for short, long in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", long)
    return out


def match_key(name: Column, brand: Column, abv: Column) -> Column:
    """brand:name:abv, by ``match_name``, of what there is."""
    return F.concat_ws(":", F.nullif(match_name(brand), F.lit("")), match_name(name), abv.cast("string"))


def skeleton_name(name: Column) -> Column:
    """A name for skeletons: kinds taken out in order, ages as "n year old", letters, digits and single spaces."""
    out = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    for words in SKELETON_WORDS:
        out = F.replace(out, F.lit(words), F.lit(""))
    for pattern, plain in ((r"(\d+)\s*y\.?o\.?", "$1 year old"), (r"(\d+)\s*years?\s*old", "$1 year old"), (r"[^\w\s]", ""), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, plain)
    return F.trim(out)


def vintage_year(text: Column, this_year: int) -> Column:
    """A year from 1900 to ``this_year``: the first such number of four digits as a word, else the whole text."""
    said = F.trim(text)
    found = F.regexp_extract(said, r"\b(19\d{2}|20\d{2})\b", 1)
    year = F.when(found != "", found.try_cast("int")).when(said.rlike(r"^[+-]?\d+$"), said.try_cast("int"))
    return F.when(~F.lower(said).isin(*NO_VINTAGE) & year.between(1900, this_year), year)


def name_fingerprint(name: Column, brand: Column) -> Column:
    """32 characters of the SHA-256 of name and brand; null without a name."""
    plain = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return F.when(plain(name) != "", F.substring(F.sha2(F.concat(plain(name), F.lit("|"), plain(brand)), 256), 1, 32))


def skeleton_fingerprint(name: Column, producer: Column) -> Column:
    plain = lambda c: json_text(F.trim(F.lower(F.coalesce(c, F.lit("")))))
    return fingerprint(name=plain(name), brand=plain(producer), type=F.lit('"skeleton"'))


def product_fingerprint(kind: Column, name: Column, brand: Column, volume: Column, abv: Column, details: dict[str, dict[str, Column]]) -> Column:
    """SHA-256 of a product's JSON: the common fields, and for each kind in ``details`` those of its own (as JSON)."""
    plain = lambda c: json_text(F.trim(F.lower(F.coalesce(c, F.lit("")))))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    common = {"name": plain(name), "brand": plain(brand), "product_type": json_text(kind), "volume_ml": number(volume), "abv": number(abv)}
    out = None
    for k, own in details.items():
        made = fingerprint(**common, **own)
        out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
    return fingerprint(**common) if out is None else out.otherwise(fingerprint(**common))


def truncated(text: Column, most_tokens: int, structured: bool = False) -> Column:
    """A text cut to a number of tokens, with a mark: at the end of a sentence, or of a tag, in its second half."""
    per = 2 if structured else 4
    room = most_tokens * per - len(MARKER)
    if room <= 0:
        return F.when(F.floor(F.length(text) / per) > most_tokens, F.lit(MARKER)).otherwise(text)
    head = F.substring(text, 1, room)
    last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1  # noqa: E731  place from 0
    place = lambda mark: F.when(F.instr(head, mark) > 0, last(mark)).otherwise(-1)
    end = place(">") if structured else F.greatest(*(place(m) for m in (". ", "! ", "? ", ".\n", "!\n", "?\n")))
    cut = F.when(end > room // 2, F.substr(head, F.lit(1), end + 1)).otherwise(head)
    cut = cut if structured else F.regexp_replace(cut, r"^\s+|\s+$", "")
    return F.when(F.floor(F.length(text) / per) > most_tokens, F.concat(cut, F.lit(MARKER))).otherwise(text)


def plain_price(text: Column) -> Column:
    """The first number after currency signs and all commas are taken out; null if there is none."""
    number = F.regexp_extract(F.translate(text, "£€$¥₹,", ""), r"(\d+\.?\d*)", 1)
    return F.when(number != "", number.try_cast("double"))


def product_queries(name: Column, brand: Column) -> Column:
    """struct of the searches for a product's price, reviews, pictures and news."""
    said, by = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(brand), F.lit(""))
    quoted = F.concat(F.lit('"'), said, F.lit('"'))
    parts = lambda *p: F.concat_ws(" ", *(F.lit(x) if isinstance(x, str) else x for x in p))
    return F.struct(
        parts(quoted, by, "buy price").alias("price"),
        parts(quoted, "review tasting notes rating").alias("review"),
        parts(said, by, "bottle whisky").alias("image"),
        parts(quoted, "whisky news").alias("news"),
    )


def as_text(value: Column, kind: str) -> Column:
    """A field's value as it is stored with its source: nothing is empty, lists are JSON, the rest as it is written."""
    if kind == "array":
        entries = F.transform(value, lambda x: json_text(x))
        return F.coalesce(F.concat(F.lit("["), F.array_join(entries, ", "), F.lit("]")), F.lit(""))
    if kind == "boolean":
        return F.when(value, "True").when(~value, "False").otherwise("")
    return F.coalesce(value.cast("string"), F.lit(""))
