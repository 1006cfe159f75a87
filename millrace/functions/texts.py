"""Text functions as Column expressions: names, hashes, HTML, prices, ratings, ages, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spirit words that are dropped at the end of a name.
SPIRIT_ENDINGS = ("whisky", "whiskey", "rum", "vodka", "gin", "tequila", "brandy", "cognac")
# Accented Latin letters and the plain letters they stand for in names.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Review sites, the largest score there, and how a score is written.
REVIEW_SITES = {
    "whiskyadvocate.com": (100, r"(?i)(\d+)\s*points?"),
    "masterofmalt.com": (5, r"(?i)(\d+\.?\d*)\s*/\s*5"),
    "thewhiskyexchange.com": (5, r"(?i)(\d+\.?\d*)\s*(?:out of\s*)?5"),
    "whiskybase.com": (100, r"(?i)(\d+\.?\d*)\s*/\s*100"),
    "totalwine.com": (100, r"(?i)(\d+)\s*points?"),
}


def squeezed(text: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def content_hash(text: Column) -> Column:
    """SHA-256 of the squeezed text; empty for nothing."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.sha2(squeezed(text), 256))


def name_key(name: Column) -> Column:
    """A product name for matching: marks, accents, case, punctuation and a final spirit word don't count."""
    plain = F.translate(F.translate(F.coalesce(name, F.lit("")), "™®©", ""), ACCENTED, PLAIN)
    words = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(plain, r"[^\x00-\x7F]", "")), r"[^\w\s-]", ""), r"\s+", " ")
    for ending in SPIRIT_ENDINGS:
        words = F.regexp_replace(words, rf"\b{ending}\b\s*$", "")
    return F.trim(words)


def tokens(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of letters and digits with at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def token_estimate(text: Column, is_structured: Column | bool = False) -> Column:
    """About a token for four characters, for two in structured text."""
    structured = F.lit(is_structured) if isinstance(is_structured, bool) else is_structured
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / F.when(structured, 2).otherwise(4)).cast("bigint")


def currency(text: Column) -> Column:
    """USD unless another sign stands in the text; the dollar sign goes before the pound, the pound before the euro."""
    has = lambda sign: F.contains(text, F.lit(sign))
    return F.when(has("$"), "USD").when(has("£"), "GBP").when(has("€"), "EUR").otherwise("USD")


def price(text: Column) -> Column:
    """The first number of a price; with a euro sign a lone comma is the decimal sign, otherwise commas separate
    thousands. What isn't a number is 0.
    """
    number = F.regexp_extract(text, r"([\d,.]+)", 1)
    euro = (currency(text) == "EUR") & F.contains(number, F.lit(",")) & ~F.contains(number, F.lit("."))
    plain = F.when(euro, F.replace(number, F.lit(","), F.lit("."))).otherwise(F.replace(number, F.lit(","), F.lit("")))
    return F.coalesce(F.when(plain.rlike(r"^(\d+\.?\d*|\.\d+)$"), plain.try_cast("double")), F.lit(0.0))


def rating(source: Column, text: Column) -> Column:
    """struct(score, max_score) from a snippet: the site's own way of writing first, then common ones; null if none."""

    def found(pattern: str, most: int) -> Column:
        score = F.regexp_extract(text, pattern, 1)
        return F.when(score != "", F.struct(score.try_cast("double").alias("score"), F.lit(most).alias("max_score")))

    own = F.lit(None)
    for site, (most, pattern) in REVIEW_SITES.items():
        own = F.coalesce(own, F.when(source == site, found(pattern, most)))
    points = found(r"(?i)(\d+)\s*points?", 100)
    return F.coalesce(
        own,
        found(r"(\d+\.?\d*)\s*/\s*100", 100),
        found(r"(\d+\.?\d*)\s*/\s*5", 5),
        found(r"(?i)(\d+\.?\d*)\s*stars?", 5),
        F.when(points["score"].between(50, 100), points),
    )


def age_days(text: Column) -> Column:
    """Days of a relative date such as "3 weeks ago"; 9999 for what isn't one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda unit: F.regexp_extract(low, rf"(\d+)\s*{unit}s?\s*ago", 1)
    out = F.when(F.contains(low, F.lit("yesterday")), 1).when(count("hour") != "", 0)
    for unit, days in (("day", 1), ("week", 7), ("month", 30), ("year", 365)):
        out = out.when(count(unit) != "", count(unit).try_cast("int") * days)
    return out.otherwise(9999)


def age_designation(text: Column) -> Column:
    """A port's age, to tens, half to even; null below ten or without a number."""
    age = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+)", 1).try_cast("int")
    return F.when(age >= 10, F.greatest(F.bround(age / 10, 0).cast("int") * 10, F.lit(10)))


def basic_text(html: Column) -> Column:
    """Text of a page by ordered rules: scripts, styles, comments, tags, entities (& first), white space."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeezed(out)


def json_text(text: Column) -> Column:
    """A text as a JSON string with ASCII escapes left to the caller; null is ``null``."""
    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.coalesce(F.concat(F.lit('"'), quoted, F.lit('"')), F.lit("null"))


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, ``", "`` and ``": "`` between, and null kept as ``null``."""
    body = F.lit("{")
    for i, name in enumerate(sorted(fields)):
        body = F.concat(body, F.lit((", " if i else "") + f'"{name}": '), fields[name])
    return F.sha2(F.concat(body, F.lit("}")), 256)


# Spellings of medals, exact ones and, in this order, parts of longer ones.
MEDALS = {
    "gold": "gold", "gold medal": "gold", "gold award": "gold", "double gold": "double_gold", "double gold medal": "double_gold",
    "silver": "silver", "silver medal": "silver", "bronze": "bronze", "bronze medal": "bronze", "platinum": "platinum",
    "best in class": "best_in_class", "best in show": "best_in_show", "trophy": "trophy",
}


def medal(text: Column) -> Column:
    """A medal's key: by its exact spelling, else by the first spelling it contains (so a long "double gold" is gold)."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.when(low == "", "")
    for spelling, key in MEDALS.items():
        out = out.when(low == spelling, key)
    for spelling, key in MEDALS.items():
        out = out.when(F.contains(low, F.lit(spelling)), key)
    return out.otherwise(F.regexp_replace(low, r"\s+", "_"))


def populated(value: Column, kind: str) -> Column:
    """Whether a field counts as filled: 0 and false do, blank texts and empty lists don't."""
    if kind == "string":
        return F.coalesce(F.trim(value) != "", F.lit(False))
    if kind == "array":
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull()
