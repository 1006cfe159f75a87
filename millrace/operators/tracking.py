"""Sources, skeletons, schedules and queues: what is linked, reused, due, created or sent, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.names import skeleton_fingerprint

from .kinds import award_kind
from .matching import contains_any, ranked

# Hosts that are never products' pages.
SKIPPED_HOSTS = (
    "facebook.com", "twitter.com", "instagram.com", "youtube.com", "tiktok.com", "pinterest.com", "linkedin.com", "reddit.com", "cnn.com", "bbc.com",
    "nytimes.com", "theguardian.com", "washingtonpost.com", "usatoday.com", "foxnews.com", "amazon.com", "ebay.com", "walmart.com", "wikipedia.org",
    "yelp.com",
)
# Hours between the runs of a schedule; others run daily.
FREQUENCY_HOURS = {"hourly": 1, "every_6_hours": 6, "every_12_hours": 12, "daily": 24, "weekly": 168, "biweekly": 336, "monthly": 720, "quarterly": 2160}
# An award's medals by spelling, and the kinds of pictures.
AWARD_MEDALS = {
    "gold": "gold", "silver": "silver", "bronze": "bronze", "double gold": "double_gold", "double_gold": "double_gold", "best in class": "best_in_class",
    "best_in_class": "best_in_class", "category winner": "category_winner", "category_winner": "category_winner",
}
IMAGE_KINDS = ("bottle", "label", "packaging", "lifestyle")


def is_product_url(host: Column) -> Column:
    """Whether a URL may be a product's: all are but those of hosts that never are."""
    return ~contains_any(host, SKIPPED_HOSTS)


def needs_reorder(stock: Column, point: Column) -> Column:
    return stock <= point


def product_of_url(urls: DataFrame, products: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(url, product_id): the product whose own address a URL is, else that of the crawled source with the URL.

    products (product_id, source_url), sources (source_id, url), links (source_id, product_id); first by id.
    """
    own = products.groupBy(F.col("source_url").alias("url")).agg(F.min("product_id").alias("own"))
    first = links.groupBy("source_id").agg(F.min("product_id").alias("linked"))
    crawled = sources.groupBy("url").agg(F.min("source_id").alias("source_id")).join(first, "source_id", "left").select("url", "linked")
    return urls.join(own, "url", "left").join(crawled, "url", "left").select(*urls.columns, F.coalesce("own", "linked").alias("product_id"))


def reusable(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, content) for URLs that were extracted from before and whose content is still there."""
    good = sources.filter(F.col("status").isin("processed", "needs_review"))
    first = good.groupBy("url").agg(F.min(F.struct("source_id", "content")).alias("f")).select("url", F.col("f.content").alias("content"))
    return urls.join(first.filter("content <> ''"), "url", "inner")


def cleanup_eligible(flag: Column, archive: Column, extraction: Column, rule: str) -> Column:
    """Whether a source's raw content may go, by one of three rules that differ: the flag, the archive's state, or
    what was extracted and archived."""
    return {"flag": F.coalesce(flag, F.lit(False)), "archive": archive == "saved", "derived": (extraction == "processed") & (archive == "saved")}[rule]


def skeletons(awards: DataFrame, products: DataFrame) -> DataFrame:
    """Awards (award_id, name, producer, category, competition) with what becomes of them: ``skipped`` (no name, or a
    kind that isn't kept), ``added`` to a product known by fingerprint or by name without case, or ``created``.

    Later awards of a batch are added to the skeleton that an earlier one creates; products has (product_id, name,
    fingerprint). ``target`` is the known product, ``first`` the award that created the skeleton.
    """
    kind = award_kind(F.col("name"), F.col("category"), F.col("competition"))
    rows = awards.withColumn("kind", kind).withColumn("print", skeleton_fingerprint(F.col("name"), F.col("producer"))).withColumn("folded", F.lower("name"))
    valid = (F.coalesce("name", F.lit("")) != "") & F.col("kind").isNotNull()
    by_print = products.groupBy(F.col("fingerprint").alias("print")).agg(F.min("product_id").alias("p"))
    by_name = products.groupBy(F.lower("name").alias("folded")).agg(F.min("product_id").alias("n"))
    known = rows.join(by_print, "print", "left").join(by_name, "folded", "left").withColumn("target", F.least("p", "n"))
    # Equal fingerprints have equal names, so a batch's new awards are one skeleton if their names are equal.
    new = valid & F.col("target").isNull()
    first = known.filter(new).groupBy("folded").agg(F.min("award_id").alias("first"))
    found = known.join(first, "folded", "left").withColumn("first", F.when(new, F.col("first")))
    action = F.when(~valid, "skipped").when(F.col("target").isNotNull() | (F.col("first") != F.col("award_id")), "added").otherwise("created")
    return found.select("award_id", "kind", action.alias("action"), F.when(valid, F.col("target")).alias("target"), "first")


def unenriched(products: DataFrame, most: int) -> DataFrame:
    """The oldest skeletons that no page has enriched."""
    return products.filter((F.col("status") == "skeleton") & (F.col("source_url") == "")).orderBy("discovered_at", "product_id").limit(most)


def active_terms(terms: DataFrame, kinds: list[str], most: int = 20) -> DataFrame:
    """The active search terms of some kinds, highest priority first."""
    return terms.filter(F.col("is_active") & F.col("product_type").isin(*kinds)).orderBy(F.desc("priority"), "term_id").limit(most)


def next_run(frequency: Column, last: Column, now: Column) -> Column:
    """When a schedule runs again: its frequency after its last run, or after now if it never ran."""
    hours = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FREQUENCY_HOURS.items() for x in pair)), frequency), F.lit(24))
    return F.coalesce(last, now) + F.make_dt_interval(F.lit(0), hours)


def schedule_counters(runs: DataFrame, counters: list[str]) -> DataFrame:
    """Each schedule's totals over its runs, and how many there were; unknown counts are 0."""
    return runs.groupBy("schedule_id").agg(F.count("*").alias("total_runs"), *(F.sum(F.coalesce(c, F.lit(0))).alias(f"total_{c}") for c in counters))


def history(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with their place."""
    return ranked(rows, key, order, most)


def low_confidence(confidences: Column, least: float = 0.5) -> Column:
    """Fields whose confidence is below the threshold, from a map of lists: a list counts by its mean, an empty one as
    0.5, and null not at all."""
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.5)
    return F.array_sort(F.map_keys(F.map_filter(confidences, lambda _, v: v.isNotNull() & (mean(v) < least))))


def mean_confidence(confidences: Column) -> Column:
    """The mean of a record's field confidences; null without any."""
    values = F.map_values(confidences)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def awards_valid(rows: DataFrame) -> DataFrame:
    """Awards (product_id, pos, competition, year, medal, country, category) that can be stored, one for each
    (product, competition, year, medal): medals by their known spellings, Unknown and General where nothing is said."""
    medal = F.try_element_at(F.create_map(*(F.lit(x) for pair in AWARD_MEDALS.items() for x in pair)), F.lower("medal"))
    said = lambda c, otherwise: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(otherwise))
    rows = rows.withColumns({"medal": medal, "country": said("country", "Unknown"), "category": said("category", "General"), "competition": F.nullif(F.trim("competition"), F.lit(""))})
    fit = rows.filter("competition is not null and year is not null and year <> 0 and medal is not null")
    return ranked(fit, ["product_id", "competition", "year", "medal"], ["pos"], 1).drop("rank")


def ratings_valid(rows: DataFrame) -> DataFrame:
    """Ratings (product_id, pos, source, score, max_score) with all three, one for each (product, source, score)."""
    fit = rows.filter("coalesce(trim(source), '') <> '' and coalesce(score, 0) <> 0 and coalesce(max_score, 0) <> 0")
    return ranked(fit, ["product_id", "source", "score"], ["pos"], 1).drop("rank")


def images_valid(rows: DataFrame) -> DataFrame:
    """Pictures (product_id, pos, url, image_type, source) with all three and of a known kind, one for each URL."""
    fit = rows.filter("coalesce(trim(url), '') <> '' and coalesce(trim(source), '') <> ''").filter(F.col("image_type").isin(*IMAGE_KINDS))
    return ranked(fit, ["product_id", "url"], ["pos"], 1).drop("rank")


def structure_alerts(checks: DataFrame, prints: DataFrame, aborts: DataFrame) -> DataFrame:
    """(source, severity, kind, detail) of the alerts that go out: unhealthy selector checks (source, failed list,
    tested), changed page fingerprints (source, old, new), and crawls given up for low yield (source, pages, items)."""
    failed = F.size("failed")
    one = checks.filter(failed > 0).select(
        "source", F.when(failed > 1, "critical").otherwise("warning").alias("severity"), F.lit("selectors").alias("kind"), F.concat(failed, F.lit(" of "), "tested", F.lit(": "), F.array_join("failed", ", ")).alias("detail")
    )
    two = prints.filter("old <> new").select("source", F.lit("critical").alias("severity"), F.lit("fingerprint").alias("kind"), F.concat(F.substring("old", 1, 8), F.lit(" > "), F.substring("new", 1, 8)).alias("detail"))
    three = aborts.select("source", F.lit("warning").alias("severity"), F.lit("low_yield").alias("kind"), F.concat("items", F.lit(" items on "), "pages", F.lit(" pages")).alias("detail"))
    return one.unionByName(two).unionByName(three)


def reviewed(product: DataFrame, found: DataFrame, confidence: float, most_sources: int) -> DataFrame:
    """(product_id, field_name, value, url): what review pages add to products' fields, in order.

    found has (product_id, pos, url, matches, field_name, value): pages that aren't the product's are left out, then
    the first ``most_sources`` pages count. A field takes the first page's value if it is empty or less sure; product
    has (product_id, field_name, value, confidence).
    """
    pages = found.filter("matches").select("product_id", "pos").distinct()
    used = ranked(pages, ["product_id"], ["pos"], most_sources).select("product_id", "pos")
    told = found.filter(F.col("matches") & (F.coalesce(F.trim("value"), F.lit("")) != "")).join(used, ["product_id", "pos"], "left_semi")
    first = told.groupBy("product_id", "field_name").agg(F.min(F.struct("pos", "value", "url")).alias("f"))
    known = product.select("product_id", "field_name", F.col("value").alias("old"), F.col("confidence").alias("sure"))
    taken = first.join(known, ["product_id", "field_name"], "left").filter((F.coalesce(F.trim("old"), F.lit("")) == "") | (F.coalesce("sure", F.lit(0.0)) < confidence))
    return taken.select("product_id", "field_name", F.col("f.value").alias("value"), F.col("f.url").alias("url"))


def unique_names(rows: DataFrame, name: str, order: list[str], taken: DataFrame) -> DataFrame:
    """``rows`` with ``unique_name``: the first free of name, name-1, name-2, ..., none of them in ``taken`` (name) or
    given to an earlier row of the name.

    The numbers that are taken of each name are its gaps: a row's place among the free numbers is found by a window,
    without trying one after the other. Rows whose name itself looks like another's numbered one aren't told apart.
    """
    base = F.regexp_extract("name", r"^(.*?)(?:-(\d+))?$", 1)
    number = F.regexp_extract("name", r"^.*?-(\d+)$", 1).try_cast("int")
    used = taken.select("name").distinct()
    plain = used.select(F.col("name").alias(name), F.lit(0).alias("__n")).unionByName(used.filter(number >= 1).select(base.alias(name), number.alias("__n")))
    gaps = plain.groupBy(name).agg(F.array_sort(F.collect_set("__n")).alias("__gaps"))
    k = F.row_number().over(Window.partitionBy(name).orderBy(*order)) - 1
    placed = rows.withColumn("__k", k).join(gaps, name, "left")
    # The k-th free number is k and as many more as there are taken numbers up to it.
    free = F.aggregate(F.coalesce("__gaps", F.array().cast("array<int>")), F.col("__k"), lambda at, g: F.when(g <= at, at + 1).otherwise(at))
    return placed.withColumn("__n", free).withColumn("unique_name", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(name, F.lit("-"), "__n"))).drop("__k", "__gaps", "__n")
