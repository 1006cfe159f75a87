"""Entity resolution: cascades of exact matches, blocked fuzzy matches, validators, variants and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import fuzzy
from millrace.functions.names import match_name
from millrace.functions.texts import name_key
from millrace.sources.scratch import settled

# Words that don't tell products apart, and kinds that exclude each other.
STOPWORDS = ("the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for")
CATEGORY_WORDS = (
    "whisky", "whiskey", "port", "wine", "spirit", "spirits", "liquor", "scotch", "bourbon", "malt", "blended", "single", "straight",
    "tawny", "ruby", "vintage", "lbv", "year", "years", "old", "aged", "cask", "strength", "reserve", "edition", "limited", "special",
    "release", "collection", "batch", "bottled", "highland", "speyside", "islay", "lowland", "campbeltown", "kentucky",
)
EXCLUSIVE = (
    (("bourbon",), ("rye whiskey", "straight rye", "rye whisky", "corn whiskey")),
    (("single malt",), ("blended", "blend")),
    (("vintage",), ("lbv", "late bottled vintage")),
    (("tawny",), ("ruby",)),
)
VARIANTS = {
    "cask_finish": (
        "sherry", "port", "rum", "wine", "madeira", "cognac", "sauternes", "burgundy", "bordeaux", "champagne", "pedro ximenez", "px", "oloroso", "moscatel",
        "triple cask", "double cask", "triple wood", "double wood", "quarter cask", "first fill", "second fill",
    ),
    "cask_strength": ("cask strength", "cs", "full strength", "barrel proof", "barrel strength", "original proof", "natural cask strength"),
    "travel_retail": ("travel retail", "travel exclusive", "duty free", "airport exclusive", "tr exclusive"),
    "limited_edition": ("limited edition", "limited release", "special edition", "special release", "collectors edition", "anniversary", "commemorative", "rare", "exclusive"),
}
# Of the second validator, words in names that exclude each other, and words that don't count.
EXCLUSIVE_V2 = (
    ("bourbon", "rye"), ("bourbon", "wheat"), ("single malt", "blended"), ("scotch", "bourbon"), ("irish", "scotch"), ("tawny", "ruby"),
    ("vintage", "lbv"), ("10 year", "20 year"), ("12 year", "18 year"),
)
STOPWORDS_V2 = ("the", "a", "an", "and", "of", "for", "with", "by", "from")
ARTICLES = ("the", "a", "an", "le", "la", "el", "los", "las")
LEAST_OVERLAP = 0.3


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def brand_key(brand: Column) -> Column:
    """A brand without apostrophes, with spaces for hyphens, and without a leading "the"."""
    plain = F.translate(F.lower(F.trim(F.coalesce(brand, F.lit("")))), "'’‘`", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("-"), F.lit(" ")), r"\s+", " "), r"^the ", ""))


def telling_words(name: Column) -> Column:
    """Distinct words of at least three letters or digits that aren't common or of a category."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’]s?\\b", "")
    found = F.array_distinct(F.split(cleaned, r"[^\w]+"))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS, *CATEGORY_WORDS))


def brands_agree(a: Column, b: Column) -> Column:
    x, y = brand_key(a), brand_key(b)
    return (x == "") | (y == "") | F.contains(x, y) | F.contains(y, x)


def kinds_agree(a: Column, b: Column) -> Column:
    """Whether two texts name no kinds that exclude each other."""
    clash = F.lit(False)
    for one, other in EXCLUSIVE:
        clash = clash | (contains_any(a, one) & contains_any(b, other)) | (contains_any(a, other) & contains_any(b, one))
    return ~clash


def overlap(a: Column, b: Column, of: str = "max") -> Column:
    """Shared words over the larger (or smaller) number of words; null without words on either side."""
    size = (F.greatest if of == "max" else F.least)(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / size)


def validation(a_brand: Column, b_brand: Column, a_text: Column, b_text: Column, a_name: Column, b_name: Column, of: str = "max") -> Column:
    """Why extracted data aren't the product's, or that they are: the brand, then kinds, then the names' words."""
    share = overlap(telling_words(a_name), telling_words(b_name), of)
    return (
        F.when(~brands_agree(a_brand, b_brand), "brand_mismatch")
        .when(~kinds_agree(F.lower(a_text), F.lower(b_text)), "product_type_mismatch")
        .when(share < LEAST_OVERLAP, "name_mismatch")
        .otherwise("product_match_validated")
    )


def validation_v2(a_brand: Column, b_brand: Column, a_name: Column, b_name: Column) -> Column:
    """Why extracted data (b) aren't the target's (a), by the second validator: a brand that neither contains, a word
    of a pair where the other name has only the pair's other word, or under 30 % of the smaller name's words shared."""
    plain = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    x, y, m, n = plain(a_brand), plain(b_brand), plain(a_name), plain(b_name)
    has = lambda text, word: F.contains(text, F.lit(word))
    clash = F.lit(False)
    for one, other in EXCLUSIVE_V2:
        for p, q in ((one, other), (other, one)):
            clash = clash | (has(m, p) & has(n, q) & ~has(n, p))
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS_V2)))
    return (
        F.when(n == "", "no_name_extracted")
        .when((x != "") & (y != "") & ~F.contains(y, x) & ~F.contains(x, y), "brand_mismatch")
        .when(clash, "product_type_mismatch")
        .when(overlap(words(m), words(n), "min") < LEAST_OVERLAP, "name_mismatch")
        .otherwise("match")
    )


def first_significant_word(name: Column) -> Column:
    """The first word, letters and digits only, that isn't an article."""
    found = F.filter(F.transform(F.split(F.lower(name), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: (w != "") & ~w.isin(*ARTICLES))
    return F.get(found, F.lit(0))


def match_confidence(same_brand: Column, a_words: Column, b_words: Column) -> Column:
    """0.7, 0.15 for the brand, up to 0.15 for shared words; doubles, so that 0.7 + 0.15 reaches 0.85."""
    return F.lit(0.7) + F.when(same_brand, 0.15).otherwise(0.0) + fuzzy.jaccard(a_words, b_words) * 0.15


def words_holding(said: DataFrame, asked: DataFrame, least: int = 3) -> DataFrame:
    """(said, word): which of the words ``said`` contain which of those ``asked`` for, of ``least`` characters or more.

    Each different word's parts are listed once and joined by equality, so rows grow with the vocabulary.
    """
    said = said.distinct().filter(F.length("said") >= least)
    starts = said.select("said", F.explode(F.sequence(F.lit(1), F.length("said") - (least - 1))).alias("i"))
    lengths = F.sequence(F.lit(least), F.length("said") - F.col("i") + 1)
    parts = starts.select("said", F.explode(F.transform(lengths, lambda n: F.substr("said", F.col("i"), n))).alias("word")).distinct()
    return parts.join(asked.distinct(), "word", "left_semi").select("said", "word")


def known_by_first_word(probes: DataFrame, products: DataFrame) -> DataFrame:
    """(probe_id): probes (probe_id, name, brand) whose brand, without case, some product (name, brand) has whose name
    contains the probe's first word; a probe without a brand may meet any."""
    by = lambda c: F.coalesce(F.lower(c), F.lit(""))
    first = F.get(F.split(F.trim(F.lower("name")), r"\s+"), F.lit(0))
    asked = probes.select("probe_id", by(F.col("brand")).alias("by"), first.alias("word")).filter("word <> ''")
    listed = products.select(by(F.col("brand")).alias("b"), F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("said"))
    listed = listed.select(F.explode(F.array_distinct(F.array("b", F.lit("")))).alias("by"), "said").distinct()
    keys = listed.join(words_holding(listed.select("said"), asked.select("word"), 1), "said").select("by", "word").distinct()
    return asked.join(keys, ["by", "word"], "left_semi").select("probe_id").distinct()


def block_matches(probes: DataFrame, products: DataFrame, cap: int = 10) -> DataFrame:
    """(probe_id, product_id, confidence): each probe's best product, if the confidence is 0.85 or more.

    A probe (probe_id, name, brand, kind) meets the ``cap`` newest (by ``discovered``) products (product_id, name,
    brand, kind, discovered) of its kind, and of its brand if it has one, whose name contains the probe's first
    significant word. What probes ask for, (kind, brand, word), is looked up among the words that products' names
    are made of, so all joins are of equal keys; only the newest of each key meet probes.
    """
    brand_of = lambda c: F.coalesce(F.trim(F.lower(c)), F.lit(""))
    probes = probes.withColumn("word", first_significant_word(F.col("name"))).withColumn("by", brand_of(F.col("brand"))).filter(F.length("word") >= 3)
    asked = probes.select("kind", "by", "word").distinct()
    listed = products.select("product_id", F.col("name").alias("p_name"), F.col("brand").alias("p_brand"), "kind", "discovered")
    listed = listed.withColumn("said", F.explode(F.array_distinct(F.split(F.lower("p_name"), r"\s+"))))
    held = words_holding(listed.select("said"), asked.select("word"))
    by = F.explode(F.array_distinct(F.array(brand_of(F.col("p_brand")), F.lit("")))).alias("by")
    keyed = listed.join(held, "said").select("product_id", "p_name", "p_brand", "kind", "discovered", "word", by).distinct().join(asked, ["kind", "by", "word"], "left_semi")
    newest = Window.partitionBy("kind", "by", "word").orderBy(F.desc("discovered"), "product_id")
    keyed = keyed.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= cap)
    pairs = probes.join(keyed, ["kind", "by", "word"])
    same = (F.col("by") != "") & (F.col("by") == brand_of(F.col("p_brand")))
    scored = pairs.withColumn("confidence", F.least(F.lit(1.0), match_confidence(same, fuzzy.words(F.col("name")), fuzzy.words(F.col("p_name")))))
    best = scored.filter(F.col("confidence") >= 0.85).groupBy("probe_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rn", "product_id")).alias("b"))
    return best.select("probe_id", F.col("b.product_id").alias("product_id"), (-F.col("b.c")).alias("confidence"))


def cascade(probes: DataFrame, products: DataFrame) -> DataFrame:
    """(probe_id, product_id, method, confidence): by GTIN (1.0), then fingerprint (0.95), else none.

    Of several products with one key the newest counts. GTINs are compared without spaces and dashes.
    """
    def first(key: Column, name: str) -> DataFrame:
        keyed = products.select(key.alias("k"), F.struct(F.col("discovered").alias("d"), (-F.col("product_id")).alias("p")).alias("x"))
        return keyed.filter("k is not null and k <> ''").groupBy("k").agg((-F.max("x")["p"]).alias(name))

    plain = lambda c: F.translate(F.col(c), " -", "")
    found = probes.join(first(plain("gtin"), "by_gtin"), plain("gtin") == F.col("k"), "left").drop("k")
    found = found.join(first(F.col("fingerprint"), "by_print"), F.col("fingerprint") == F.col("k"), "left").drop("k")
    method = F.when(F.col("by_gtin").isNotNull(), "gtin").when(F.col("by_print").isNotNull(), "fingerprint").otherwise("new")
    sure = F.when(method == "gtin", 1.0).when(method == "fingerprint", 0.95).otherwise(0.0)
    return found.select("probe_id", F.coalesce("by_gtin", "by_print").alias("product_id"), method.alias("method"), sure.alias("confidence"))


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out evenly before Python compares them: few bytes of pairs are much work, which adaptive execution,
    going by bytes, would leave to a task or two."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*pairs.columns))


def fuzzy_matches(probes: DataFrame, products: DataFrame, cap: int = 100, threshold: float = 0.85) -> DataFrame:
    """(probe_id, product_id, score, confidence) of the fuzzy stage: each probe's best accepted product.

    A probe (probe_id, name, brand, abv, kind) meets the ``cap`` newest products of its kind (all kinds without one)
    that have its brand in their brand or name, as a run of whole words (without a brand: all products). Products are
    listed under the runs of words that probes ask for, so the joins are of equal keys.
    """
    side = lambda df: df.withColumn("plain", match_name(F.col("name"))).withColumn("brand_plain", match_name(F.col("brand"))).filter("plain <> ''")
    kind_of = F.coalesce(F.col("kind"), F.lit(""))
    left = side(probes).withColumn("asked_kind", kind_of)
    asked = left.select("brand_plain", "asked_kind", F.size(F.split("brand_plain", " ")).alias("run")).distinct()
    runs = [r["run"] for r in asked.select("run").distinct().collect()]  # a few small numbers
    right = side(products).select("product_id", F.col("plain").alias("p_plain"), F.col("brand_plain").alias("p_brand"), F.col("abv").alias("p_abv"), kind_of.alias("p_kind"), "discovered")

    def runs_of(text: Column) -> Column:
        words = F.split(text, " ")
        run = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        some = [F.when(F.size(words) >= n, run(n)) for n in runs]
        return F.flatten(F.array_compact(F.array(*some))) if some else F.array().cast("array<string>")

    keys = F.array_distinct(F.concat(runs_of(F.col("p_brand")), runs_of(F.col("p_plain")), F.array(F.lit(""))))
    listed = right.withColumn("brand_plain", F.explode(keys)).withColumn("asked_kind", F.explode(F.array_distinct(F.array("p_kind", F.lit("")))))
    listed = listed.join(asked.select("brand_plain", "asked_kind").distinct(), ["brand_plain", "asked_kind"], "left_semi")
    newest = Window.partitionBy("brand_plain", "asked_kind").orderBy(F.desc("discovered"), "product_id")
    listed = listed.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= cap)
    pairs = spread(left.join(listed, ["brand_plain", "asked_kind"])).withColumn("s", fuzzy.name_scores("plain", "p_plain"))
    same = (F.col("brand_plain") != "") & (F.col("brand_plain") == F.col("p_brand"))
    near = F.coalesce((F.col("abv") != 0) & (F.col("p_abv") != 0) & (F.abs(F.col("abv") - F.col("p_abv")) < 0.5), F.lit(False))
    score, accepted = fuzzy_score(F.col("s"), same, near)
    scored = pairs.withColumn("score", score).filter(accepted & (F.col("score") >= threshold))
    best = scored.groupBy("probe_id").agg(F.min(F.struct((-F.col("score")).alias("c"), "rn", "product_id", "p_plain")).alias("b"))
    return best.select("probe_id", F.col("b.product_id").alias("product_id"), (-F.col("b.c")).alias("score"), fuzzy_confidence(-F.col("b.c"), threshold).alias("confidence"), F.col("b.p_plain").alias("base"))


def resolve(probes: DataFrame, products: DataFrame) -> DataFrame:
    """(probe_id, product_id, method, confidence, status, variant_type): the whole matching pipeline.

    By GTIN (1.0), fingerprint (0.95), then fuzzy names (0.7 to 0.9) for what is left. Sure matches (over 0.9) are
    matched; fuzzy ones need review, unless they are variants of the product they met, which, like what meets nothing,
    are new products (a variant keeps the product that it is of).
    """
    exact = cascade(probes.select("probe_id", "gtin", "fingerprint"), products.select("product_id", "gtin", "fingerprint", "discovered"))
    exact = settled(exact)
    rest = probes.join(exact.filter("method = 'new'").select("probe_id"), "probe_id", "left_semi")
    met = fuzzy_matches(rest, products).join(probes.select("probe_id", match_name(F.col("name")).alias("said")), "probe_id")
    ratio = fuzzy.name_scores("said", "base")["ratio"]
    met = met.withColumn("ratio", ratio).withColumn("variant_type", variant_of(F.col("said"), F.col("base"), F.col("ratio")))
    found = exact.join(met.select("probe_id", F.col("product_id").alias("near"), F.col("confidence").alias("sure"), "variant_type"), "probe_id", "left")
    fuzzy_hit = F.col("near").isNotNull()
    method = F.when(fuzzy_hit, "fuzzy").otherwise(F.col("method"))
    confidence = F.when(fuzzy_hit, F.col("sure")).otherwise(F.col("confidence"))
    status = F.when(F.col("variant_type").isNotNull() | (method == "new"), "new_product").when(confidence > 0.9, "matched").when(confidence >= 0.7, "needs_review").otherwise("new_product")
    return found.select("probe_id", F.coalesce("product_id", "near").alias("product_id"), method.alias("method"), confidence.alias("confidence"), status.alias("status"), "variant_type")


def dedup_similarity(a: Column, b: Column, ratio: Column) -> Column:
    """0.4 of the shared words and 0.6 of the characters' ratio (0 to 1); equal names are 1, empty ones 0."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(0.4 * fuzzy.jaccard(words(a), words(b)) + 0.6 * ratio)


def deduplicate(probes: DataFrame, products: DataFrame, cap: int = 100) -> DataFrame:
    """(probe_id, product_id, method, confidence, status): the deduplication cascade.

    GTIN and fingerprint are sure (1.0). Otherwise the best of the ``cap`` newest products of the probe's brand (any
    without one) and kind: from 0.85 matched, from 0.65 for review, else a new product.
    """
    exact = cascade(probes.select("probe_id", "gtin", "fingerprint"), products.select("product_id", "gtin", "fingerprint", "discovered"))
    exact = settled(exact.withColumn("confidence", F.when(F.col("method") == "new", 0.0).otherwise(1.0)))
    rest = probes.join(exact.filter("method = 'new'").select("probe_id"), "probe_id", "left_semi")
    known = products.select(F.lower("brand").alias("by")).distinct().withColumn("known", F.lit(True))
    # A brand that no product has is no filter.
    rest = rest.withColumn("by", F.lower("brand")).join(known, "by", "left").withColumn("by", F.when(F.col("known") & (F.col("by") != ""), F.col("by")).otherwise(""))
    rest = rest.select("probe_id", "by", F.coalesce("kind", F.lit("")).alias("of_kind"), name_key(F.col("name")).alias("a"))
    listed = products.select("product_id", "discovered", name_key(F.col("name")).alias("b"), F.explode(F.array_distinct(F.array(F.coalesce(F.lower("brand"), F.lit("")), F.lit("")))).alias("by"), F.coalesce("kind", F.lit("")).alias("k"))
    listed = listed.withColumn("of_kind", F.explode(F.array_distinct(F.array("k", F.lit(""))))).join(rest.select("by", "of_kind").distinct(), ["by", "of_kind"], "left_semi")
    newest = Window.partitionBy("by", "of_kind").orderBy(F.desc("discovered"), "product_id")
    listed = listed.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= cap)
    scored = spread(rest.join(listed, ["by", "of_kind"])).withColumn("score", dedup_similarity(F.col("a"), F.col("b"), fuzzy.sequence_ratio("a", "b")))
    best = scored.groupBy("probe_id").agg(F.min(F.struct((-F.col("score")).alias("c"), "rn", "product_id")).alias("m")).select("probe_id", F.col("m.product_id").alias("near"), (-F.col("m.c")).alias("score"))
    found = exact.join(best, "probe_id", "left")
    sure, likely = F.col("method") != "new", F.coalesce(F.col("score") >= 0.65, F.lit(False))
    status = F.when(sure | F.coalesce(F.col("score") >= 0.85, F.lit(False)), "matched").when(likely, "needs_review").otherwise("new_product")
    return found.select(
        "probe_id", F.coalesce("product_id", F.when(likely, F.col("near"))).alias("product_id"), F.when(sure, F.col("method")).when(likely, "fuzzy").otherwise("new").alias("method"),
        F.when(sure, F.col("confidence")).when(likely, F.col("score")).otherwise(0.0).alias("confidence"), status.alias("status"),
    )


def fuzzy_score(scores: Column, same_brand: Column, near_abv: Column) -> tuple[Column, Column]:
    """(similarity, whether it is accepted) of the fuzzy stage: the best of three ratios, with bonuses."""
    best = F.greatest(scores["token_set"], scores["partial"], scores["ratio"]) / 100.0
    score = F.least(F.lit(1.0), best + F.when(same_brand, 0.05).otherwise(0.0))
    score = F.least(F.lit(1.0), score + F.when(near_abv, 0.05).otherwise(0.0))
    return score, ((score >= 0.85) & same_brand) | ((score >= 0.90) & near_abv) | (score >= 0.95)


def fuzzy_confidence(score: Column, threshold: float = 0.85) -> Column:
    return F.least(F.lit(0.9), F.greatest(F.lit(0.7), 0.7 + (score - threshold) * (0.2 / (1 - threshold))))


def variant_type(candidate: Column, base: Column, ratio: Column) -> Column:
    """The kind of variant that a candidate's name is of a base's: a pattern it has and the base hasn't; or null.

    Names over 95 % alike are one product; the base's name, or 60 % of its words, has to be in the candidate's.
    """
    return variant_of(match_name(candidate), match_name(base), ratio)


def variant_of(a: Column, b: Column, ratio: Column) -> Column:
    """``variant_type`` of names that are in ``match_name``'s form."""
    x, y = fuzzy.words(a), fuzzy.words(b)
    related = F.contains(a, b) | (F.size(F.array_intersect(x, y)) >= F.size(y) * 0.6)
    kind = None
    for name, patterns in VARIANTS.items():
        for p in patterns:
            hit = F.contains(a, F.lit(p)) & ~F.contains(b, F.lit(p))
            kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.when((a != "") & (b != "") & (ratio <= 95) & related, kind)


def page_score(target: Column, found: Column, same_brand: Column, brand_inside: Column, same_category: Column) -> Column:
    """How well a product on a page fits a target: words shared, brand, category; null below 10."""
    share = F.when(F.size(target) > 0, 50.0 * F.size(F.array_intersect(target, found)) / F.size(target)).otherwise(0.0)
    brand = F.when(same_brand, 30).when(brand_inside, 20).otherwise(0)
    category = F.when(same_category.isNull(), 0).when(same_category, 20).otherwise(-40)
    total = share + brand + category
    return F.when(total >= 10, total)


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """(probe_id, candidate_id, score): one-to-one assignment by input order, each probe its best free candidate.

    ``pairs`` has (probe_order, probe_id, candidate_id, score). A pair is settled as soon as the candidate is its
    probe's best and no earlier probe could take it; such pairs leave, and so do their probes and candidates. Each
    round is two aggregations, and the first probe left is settled in each, so no task holds more than a key.
    """
    left, done = settled(pairs.select("probe_order", "probe_id", "candidate_id", "score")), []
    while not left.isEmpty():
        top = left.groupBy("probe_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate_id")).alias("t")).select("probe_id", F.col("t.candidate_id").alias("candidate_id"))
        first = left.groupBy("candidate_id").agg(F.min(F.struct("probe_order", "probe_id")).alias("f")).select("candidate_id", F.col("f.probe_id").alias("probe_id"))
        sure = settled(left.join(top.join(first, ["probe_id", "candidate_id"]), ["probe_id", "candidate_id"], "left_semi").select("probe_id", "candidate_id", "score").distinct())
        done.append(sure)
        left = settled(left.join(sure.select("probe_id"), "probe_id", "left_anti").join(sure.select("candidate_id"), "candidate_id", "left_anti"))
    out = done[0] if done else left.select("probe_id", "candidate_id", "score")
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def rare_word_pairs(probes: DataFrame, others: DataFrame, words: int = 2) -> DataFrame:
    """(probe_id, candidate_id) of names where one of a name's ``words`` rarest words is in the other name.

    Rare words keep blocks small; a name like another in all but its rarest words isn't met.
    """
    split = lambda df, i, n: df.select(F.col(i).alias("id"), F.explode(fuzzy.words(F.col(n))).alias("w"))
    a, b = split(probes, "probe_id", "a"), split(others, "candidate_id", "b")
    count = a.unionByName(b).groupBy("w").count()
    rare = lambda df: ranked(df.join(count, "w"), ["id"], ["count", "w"], words).select("id", "w")
    one = rare(a).withColumnRenamed("id", "probe_id").join(b.withColumnRenamed("id", "candidate_id"), "w")
    two = a.withColumnRenamed("id", "probe_id").join(rare(b).withColumnRenamed("id", "candidate_id"), "w")
    return one.unionByName(two).select("probe_id", "candidate_id").distinct()


def ranked(rows: DataFrame, key: list[str], order: list[Column], most: int | None = None) -> DataFrame:
    """``rows`` with ``rank`` by key, and only the first ``most``."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return out if most is None else out.filter(F.col("rank") <= most)
