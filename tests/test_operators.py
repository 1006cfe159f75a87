"""Fixtures worked out by hand for the rules that a plain reading gets wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import fuzzy, html, texts, urls
from millrace.operators import classify, freshness, matching, merging, monitoring, prices, records, scoring
from millrace.sources import web


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'bigint'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("url,want", [
    ("https://WWW.Example.com/page/?utm_source=test&b=2&a=1#section", "https://example.com/page?a=1&b=2"),
    ("http://a.com/", "http://a.com"),
    ("http://a.com/?a=2&a=1", "http://a.com?a=2&a=1"),
    ("https://a.com/x?REF=1&c", "https://a.com/x?c="),
    (None, ""),
])
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


@pytest.mark.parametrize("link,want", [("/x", "http://h.com/x"), ("y", "http://h.com/a/y"), ("//o.com/z", "http://o.com/z"), ("https://q/", "https://q/"), ("?p=1", "http://h.com/a/b?p=1")])
def test_resolve(spark, link, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("l")), b="http://h.com/a/b", l=link) == want


def test_prices_and_ages(spark):
    assert one(spark, texts.price(F.col("s")), s="€1.234,56") == 1.23456 and one(spark, texts.price(F.col("s")), s="€45,99") == 45.99
    assert one(spark, texts.age_designation(F.col("s")), s="25 years") == 20 and one(spark, texts.age_designation(F.col("s")), s="35") == 40
    assert one(spark, texts.medal(F.col("s")), s="double gold winner") == "gold" and one(spark, texts.medal(F.col("s")), s="Double Gold") == "double_gold"
    assert one(spark, texts.basic_text(F.col("s")), s="<b>a</b>&amp;lt;") == "a <"


def history(spark, values):
    rows = [(1, p, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i) for i, p in enumerate(values)]
    return spark.createDataFrame(rows, "product_id bigint, price double, observed_at timestamp, k int")


@pytest.mark.parametrize("values,trend,change", [
    ([100.0, 100.0, 110.0, 110.0], "rising", 10.0), ([100.0, 94.0], "falling", -6.0), ([100.0, 105.0], "stable", 5.0),
    ([None, 100.0, 0.0, 120.0], "rising", 20.0), ([100.0], None, None), ([None, 100.0], None, None),
])
def test_price_trend_splits_before_it_drops_missing_prices(spark, values, trend, change):
    row = prices.price_trend(history(spark, values), ["k"]).first()
    assert (row.trend, row.change_pct) == (trend, change)


def test_price_stability_extremes_and_alerts(spark):
    rows = history(spark, [100.0, None, 90.0, 95.0, 80.0])
    assert prices.price_stability(rows).first().stability == 8  # 8.54 / 91.25 is 9.4 %
    e = prices.price_extremes(rows, ["k"]).first()
    assert (e.lowest_price, e.lowest_date, e.highest_price) == (80.0, dt.date(2024, 1, 5), 100.0)
    limits = spark.createDataFrame([(1, 92.0)], "product_id bigint, threshold double")
    got = [(r.k, r.alert_type) for r in prices.price_alerts(rows, limits, ["k"]).orderBy("k", "alert_type").collect()]
    assert got == [(2, "new_low"), (2, "price_drop"), (4, "new_low")]


def test_streaks_and_averages(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([True, True, False, True, True, True])], "key int, k int, h boolean")
    assert [r.streak for r in monitoring.runs(rows, ["key"], ["k"], F.col("h")).orderBy("k").collect()] == [1, 2, 0, 1, 2, 3]
    values = spark.createDataFrame([(1, 2, 200.0), (1, 1, 100.0)], "key int, k int, v double")
    assert monitoring.moving_average(values, "key", ["k"], "v", 0.2).first().ema == pytest.approx(120.0)
    assert monitoring.moving_average(values, "key", ["k"], "v", 0.3, 1.0).first().ema == pytest.approx(0.3 * 200 + 0.7 * (0.3 * 100 + 0.7))


def test_schedules_and_seasons(spark):
    start = F.lit("2024-01-01").cast("timestamp")
    never = F.lit(None).cast("timestamp")
    run = lambda kind, errors: spark.range(1).select(monitoring.next_run(F.lit(kind), start, F.lit(errors), never).cast("date").alias("x")).first().x
    assert [run("daily", 0), run("daily", 2), run("weekly", 1), run("monthly", 0), run("on_demand", 1)] == [dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 31), None]
    assert one(spark, monitoring.in_season(F.col("m"), F.col("a"), F.col("b")), m=1, a=11, b=2) and not one(spark, monitoring.in_season(F.col("m"), F.col("a"), F.col("b")), m=5, a=11, b=2)


def test_freshness_of_what_was_never_checked(spark):
    none = F.lit(None).cast("timestamp")
    row = spark.range(1).select(freshness.freshness_score(none, none, none, "2024-01-01").alias("s"), freshness.freshness_level(F.lit("price"), none, "2024-01-01").alias("l")).first()
    assert row.s in (99, 100) and row.l == "critical"
    old = F.lit("2023-12-21 00:00:01").cast("timestamp")  # ten days less a second: nine full days
    assert spark.range(1).select(freshness.component_score("price", old, "2023-12-31").alias("s")).first().s == 73


def test_merges(spark):
    rows = spark.createDataFrame([(1, 1, "name", "Glen", 0.6), (1, 2, "name", " glen ", 0.9), (1, 3, "name", "Other", 0.9), (1, 4, "abv", "43", 0.5), (1, 5, "abv", "43.0", 0.5), (1, 6, "abv", "", 0.99)], "product_id bigint, source_id bigint, field_name string, extracted_value string, confidence double")
    merged = {r.field_name: (r.value, r.source_id) for r in merging.confidence_merge(rows).collect()}
    assert merged == {"name": (" glen ", 2), "abv": ("43", 4)}
    assert {r.field_name: r.value_count for r in merging.conflicts(rows).collect()} == {"name": 2, "abv": 2}
    assert merging.auto_resolved(rows).count() == 1  # abv: 0.99 against 0.5
    assert {r.field_name: r.value for r in merging.first_wins(rows).collect()} == {"name": "Glen", "abv": "43"}
    assert {r.field_name: r.value for r in merging.refresh_merge(rows, ["name"]).collect()} == {"name": "Glen", "abv": "43"}
    verdict = lambda a, b: one(spark, merging.verify_merge(F.col("a"), F.col("b")), a=a, b=b)
    assert [verdict("", "x"), verdict("43", "43.0"), verdict("A ", "a"), verdict("a", "b"), verdict("a", " ")] == ["set", "verified", "verified", "conflict", "none"]
    assert one(spark, merging.merged_list(F.col("v")), v=["Oak", " oak", "Smoke", "SMOKE", "x"]) == ["Oak", "Smoke", "x"]


def test_status_rules_differ_by_path(spark):
    score, palate = F.col("s"), F.lit(True)
    assert one(spark, scoring.status(score, palate, F.lit("partial")), s=85) == "verified"
    assert one(spark, scoring.status(score, palate, F.lit("partial"), F.lit(False)), s=85) == "complete"
    assert one(spark, scoring.status(score, F.lit(False), F.lit("partial")), s=95) == "partial"
    assert one(spark, scoring.status(score, palate, F.lit("merged")), s=10) == "merged"


def test_populated_counts_zero_and_false_but_truthiness_does_not(spark):
    assert one(spark, texts.populated(F.col("v"), "number"), v=0) and not one(spark, scoring.truthy(F.col("v"), "number"), v=0)
    assert not one(spark, texts.populated(F.col("v"), "string"), v="  ") and one(spark, scoring.truthy(F.col("v"), "string"), v="  ")


def test_gate_waives_age_for_ruby(spark):
    rules = {"skeleton": ["name"], "partial": ["name", "brand"], "baseline": ["name", "brand"], "enriched": ["x"], "baseline_or": [["indication_age", "harvest_year"]], "enriched_or": [], "waivers": ["ruby"]}
    gate = lambda style: one(spark, scoring.gate_v3(F.col("p"), F.lit(10.0), F.lit("port"), F.lit(style), rules), p=["name", "brand"])
    assert gate("Ruby") == "baseline" and gate("Tawny") == "partial"


def test_matcher_reaches_the_threshold_exactly(spark):
    words = fuzzy.words(F.col("a"))
    assert one(spark, matching.match_confidence(F.lit(True), words, fuzzy.words(F.lit("zzz"))), a="aaa") >= 0.85
    assert one(spark, matching.match_confidence(F.lit(False), words, words), a="aaa bbb") >= 0.85


def test_cascade_takes_the_newest(spark):
    products = spark.createDataFrame([(1, "1 2", "f", 1), (2, "1-2", "g", 2), (3, None, "h", 3)], "product_id bigint, gtin string, fingerprint string, discovered bigint")
    probes = spark.createDataFrame([(7, "12", "x"), (8, None, "h"), (9, "", "none")], "probe_id bigint, gtin string, fingerprint string")
    assert [(r.product_id, r.method) for r in matching.cascade(probes, products).orderBy("probe_id").collect()] == [(2, "gtin"), (3, "fingerprint"), (None, "new")]


def test_greedy_pairs_free_each_candidate_once(spark):
    pairs = spark.createDataFrame([(1, 1, 10, 90), (1, 1, 11, 95), (2, 2, 11, 99), (2, 2, 10, 88)], "probe_order bigint, probe_id bigint, candidate_id bigint, score int")
    assert sorted(tuple(r) for r in matching.greedy_pairs(pairs).collect()) == [(1, 11, 95), (2, 10, 88)]


def test_ratios():
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.ratio("", "a") == 0
    assert fuzzy.partial("glen", "the glen 12") == 100 and fuzzy.token_sort("b a", "a b") == 100 and fuzzy.token_set("glen 12 years", "glen 12") == 100


def test_links_and_levels(spark):
    kind = lambda u: one(spark, classify.link_type(F.col("u"), F.lit(""), "/product"), u=u)
    assert [kind("http://a/product?page=2"), kind("http://a/product/1"), kind("http://a/shop/"), kind("http://a/similar"), kind("http://a/x")] == ["pagination", "product", "category", "related", "unknown"]
    assert one(spark, classify.award_level(F.col("s")), s="Best Islay Single Malt") == "Best Islay"


def test_sitemaps_and_robots(spark):
    xml = "<urlset><url><loc> http://a </loc><lastmod>2024-01-02T03:04:05Z</lastmod><priority>2</priority></url><url><loc>b</loc></url></urlset>"
    rows = web.sitemap_entries(spark.createDataFrame([(1, xml)], "k int, xml string"), "k", "xml").orderBy("pos").collect()
    assert [(r.url, r.lastmod is None, r.priority) for r in rows] == [("http://a", False, None), ("b", True, None)]
    assert one(spark, web.robots_sitemaps(F.col("s")), s="User-agent: *\nSITEMAP: http://a/s.xml\n sitemap: b") == ["http://a/s.xml", "b"]


def test_html(spark):
    assert html.signature('<div class="b a" id="x" data-k="1">t</div>') == html.signature('<div class="a b" id="x" data-k="2"></div>') != html.signature("<div></div>")
    assert html.balanced_json('var x = {"a": "}", "b": {"c": 1}}; y', "var x") == '{"a": "}", "b": {"c": 1}}' and html.balanced_json("x {", "x") is None
    page = '<script type="application/ld+json">{"@type": "Product", "name": "N", "brand": {"name": "B"}, "description": "' + "d" * 100 + '", "offers": {"price": "9", "priceCurrency": "EUR"}}</script>'
    told = one(spark, html.product_section(F.col("h")), h=page)
    assert told.startswith("Product Name: N\nBrand: B\nDescription: d") and told.endswith("Price: EUR 9")


def test_records(spark):
    assert one(spark, records.safe_int(F.col("s")), s="1,234 ml") == 1234 and one(spark, records.safe_list(F.col("s")), s=None) == []
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, t int")
    assert sorted(tuple(r) for r in records.upserted(old, new, ["k"], [F.desc("t")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_queries_have_names_and_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
