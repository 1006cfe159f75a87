"""Files in and out: configuration, appended events, packed sitemaps, what a clean-up deletes."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import dom
from millrace.operators import records as R
from millrace.sources import config as C
from millrace.sources import web as W


def test_configuration_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"k": 1, "v": "x"}, {"k": 2, "v": "new"}], indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"k": 3, "v": None}]))
    new = C.read_config(spark, str(tmp_path), "k int, v string")
    old = spark.createDataFrame([(1, "x"), (2, "old"), (9, "kept")], "k int, v string")
    got = {r.k: (r.v, r.action) for r in C.upserted(old, new, ["k"], [F.col("v")]).collect()}
    assert got == {1: ("x", "unchanged"), 2: ("new", "updated"), 3: (None, "created"), 9: ("kept", "kept")}


def test_costs_are_appended_by_service(spark, tmp_path):
    requests = spark.createDataFrame([("search", 3, 7, "2024-01-01"), ("fetch", 2, None, "2024-01-02")], "service string, n bigint, job_id bigint, ts string")
    for _ in range(2):
        C.append(C.costs(requests, {"search": 5}), str(tmp_path / "log"), ["service"])
    got = spark.read.parquet(str(tmp_path / "log"))
    assert got.count() == 4 and got.filter("service = 'search'").agg(F.sum("cost_cents")).first()[0] == 30
    assert (tmp_path / "log" / "service=search").is_dir()


def test_sitemaps_are_followed_once_and_unpacked(spark):
    urls = lambda *u: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in u) + "</urlset>"
    index = lambda *u: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    files = [("i", index("a", "j", "gone").encode()), ("j", index("b", "i").encode()), ("a", gzip.compress(urls("1", "2").encode())), ("b", urls("3").encode()), ("c", urls("never").encode()), ("a2", b"\x1f\x8bbroken")]
    got = W.crawl_sitemaps(spark.createDataFrame(files, "address string, body binary"), "i").filter("not is_index")
    assert sorted((r.depth, r.address, r.url) for r in got.collect()) == [(1, "a", "1"), (1, "a", "2"), (2, "b", "3")]


@pytest.mark.parametrize("dry_run", [True, False])
def test_clean_up(spark, dry_run):
    tables = {n: spark.range(k) for n, k in (("child", 5), ("parent", 2), ("other", 3))}
    after, counts = R.cleared(tables, ["child", "parent"], dry_run)
    assert {r.table_name: r.deleted for r in counts.collect()} == {"child": 5, "parent": 2}
    assert [after[n].count() for n in ("child", "parent", "other")] == ([5, 2, 3] if dry_run else [0, 0, 3])


def test_listing_rules():
    assert dom.card_kind("Wine", "Tawny Fortified") == "port_wine" and dom.card_kind("", "Cognac") == "brandy" and dom.card_kind("Beer", "") == "unknown"
    assert dom.level_of(" World's Best Rye ") == "World's Best" and dom.level_of("best irish pot") == "Best Irish" and dom.level_of("Best Label") == "Best Label"
    plain = list(dom.wine_listing('<p>Gold <a href="/wines/1">x</a></p>', "https://h.example/s", 2024, (), (("Gold", "gold"),), (r"(\d+)",)))
    assert plain == [("https://h.example/wines/1", "Gold", None, "fortified")]
    assert list(dom.embedded_listing("GlobalsObj.CMS_JSON = {broken", "u", 2024)) == [] and list(dom.card_listing("", "u", 2024)) == []
