"""Listing queries: markup of listings made of pages' keys and put into pages; the SQL tells the rows from the keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import dom as D
from millrace.functions import urls as U
from millrace.operators import kinds as K
from millrace.plans.kinds import pick
from millrace.registry import query
from millrace.sources.tables import table

AWARD = "address string, medal string, score int, kind string"


def _made(spark, folder, *parts):
    """Pages with further markup before their end."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", F.lit("https://hub.example/list/2024").alias("url"), F.concat(F.lit("<div>"), *parts, F.lit("</div>"), "html").alias("html"))




def _id():
    return F.col("page_id").cast("string")


STYLES = ["Whisky", "Fortified", "Old Tom Gin", "Sake"]


@query("card_listing", f"""select page_id, 0 as pos, 'https://hub.example/results/detail/' || page_id as address, case page_id % 3 when 0 then 'Gold' when 1 then 'Silver' else 'Bronze' end as medal, case when page_id % 3 = 0 then 90 + page_id % 10 end::int as score, ({"['whiskey', 'port_wine', 'gin', 'unknown']"})[page_id % 4 + 1] as kind from pages
union all select page_id, 1, 'https://hub.example/results/detail/x', 'Unknown', null, 'unknown' from pages""")
def card_listing(spark, folder):
    """Cards whose medal is in a picture's name, its text, or the card's class; one says nothing, one has no link."""
    k = F.col("page_id") % 3
    category = F.when(F.col("page_id") % 4 == 1, "Wine").otherwise("Spirit")
    image = F.when(k == 0, F.concat(F.lit('<img data-src="/m/iwsc2024-gold-'), (90 + F.col("page_id") % 10).cast("string"), F.lit('-medal.png">'))).when(k == 1, '<img src="/m/a.png" alt="A silver award">').otherwise("<img src='/b.png'>")
    card = F.concat(
        F.when(k == 2, '<div class="c-card--listing is-bronze">').otherwise('<div class="c-card--listing">'), F.lit('<div class="c-card--listing__awards-wrapper">'), image, F.lit('</div><p class="category">'), category,
        F.lit('</p><p class="c-card--listing__style"> '), pick(STYLES, "page_id"), F.lit('</p><a href="/x">no</a><a href="/results/detail/'), _id(), F.lit('">more</a></div>'),
    )
    other = F.lit('<div class="c-card--listing"><a href="/results/detail/x"><br>y</a></div><div class="c-card--listing"><a href="/none">z</a></div>')
    return D.rows_of(_made(spark, folder, card, other), "page_id", "url", "html", lambda h, u: D.card_listing(h, u, 2024), AWARD)


LEVELS = ["World's Best Single Malt", "Best Scotch Blended", "Best Label", "Rye"]


@query("winner_listing", f"""select page_id, 0 as pos, 'https://hub.example/winner-whisky/glen-' || page_id || '-world-whiskies-awards-2024' as address, (['World''s Best', 'Best Scotch', 'Best Label', 'Winner'])[page_id % 4 + 1] as medal, null::int as score, 'whiskey' as kind from pages
union all select page_id, 1, 'https://hub.example/winner-whisky/late-world-whiskies-awards-2024', 'Best Irish', null, 'whiskey' from pages""")
def winner_listing(spark, folder):
    """Winners by the heading before or around their link; other years', categories' and repeated links don't count."""
    one = F.concat(F.lit("<h3>"), pick(LEVELS, "page_id"), F.lit('</h3><ul><li><a href="/winner-whisky/glen-'), _id(), F.lit('-world-whiskies-awards-2024">Glen</a></li></ul>'))
    more = F.concat(
        F.lit('<a href="/winner-whisky/whisky/2024/world-whiskies-awards-2024">all</a><a href="/winner-whisky/old-world-whiskies-awards-2023">old</a><section><h2>best irish pot</h2><p><a href="/winner-whisky/late-world-whiskies-awards-2024">L</a></p></section><a href="/winner-whisky/glen-'),
        _id(), F.lit('-world-whiskies-awards-2024">again</a>'),
    )
    return D.rows_of(_made(spark, folder, one, more), "page_id", "url", "html", lambda h, u: D.winner_listing(h, u, 2024), AWARD)


@query("wine_listing", """select page_id, 0 as pos, 'https://hub.example/DWWA/2024/wines/' || page_id as address, case page_id % 4 when 0 then 'Platinum' when 1 then 'Gold' else 'Unknown' end as medal, case when page_id % 2 = 0 then 80 + page_id % 20 end::int as score, case when page_id % 3 = 0 then 'port_wine' else 'fortified' end as kind from pages
union all select page_id, 1, 'https://other.example/wines/7', 'Bronze', null, 'fortified' from pages""")
def wine_listing(spark, folder):
    """Wine cards with medal, score and style in their text."""
    k = F.col("page_id")
    card = F.concat(
        F.lit('<article class="wine-item"><a href="/DWWA/2024/wines/'), _id(), F.lit('">W</a> '), F.when(k % 3 == 0, "Tawny ").otherwise("Muscat "), F.when(k % 4 == 0, "Best in  Show gold").when(k % 4 == 1, "GOLD").otherwise("Golden"),
        F.when(k % 2 == 0, F.concat(F.lit(" Score: "), (80 + k % 20).cast("string"))).otherwise(" 101 points"), F.lit('</article><article class="wine-item"><a href="https://other.example/wines/7">x</a> bronze</article><article class="wine-item"><a href="/elsewhere">x</a></article>'),
    )
    find = lambda h, u: D.wine_listing(h, u, 2024, K.PORT_PATTERNS, K.MEDAL_PATTERNS, K.SCORE_PATTERNS)
    return D.rows_of(_made(spark, folder, card), "page_id", "url", "html", find, AWARD)


@query("embedded_listing", """select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, 'https://hub.example/list/2024#product-' || page_id || '-' || i as address, case i when 0 then 'Double Gold' when 1 then 'Best of Class' else 'Unknown' end as medal, null::int as score, 'class ' || page_id % 5 as kind from pages, range(4) t(i) where i < 3 and i <= page_id % 4""")
def embedded_listing(spark, folder):
    """Bottles in a page's embedded JSON; those of other years, and of other modules, don't count."""
    k = F.col("page_id")
    award = lambda i: F.when(i == 0, "2024 Double").when(i == 1, "2024 best of class gold").when(i == 2, "2024 entry").otherwise("2023 Gold")
    item = lambda i: F.struct(F.concat(_id(), F.lit("-"), i.cast("string")).alias("id"), F.lit('a "}" b').alias("title"), F.concat(F.lit("class "), (k % 5).cast("string")).alias("class"), award(i).alias("award"), F.when(i == 0, "GG").when(i == 3, "G").otherwise("?").alias("award_code"))
    items = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), item)
    module = lambda name, rows: F.struct(F.lit(name).alias("module"), F.struct(rows.alias("items")).alias("results"))
    body = F.to_json(F.struct(F.struct(F.struct(F.array(module("other", items), module("bottles-list", items)).alias("modules")).alias("content")).alias("page")))
    return D.rows_of(_made(spark, folder, F.lit("<script>var x = 1; GlobalsObj.CMS_JSON = "), body, F.lit("; y = {};</script>")), "page_id", "url", "html", lambda h, u: D.embedded_listing(h, u, 2024), AWARD)


@query("hub_brands", """select page_id, 0 as pos, 'Brand ' || page_id as name, 'https://hub.example/brands/' || page_id as hub_url, null as site from pages
union all select page_id, 1, 'Own Site', 'https://hub.example/list/2024', 'https://own.example/' || page_id from pages union all select page_id, 2, 'By title', 'https://hub.example/brands/t', null from pages""")
def hub_brands(spark, folder):
    """Brands of a hub page: on the hub or with a site of their own; navigation and repeated names don't count."""
    part = F.concat(
        F.lit('<a class="b" href="/brands/'), _id(), F.lit('"><span class="name"> Brand '), _id(), F.lit('</span> 12 items</a><a href="/brands/more">View all</a><a href="/brands/2"><i>brand '), _id(),
        F.lit('</i></a><div class="brand-list"><a href="https://own.example/'), _id(), F.lit('">Own Site</a></div><a href="/brands/t" title=" By title "><img src="x"></a><a href="">empty</a>'),
    )
    find = lambda h, u: sorted(D.hub_brands(h, u, ["a[href*='/brands/']", ".brand-list a"], [".name", "h3"]), key=lambda b: ("Brand", "Own", "By").index(b[0].split()[0]))
    return D.rows_of(_made(spark, folder, part), "page_id", "url", "html", find, "name string, hub_url string, site string")


@query("page_links", "select page_id, 0 as pos, 'https://hub.example/list/2024?page=2' as address from pages union all select page_id, 1, 'https://hub.example/p/' || page_id from pages")
def page_links(spark, folder):
    part = F.concat(F.lit('<div class="pagination"><a href="?page=2">2</a><a href="/p/'), _id(), F.lit('">3</a><a>4</a><a href="?page=2">again</a></div><a class="next" href="/p/'), _id(), F.lit('">next</a>'))
    return D.rows_of(_made(spark, folder, part), "page_id", "url", "html", lambda h, u: ((a,) for a in D.page_links(h, u, [".pagination a", "a.next"])), "address string")


SELECTORS = {".card": 2, "div .card a[href^='/x']": 1, "#top": 1, "[data-k]": 3, "a[": 1}


@query("selector_counts", "select page_id, (2 + page_id % 2)::int as cards, (page_id % 2)::int as links, 1::int as tops, (page_id % 3)::int as data, 0::int as broken, (1 + (page_id % 2 = 1)::int + 1)::int as healthy from pages")
def selector_counts(spark, folder):
    """How many elements each selector names, and how many selectors name as many as they should."""
    k = F.col("page_id")
    part = F.concat(
        F.lit('<div id="top"><p class="card a"></p><p class="b card"></p>'), F.when(k % 2 == 1, '<p class="card"><a href="/x/1">1</a><a href="/y">2</a></p>').otherwise(""), F.lit("</div>"),
        F.repeat(F.lit('<i data-k="1"></i>'), (k % 3).cast("int")), F.lit('<p class="cards"></p>'),
    )

    def find(html, _):
        page = D.tree(html)
        counts = [D.count(page, s) for s in SELECTORS]
        yield (*counts, sum(c >= least for c, least in zip(counts, SELECTORS.values())))

    return D.rows_of(_made(spark, folder, part), "page_id", "url", "html", find, "cards int, links int, tops int, data int, broken int, healthy int").drop("pos")


PRODUCT_LINKS = (
    r"""(?is)<div[^>]*class="[^"]*product[-_]?card[^"]*"[^>]*>.*?<a[^>]*href="([^"]+)\"""", r"""(?i)<a[^>]*(?:class|id)="[^"]*product[^"]*"[^>]*href="([^"]+)\"""", r"""(?i)href="([^"]+/product[s]?/[^"]+)\""""
)


@query("product_links", f"""with h as (select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, '<div class="x product-card"><b>' || page_id || '</b><a class="q" href="/c/' || page_id % 7 || '">1</a></div><a id="product-2" href="/d/2">2</a><a href="https://o.example/products/' || page_id || '">3</a><a href="/c/' || page_id % 7 || '" class="product">4</a>' || html as t from pages),
l as (select page_id, root, list_concat(list_concat(regexp_extract_all(t, '{PRODUCT_LINKS[0]}', 1), regexp_extract_all(t, '{PRODUCT_LINKS[1]}', 1)), regexp_extract_all(t, '{PRODUCT_LINKS[2]}', 1)) as hrefs from h),
e as (select page_id, unnest(hrefs) as href, root, generate_subscripts(hrefs, 1) as i from l), a as (select page_id, case when starts_with(href, 'http') then href else root || href end as link, min(i) as i from e group by 1, 2), r as (select *, row_number() over (partition by page_id order by i) as rank from a)
select page_id, rank::int as rank, link from r where rank <= 50""")
def product_links(spark, folder):
    """A listing's product links by three patterns, absolute, in order, each once, fifty at most; no Python."""
    k = _id()
    seven = (F.col("page_id") % 7).cast("string")
    more = F.concat(F.lit('<div class="x product-card"><b>'), k, F.lit('</b><a class="q" href="/c/'), seven, F.lit('">1</a></div><a id="product-2" href="/d/2">2</a><a href="https://o.example/products/'), k, F.lit('">3</a><a href="/c/'), seven, F.lit('" class="product">4</a>'), "html")
    found = F.concat(*(F.regexp_extract_all(more, F.lit(p), F.lit(1)) for p in PRODUCT_LINKS))
    pages = table(spark, folder, "pages").select("page_id", "url", found.alias("hrefs"))
    links = F.slice(F.array_distinct(F.transform("hrefs", lambda h: U.resolve(F.col("url"), h))), 1, 50)
    return pages.select("page_id", F.posexplode(links).alias("pos", "link")).select("page_id", (F.col("pos") + 1).alias("rank"), "link")


REMOVED = ("script", "style", "noscript", "nav", "footer", "aside", "header", "iframe", "form", "svg", "canvas", "video", "audio")


def _removed_sql(column: str) -> str:
    for tag in REMOVED:
        column = f"regexp_replace({column}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({column}, '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'))"


@query("structured_clean", f"select page_id, md5({_removed_sql('html')}) as digest, length({_removed_sql('html')}) as chars from pages")
def structured_clean(spark, folder):
    """Pages without navigation, scripts, frames and comments, white space squeezed; markup stays."""
    out = F.col("html")
    for tag in REMOVED:
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"\s+", " "))
    return table(spark, folder, "pages").select("page_id", F.md5(out).alias("digest"), F.length(out).cast("bigint").alias("chars"))


@query("sitemap_tree", """with p as (select page_id, page_id // 25 as file, url from pages) select 0 as depth, -1::bigint as file, 'https://s.example/' || file || '.xml' as url from (select distinct file from p) where file % 3 > 0 union all select 1, file, url from p where file % 3 > 0""")
def sitemap_tree(spark, folder):
    """An index and the sitemaps that it names, packed or plain: entries of the files that can be reached from it."""
    from millrace.sources.web import crawl_sitemaps

    pages = table(spark, folder, "pages").withColumn("file", F.floor(F.col("page_id") / 25))
    entry = lambda c: F.concat(F.lit("<url><loc>"), c, F.lit("</loc></url>"))
    files = pages.groupBy("file").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry(F.col("url"))), ""), F.lit("</urlset>")).alias("xml"))
    files = files.select("file", F.concat(F.lit("https://s.example/"), F.col("file").cast("string"), F.lit(".xml")).alias("address"), F.encode("xml", "utf-8").alias("body"))
    index = files.filter("file % 3 > 0").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "address", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    index = index.select(F.lit(-1).cast("bigint").alias("file"), F.lit("https://s.example/index.xml").alias("address"), F.encode("xml", "utf-8").alias("body"))
    return crawl_sitemaps(files.unionByName(index), "https://s.example/index.xml").select("depth", "file", "url")
