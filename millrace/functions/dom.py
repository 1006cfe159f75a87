"""A small document tree for pages, with the selectors that listings need, and what listings say.

Selectors: a tag, ``#id``, ``.class`` and ``[name]``, ``[name=v]``, ``[name*=v]``, ``[name^=v]`` in any combination, with
spaces for "inside". Trees are built from the standard library's parser; void elements have no inside, and an end tag
closes what is open up to its element, or nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from .html import balanced_json

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SIMPLE = re.compile(r"""(?P<tag>[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*^]?=)["']?(?P<value>[^"'\]]*)["']?)?\]""")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inside: list[Node | str] = []

    def nodes(self) -> Iterator[Node]:
        """All elements inside, in the page's order."""
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.nodes()

    def text(self) -> str:
        return "".join(x if isinstance(x, str) else x.text() for x in self.inside)

    def ancestors(self) -> Iterator[Node]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent

    def fits(self, simple: str) -> bool:
        end = 0
        for m in _SIMPLE.finditer(simple):
            if m.start() != end:
                raise ValueError(simple)
            end = m.end()
            value = self.attrs.get(m["name"] or "")
            fine = {
                "tag": lambda: self.tag == m["tag"].lower(), "id": lambda: self.attrs.get("id") == m["id"], "cls": lambda: m["cls"] in self.attrs.get("class", "").split(),
                "name": lambda: value is not None and (m["op"] is None or {"=": value == m["value"], "*=": m["value"] in value, "^=": value.startswith(m["value"])}[m["op"]]),
            }[next(k for k in ("tag", "id", "cls", "name") if m[k] is not None)]
            if not fine():
                return False
        if end != len(simple):
            raise ValueError(simple)
        return True

    def select(self, selector: str) -> list[Node]:
        """The elements inside that a selector names, in order."""
        *outer, last = selector.split()

        def within(node: Node) -> bool:
            rest = list(outer)
            for up in node.ancestors():
                if not rest:
                    break
                if up.fits(rest[-1]):
                    rest.pop()
            return not rest

        return [n for n in self.nodes() if n.fits(last) and within(n)]

    def first(self, *selectors: str) -> Node | None:
        """The first element by the first selector that names any."""
        for s in selectors:
            if found := self.select(s):
                return found[0]
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.inside.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        for node in [self.at, *self.at.ancestors()]:
            if node.tag == tag and node.parent is not None:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.inside.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def count(page: Node, selector: str) -> int:
    """How many elements a selector names; one that can't be read names none."""
    try:
        return len(page.select(selector))
    except (ValueError, StopIteration):
        return 0


# Kinds that a card's category and style tell, and words of styles, in the order in which they count.
CARD_KINDS = {
    ("wine", "fortified"): "port_wine", ("wine", "port"): "port_wine", ("spirit", "whisky"): "whiskey", ("spirit", "whiskey"): "whiskey", ("spirit", "scotch"): "whiskey",
    ("spirit", "bourbon"): "whiskey", ("spirit", "rye"): "whiskey", ("spirit", "irish whiskey"): "whiskey", ("spirit", "single malt"): "whiskey",
    ("spirit", "blended"): "whiskey", ("spirit", "gin"): "gin", ("spirit", "vodka"): "vodka", ("spirit", "rum"): "rum", ("spirit", "tequila"): "tequila",
}
STYLE_WORDS = {
    "port": "port_wine", "fortified": "port_wine", "whisky": "whiskey", "whiskey": "whiskey", "scotch": "whiskey", "bourbon": "whiskey", "gin": "gin",
    "vodka": "vodka", "rum": "rum", "tequila": "tequila", "brandy": "brandy", "cognac": "brandy",
}
MEDAL_CODES = {"GG": "Double Gold", "G": "Gold", "S": "Silver", "B": "Bronze"}
MEDAL_WORDS = ("Double Gold", "Best in Show", "Best of Class", "Platinum", "Gold", "Silver", "Bronze")
WINE_CARDS = (".wine-card", ".result-card", ".wine-item", ".search-result", "[data-wine-id]", ".wine-result", "article.wine", ".wines-list-item")
LEVEL_REGIONS = ("Scotch", "American", "Irish", "Japanese")
NAVIGATION = ("next", "previous", "more", "view all", "see all", "load more", "show more", "back", "home", "page", "menu", "search", "filter", "sort")
Award = tuple[str, str, int | None, str]


def card_kind(category: str, style: str) -> str:
    """The kind that a card's category and style tell: together, the style's word within the category, or a word."""
    category, style = category.lower().strip(), style.lower().strip()
    if (category, style) in CARD_KINDS:
        return CARD_KINDS[category, style]
    inside = [kind for (c, s), kind in CARD_KINDS.items() if c == category and s in style]
    words = [kind for word, kind in STYLE_WORDS.items() if word in style]
    return (inside + words + ["unknown"])[0]


def card_listing(html: str, base: str, year: int) -> Iterator[Award]:
    """(address, medal, score, kind) of the cards of a listing whose medals are pictures."""
    for card in tree(html).select(".c-card--listing"):
        link = card.first("a[href*='/results/detail/']")
        if link is None:
            continue
        medal, score = "Unknown", None
        image = card.first(".c-card--listing__awards-wrapper img")
        if image is not None:
            source = (image.attrs.get("data-src") or image.attrs.get("src") or "").lower()
            alt = image.attrs.get("alt", "").lower()
            if m := re.search(r"(gold|silver|bronze)-?(\d+)?-?medal", source):
                medal, score = m[1].capitalize(), int(m[2]) if m[2] else None
            else:
                medal = next((w for w in ("Gold", "Silver", "Bronze") if w.lower() in alt), medal)
        if medal == "Unknown":
            classes = card.attrs.get("class", "").lower()
            medal = next((w for w in ("Gold", "Silver", "Bronze") if w.lower() in classes), medal)
        text = lambda *s: n.text().strip() if (n := card.first(*s)) is not None else ""
        kind = card_kind(text(".c-card--listing__category", ".category", "[class*='category']"), text(".c-card--listing__style", ".style", "[class*='style']"))
        yield urljoin(base, link.attrs.get("href", "")), medal, score, kind


def level_of(heading: str) -> str:
    low = heading.lower().strip()
    if "world's best" in low or "worlds best" in low:
        return "World's Best"
    for region in LEVEL_REGIONS:
        if re.search(rf"best\s+{region.lower()}", low):
            return f"Best {region}"
    return heading.strip() if low.startswith("best ") else "Winner"


def winner_listing(html: str, base: str, year: int) -> Iterator[Award]:
    """(address, level, none, whiskey) of a category page's winners: links to details, the level by the heading before
    or within the elements around them; each address once."""
    seen = set()
    for link in tree(html).select("a[href]"):
        href = link.attrs["href"]
        if f"/winner-whisky/whisky/{year}/" in href or "/winner-whisky/" not in href or f"world-whiskies-awards-{year}" not in href:
            continue
        address = urljoin(base, href)
        if address in seen or address == base:
            continue
        seen.add(address)
        level = "Winner"
        for around in link.ancestors():
            if around.tag in ("body", "html", ""):
                break
            before = [x for x in around.parent.inside if isinstance(x, Node)]
            earlier = [x for x in before[: before.index(around)] if x.tag in ("h2", "h3", "h4")]
            heading = earlier[-1] if earlier else around.first("h2") or around.first("h3") or around.first("h4")
            if heading is not None:
                level = level_of(heading.text())
                break
        yield address, level, None, "whiskey"


def wine_listing(html: str, base: str, year: int, styles: tuple, medals: tuple, scores: tuple) -> Iterator[Award]:
    """(address, medal, score, kind) of a search's wine cards, or of plain links to wines where there are none."""
    page = tree(html)
    cards = next((found for s in WINE_CARDS if (found := page.select(s))), [])
    told = [(c, c.first("a[href*='/wines/']", "a[href*='/DWWA/']", "a")) for c in cards] or [(a.parent, a) for a in page.select("a[href*='/wines/']")]
    for around, link in told:
        href = link.attrs.get("href", "") if link is not None else ""
        if "/wines/" not in href:
            continue
        text = around.text()
        medal = next((m for m, p in medals if re.search(p, text, re.I)), "Unknown")
        numbers = [int(m[1]) for p in scores if (m := re.search(p, text, re.I))]
        score = next((n for n in numbers if n <= 100), None) if cards else None
        kind = "port_wine" if any(re.search(p, text, re.I) for _, p in styles) else "fortified"
        yield href if href.startswith("http") else urlparse(base)._replace(path="", query="", fragment="").geturl() + href, medal, score, kind


def embedded_listing(html: str, base: str, year: int) -> Iterator[Award]:
    """(address, medal, none, category) of the bottles in a page's embedded JSON, those that the year names."""
    found = balanced_json(html, "GlobalsObj.CMS_JSON")
    try:
        modules = json.loads(found or "{}")["page"]["content"]["modules"]
    except (ValueError, KeyError, TypeError):
        return
    for module in modules:
        if module.get("module") != "bottles-list":
            continue
        for item in module.get("results", {}).get("items", []):
            award = item.get("award", "")
            if str(year) in award:
                medal = MEDAL_CODES.get(item.get("award_code", "")) or next((w for w in MEDAL_WORDS if w.lower() in award.lower()), "Unknown")
                yield f"{base}#product-{item.get('id', '')}", medal, None, item.get("class", "")


def hub_brands(html: str, base: str, brands: list[str], names: list[str]) -> Iterator[tuple[str, str, str | None]]:
    """(name, page on the hub, own site or none) of a hub's brands, selector by selector; a name counts once, without
    case, and navigation not at all."""
    page, seen, hub = tree(html), set(), urlparse(base).netloc.replace("www.", "")
    for selector in brands:
        for element in page.select(selector):
            href = element.attrs.get("href", "")
            if not href:
                continue
            address = urljoin(base, href)
            named = next((n.text().strip() for s in names if (n := element.first(s)) is not None and n.text().strip()), "")
            whole = element.text().strip()
            name = named or (whole if len(whole) < 100 else "") or element.attrs.get("title", "").strip()
            if not name or name.lower() in NAVIGATION or len(name) < 2 or name.lower() in seen:
                continue
            seen.add(name.lower())
            outside = re.match("https?://", address) and hub not in urlparse(address).netloc
            yield name, base if outside else address, address if outside else None


def page_links(html: str, base: str, selectors: list[str]) -> Iterator[str]:
    """The addresses of a listing's further pages, each once."""
    page, seen = tree(html), set()
    for selector in selectors:
        for element in page.select(selector):
            address = urljoin(base, element.attrs.get("href", "")) if element.attrs.get("href") else ""
            if address and address not in seen:
                seen.add(address)
                yield address


def rows_of(pages: DataFrame, key: str, url: str, html: str, find: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    """(key, pos, the fields of ``schema``) for each tuple that ``find(html, url)`` gives of a page, in order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *found) for k, u, h in zip(batch[key], batch[url], batch[html]) for i, found in enumerate(find(h or "", u or ""))]
            yield pd.DataFrame(rows, columns=[key, "pos", *names])

    return pages.select(key, url, html).mapInPandas(run, f"{key} bigint, pos int, {schema}")
