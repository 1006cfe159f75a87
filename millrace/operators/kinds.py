"""Kinds of products, sources, pages and search results: ordered word rules over fixed tables, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import contains_any

# Words of the product kinds that awards are kept for, and words that speak against any.
PORT_WORDS = ("tawny port", "ruby port", "vintage port", "late bottled vintage", "lbv port", "colheita", "white port", "port wine", "porto")
WHISKEY_WORDS = (
    "whisky", "whiskey", "scotch", "bourbon", "rye whiskey", "single malt", "blended malt", "blended scotch", "irish whiskey",
    "tennessee whiskey", "canadian whisky", "japanese whisky", "grain whisky", "malt whisky",
)
WANTED_WORDS = {
    "whiskey": ("whisky", "whiskey", "bourbon", "scotch", "rye whiskey", "single malt", "blended malt", "irish whiskey", "tennessee", "canadian whisky", "japanese whisky", "malt whisky"),
    "port_wine": ("port", "porto", "tawny", "ruby port", "vintage port", "late bottled vintage", "lbv", "colheita", "white port"),
    "brandy": ("brandy", "cognac", "armagnac", "calvados", "pisco", "grappa", "eau de vie"),
    "rum": ("rum", "rhum", "cachaca", "ron"),
    "gin": ("gin", "genever", "london dry"),
    "vodka": ("vodka",),
    "tequila": ("tequila", "mezcal", "sotol"),
}
UNWANTED_WORDS = ("winery", "vineyard", "wine cellar", "chateau", "domaine", "bodega", "vino", "estate wine", "wine estate")
# Spellings of whiskey types and the types they stand for.
WHISKEY_TYPES = {
    "scotch_single_malt": (
        "single malt", "single malt scotch", "single_malt_scotch", "single malt scotch whisky", "speyside single malt", "highland single malt",
        "islay single malt", "lowland single malt", "campbeltown single malt", "scotch single malt", "scotch_single_malt",
    ),
    "scotch_blend": ("blended scotch", "blended scotch whisky", "scotch blend", "scotch_blend"),
    "bourbon": (
        "bourbon", "kentucky bourbon", "kentucky straight bourbon", "kentucky straight bourbon whiskey", "small batch bourbon",
        "single barrel bourbon", "straight bourbon", "wheated bourbon",
    ),
    "tennessee": ("tennessee", "tennessee whiskey", "tennessee whisky"),
    "rye": ("rye", "rye whiskey", "straight rye", "straight rye whiskey", "kentucky straight rye"),
    "american_single_malt": ("american single malt", "american_single_malt"),
    "irish_blend": ("irish", "irish whiskey", "irish blend", "irish_blend"),
    "irish_single_malt": ("irish single malt", "irish_single_malt"),
    "irish_single_pot": ("irish single pot still", "single pot still", "irish_single_pot"),
    "japanese": ("japanese", "japanese whisky", "japanese single malt"),
    "canadian": ("canadian", "canadian whisky", "canadian rye"),
    "indian": ("indian", "indian whisky", "indian single malt"),
    "taiwanese": ("taiwanese", "taiwanese whisky", "taiwan"),
    "australian": ("australian", "australian whisky"),
    "world_whiskey": ("world whiskey", "world whisky", "world_whiskey", "other"),
}
# By country, the types that words of the name tell, in order, and the type otherwise.
COUNTRY_TYPES = (
    (("scotland", "uk", "united kingdom"), (("blend", "scotch_blend"),), "scotch_single_malt"),
    (("usa", "united states", "america"), (("bourbon", "bourbon"), ("tennessee", "tennessee"), ("rye", "rye"), ("single malt", "american_single_malt")), "bourbon"),
    (("ireland", "irish"), (("single pot", "irish_single_pot"), ("pot still", "irish_single_pot"), ("single malt", "irish_single_malt")), "irish_blend"),
    (("japan", "japanese"), (), "japanese"),
    (("canada", "canadian"), (), "canadian"),
    (("india",), (), "indian"),
    (("taiwan",), (), "taiwanese"),
    (("australia",), (), "australian"),
)
# Words of a port's style in a name, and patterns of it in a text, in the order in which they count.
PORT_STYLES = (
    ("lbv", "lbv"), ("late bottled vintage", "lbv"), ("colheita", "colheita"), ("vintage", "vintage"), ("tawny", "tawny"), ("ruby", "ruby"),
    ("white", "white"), ("branco", "white"), ("ros", "rose"), ("pink", "rose"), ("crusted", "crusted"), ("quinta", "single_quinta"), ("garrafeira", "garrafeira"),
)
PORT_PATTERNS = (
    ("single_quinta", r"\bsingle\s+quinta\b"), ("lbv", r"\blbv\b|\blate\s+bottled\s+vintage\b"), ("white_port", r"\bwhite\s+port\b"),
    ("rose_port", r"\bros[eé]\s+port\b|\bpink\s+port\b"), ("garrafeira", r"\bgarrafeira\b"), ("colheita", r"\bcolheita\b"), ("crusted", r"\bcrusted\b"),
    ("tawny", r"\btawny\b"), ("ruby", r"\bruby\b"), ("vintage", r"\bvintage\s+port\b|\b(?<!bottled\s)(?<!quinta\s)vintage\b"),
)
MEDAL_PATTERNS = (("Platinum", r"\bplatinum\b|\bbest\s+in\s+show\b"), ("Gold", r"\bgold\b"), ("Silver", r"\bsilver\b"), ("Bronze", r"\bbronze\b"))
SCORE_PATTERNS = (r"(\d{2,3})\s*points", r"score[:\s]+(\d{2,3})", r"(\d{2,3})/100")
FORTIFIED_PRODUCERS = (
    "taylor", "graham", "fonseca", "sandeman", "dow", "warre", "cockburn", "croft", "quinta do noval", "niepoort", "ramos pinto", "ferreira",
    "kopke", "burmester", "churchill", "taylor fladgate", "taylor's", "graham's", "fonseca guimaraens", "warre's", "cockburn's", "dow's",
    "croft port", "galpin peak", "boplaas", "allesverloren", "de krans", "axe hill", "calitzdorp", "seppeltsfield", "yalumba", "penfolds",
    "morris", "chambers", "campbells",
)
# Words of wanted kinds in a competition's names, and words of company names.
KIND_WORDS = ("whisky", "whiskey", "bourbon", "scotch", "rye", "malt", "single malt", "blended", "port", "porto", "tawny", "ruby", "vintage port", "lbv", "colheita")
COMPANY_WORDS = ("winery", "vineyard", "wine cellar", "distillery", "company", "ltd", "llc", "inc", "estate", "cellars", "bodega", "chateau")
# Parts of the names and addresses of sources, by category, in the order in which they count.
SOURCE_CATEGORIES = {
    "database": ("whiskybase", "whiskyflavour"),
    "competition": (
        "sfspiritscomp", "whiskeycomp", "iwsc", "spiritsselection", "vegasspiritawards", "thetastingalliance", "distilling.com", "whiskycompetition",
        "worldwhiskiesawards", "worlddrinksawards", "internationalspiritschallenge", "scottishwhiskyawards", "oswa.co.uk", "irishwhiskeyawards",
        "globalspiritsmasters", "nyispiritscompetition", "londonspiritscompetition", "thespiritsbusiness", "internationalwinechallenge",
        "winesofportugal", "decanter.com/decanter-awards",
    ),
    "producer": ("heavenhill", "balconesdistilling", "milehidistilling", "xaver-peiting"),
    "retailer": (
        "masterofmalt", "thewhiskyexchange", "maltwhisky", "ewhisky", "whiskyhaus", "whic.de", "scoma.de", "bottlebarn", "mikes-whiskeyhandel",
        "sieberts-whiskywelt", "abonauten", "tastillery", "niococktails", "d-s-m.com", "spiritly", "topwhiskies", "whisky-schnack", "089tastings",
        "aromaster",
    ),
    "news": (
        "tagesschau", "stern", "t-online", "focus", "thueringer-allgemeine", "foodanddrink.scotsman", "irishtimes", "telegraph", "derstandard",
        "deutschlandfunk", "ft.com", "nationalgeographic", "therakyatpost", "restaurantindia", "gqindia", "businessoffashion", "lonelyplanet",
    ),
}
SCRIPTED_SOURCES = ("forbes", "robbreport", "decanter", "vinepair", "yahoo", "aol", "nytimes", "telegraph", "businessoffashion")
PROXIED_SOURCES = ("forbes", "robbreport", "gq", "businessoffashion", "ft.com")
# Hosts of brands, shops and reviews.
OFFICIAL_HOSTS = (
    "ardbeg.com", "lagavulin.com", "obanwhisky.com", "talisker.com", "bulleit.com", "elijahcraig.com", "makersmark.com", "wildturkeybourbon.com",
    "buffalotracedistillery.com", "fourrosebourbon.com", "jimbeam.com", "woodfordreserve.com", "jackdaniels.com", "heavenhilldistillery.com",
    "grahams-port.com", "taylor.pt", "dows-port.com", "fonseca.pt", "sandeman.com", "warre.pt",
)
TRUSTED_HOSTS = (
    "masterofmalt.com", "whisky.com", "totalwine.com", "wine.com", "drizly.com", "reservebar.com", "caskers.com", "flaviar.com", "klwines.com",
    "binnys.com", "astorwines.com", "thewhiskyexchange.com",
)
RETAILERS = (
    "masterofmalt", "thewhiskyexchange", "whiskyexchange", "totalwine", "wine.com", "drizly", "reservebar", "klwines", "finedrams", "thewhiskyshop",
    "amazon", "ebay", "walmart", "target", "bevmo", "caskers", "liquor.com",
)
RETAILERS_V2 = ("masterofmalt", "thewhiskyexchange", "whiskyexchange", "totalwine", "wine.com", "drizly", "reservebar", "klwines", "finedrams", "thewhiskyshop", "amazon", "ebay", "walmart")
SHOP_HOSTS = ("thewhiskyexchange.com", "masterofmalt.com", "whiskybase.com", "totalwine.com", "klwines.com", "drizly.com", "reservebar.com", "caskers.com", "wine-searcher.com")
REVIEW_HOSTS = ("whiskyadvocate.com", "whisky.com", "thewhiskeywash.com", "maltwhiskyreviews.com", "breakingbourbon.com")
# Hosts that results, official sites and targets are never taken from, and hosts of targets that go first.
SKIPPED_RESULTS = ("amazon.com", "ebay.com", "walmart.com", "target.com", "facebook.com", "instagram.com", "twitter.com", "youtube.com", "reddit.com", "pinterest.com")
NEVER_OFFICIAL = (
    "thewhiskyexchange.com", "masterofmalt.com", "whiskybase.com", "drinksupermarket.com", "amazon.com", "amazon.co.uk", "ebay.com", "ebay.co.uk",
    "wine-searcher.com", "vivino.com", "totalwine.com", "klwines.com", "caskers.com", "reservebar.com", "drizly.com", "facebook.com", "twitter.com",
    "instagram.com", "linkedin.com", "youtube.com", "wikipedia.org", "reddit.com",
)
EXCLUDED_HOSTS = (
    "wikipedia.org", "reddit.com", "facebook.com", "twitter.com", "instagram.com", "pinterest.com", "youtube.com", "amazon.com", "amazon.co.uk",
    "ebay.com", "ebay.co.uk", "linkedin.com", "tiktok.com", "quora.com",
)
PRIORITY_HOSTS = (
    "whiskyadvocate.com", "thewhiskeywash.com", "robbreport.com", "vinepair.com", "breakingbourbon.com", "masterofmalt.com", "thewhiskyexchange.com",
    "wine-searcher.com", "vivino.com", "tastingtable.com", "wineenthusiast.com", "decanter.com", "whiskybase.com", "distiller.com",
)
TARGET_WORDS = ("review", "rating", "score", "tasting", "best", "top")
OFFICIAL_TITLES, OFFICIAL_SNIPPETS = ("official", "home", "welcome to"), ("official", "our distillery", "our whisky", "visit us")
# Words that tell the kind of a search.
QUERY_KINDS = (("whiskey", ("whisky", "whiskey", "scotch", "bourbon", "rye")), ("port_wine", ("port", "wine")), ("rum", ("rum",)), ("gin", ("gin",)))
# Patterns of list pages and of pages of one product.
LIST_PATTERNS = (
    r"search[-_]?results", r"product[-_]?list", r"product[-_]?grid", r"results[-_]?page", r"category[-_]?page",
    r'<div[^>]*class="[^"]*product[-_]?card[^"]*"[^>]*>.*<div[^>]*class="[^"]*product[-_]?card', "pagination", r"page[-_]?nav", r"showing\s+\d+\s+(of|to)\s+\d+",
)
SINGLE_PATTERNS = (r"product[-_]?detail", r"product[-_]?page", r"add[-_]?to[-_]?cart", r"buy[-_]?now", r"<h1[^>]*>.*?(whisky|whiskey|bourbon|port|wine)", r"abv|alcohol\s+by\s+volume", r"tasting[-_]?notes")
CARD_PATTERN, PAGE_OF_PATTERN, CART_PATTERN = r'<div[^>]*class="[^"]*product[-_]?card[^"]*"', r"page\s*\d+\s*of\s*\d+", r"add[-_\s]?to[-_\s]?cart|buy[-_\s]?now"
# Words of reasons why a higher fetch tier was needed.
SCRIPT_REASONS = ("javascript", "js rendering", "js placeholder", "js-heavy")
PROTECTION_REASONS = ("cloudflare", "captcha", "403", "bot", "challenge")
# Brands that names begin with; some names begin with a longer form of the brand, some brands end at a word.
BRANDS = (
    "Booker's", "Maker's Mark", "Russell's Reserve", "Evan Williams", "Jack Daniel's", "Johnnie Walker", "Dewar's", "Buffalo Trace", "Wild Turkey",
    "Jim Beam", "Elijah Craig", "Four Roses", "Woodford Reserve", "Bulleit", "Knob Creek", "Old Forester", "Old Grand-Dad", "Old Fitzgerald",
    "Heaven Hill", "Angel's Envy", "Glenfiddich", "Glenlivet", "GlenAllachie", "Benriach", "Macallan", "Ardbeg", "Laphroaig", "Lagavulin",
    "Highland Park", "Talisker", "Oban", "Bowmore", "1792",
)
WHOLE_WORD_BRANDS = ("Balvenie", "Kavalan", "Arran")
BRAND_END = r"(?i)^(.+?)(?:\s+\d|\s+Year|\s+YO|\s+y\.o\.|$)"
KIND_ENDING = r"(?i)\s+(Bourbon|Whiskey|Whisky|Rye|Single Malt)$"
#: Days after which a source that needed the last tier is tried at lower ones again.
RETRY_DAYS = 3


def low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def first_hit(rules, otherwise: str | None = None) -> Column:
    """The value of the first (condition, value) that holds."""
    out = None
    for condition, value in rules:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def award_kind(name: Column, category: Column, competition: Column) -> Column:
    """port_wine or whiskey, by name, category and competition; null for kinds that aren't kept. Port goes first."""
    every = F.concat_ws(" ", low(name), low(category), low(competition))
    some_port = F.contains(every, F.lit(" port")) | F.startswith(every, F.lit("port")) | F.contains(low(name), F.lit("port "))
    return (
        F.when(contains_any(every, PORT_WORDS), "port_wine")
        .when(some_port & ~contains_any(every, ("brandy", "cognac")), "port_wine")
        .when(contains_any(every, WHISKEY_WORDS), "whiskey")
    )


def wanted_award(name: Column, category: Column, kinds: list[str]) -> Column:
    """Whether an award is of one of the kinds and has no word that speaks against it; unknown kinds let all pass."""
    words = tuple(w for k in kinds for w in WANTED_WORDS.get({"whisky": "whiskey"}.get(k.lower(), k.lower()), ()))
    if not words:
        return F.lit(True)
    both = F.concat_ws(" ", low(name), low(category))
    return (contains_any(low(name), words) | contains_any(low(category), words)) & ~contains_any(both, UNWANTED_WORDS)


def whiskey_type(country: Column, name: Column) -> Column:
    """The whiskey type that a country and the name's words tell; null without a country."""
    place, said = F.lower(F.trim(country)), low(name)
    rules = []
    for places, words, otherwise in COUNTRY_TYPES:
        here = place.isin(*places)
        rules += [(here & F.contains(said, F.lit(w)), kind) for w, kind in words] + [(here, otherwise)]
    return F.when(F.coalesce(place, F.lit("")) != "", first_hit(rules, "world_whiskey"))


def whiskey_class(text: Column) -> Column:
    """The type that a spelling stands for, world_whiskey for unknown ones; null stays null."""
    table = F.create_map(*(F.lit(x) for kind, spellings in WHISKEY_TYPES.items() for s in spellings for x in (s, kind)))
    return F.when(text.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.trim(text))), F.lit("world_whiskey")))


def port_style(name: Column) -> Column:
    """A port's style by the first of the style words in its name; "ros" anywhere is rosé."""
    return first_hit([(F.contains(low(name), F.lit(w)), style) for w, style in PORT_STYLES])


def port_style_in(text: Column) -> Column:
    """A port's style by the first pattern that a text has."""
    return first_hit([(text.rlike("(?i)" + p), style) for style, p in PORT_PATTERNS])


def medal_in(text: Column) -> Column:
    return first_hit([(F.coalesce(text, F.lit("")).rlike("(?i)" + p), medal) for medal, p in MEDAL_PATTERNS], "Unknown")


def score_in(text: Column) -> Column:
    """The score by the first pattern whose first number is at most 100; or null."""
    number = lambda p: F.regexp_extract(text, "(?i)" + p, 1).try_cast("int")
    return F.coalesce(*(F.when(number(p) <= 100, number(p)) for p in SCORE_PATTERNS))


def fortified(producer: Column) -> Column:
    """Whether a producer's name has a known producer's in it, or is part of one."""
    name = F.trim(low(producer))
    inside = F.exists(F.array(*map(F.lit, FORTIFIED_PRODUCERS)), lambda p: F.contains(p, name))
    return (name != "") & (contains_any(name, FORTIFIED_PRODUCERS) | inside)


def valid_name(name: Column, category: Column) -> Column:
    """Whether an award's name is a product's: three characters, not a year, no company without a wanted kind."""
    known = contains_any(low(name), KIND_WORDS) | contains_any(low(category), KIND_WORDS)
    fine = (F.length(name) >= 3) & ~F.trim(name).rlike(r"^\d{4}$") & (~contains_any(low(name), COMPANY_WORDS) | known)
    return F.coalesce(fine, F.lit(False))


def source_category(name: Column, url: Column) -> Column:
    """The first category one of whose words is in a source's name or address; review otherwise."""
    both = F.concat_ws(" ", low(name), low(url))
    return first_hit([(contains_any(both, words), kind) for kind, words in SOURCE_CATEGORIES.items()], "review")


def source_class(host: Column) -> Column:
    return F.when(contains_any(low(host), OFFICIAL_HOSTS), "official_brand").when(low(host).isin(*TRUSTED_HOSTS), "trusted_retailer").otherwise("other")


def result_category(host: Column, title: Column, snippet: Column, search: Column) -> Column:
    """What a search result is: by host, by "official" in its texts, then by what was searched for and its words."""
    words = F.concat(low(title), low(snippet))
    official = F.contains(low(title), F.lit("official")) | F.contains(low(snippet), F.lit("official"))
    return first_hit(
        [
            (contains_any(low(host), SHOP_HOSTS), "retailer"),
            (contains_any(low(host), REVIEW_HOSTS), "review"),
            (official, "official"),
            ((search == "price") & contains_any(words, ("buy", "shop", "price", "$", "cart")), "retailer"),
            ((search == "review") & contains_any(words, ("review", "tasting", "notes", "rating")), "review"),
            (search == "official", "potential_official"),
        ],
        "unknown",
    )


def result_priority(host: Column, name: Column) -> Column:
    """The place of a search result for a product, small ones first: 0 for brands' own hosts, 5 for hosts with one of
    the name's first two words, 10 and up for trusted shops in their order, 50 for others; null for hosts left out."""
    words = F.slice(F.split(F.trim(F.lower(name)), r"\s+"), 1, 2)
    trusted = F.array_position(F.array(*map(F.lit, TRUSTED_HOSTS)), host)
    place = F.when(contains_any(host, OFFICIAL_HOSTS), 0).when(F.exists(words, lambda w: F.contains(host, w)), 5).when(trusted > 0, (9 + trusted).cast("int")).otherwise(50)
    return F.when(~contains_any(host, SKIPPED_RESULTS), place)


def may_be_official(host: Column) -> Column:
    return ~contains_any(host, NEVER_OFFICIAL)


def looks_official(host: Column, title: Column, snippet: Column, brand: Column) -> Column:
    """Whether a result looks like a brand's own site: the brand in its host, or words of its title or snippet."""
    named = F.contains(F.translate(host, "-.", ""), F.translate(low(brand), " '", ""))
    return named | contains_any(low(title), OFFICIAL_TITLES) | contains_any(low(snippet), OFFICIAL_SNIPPETS)


def target_score(host: Column, position: Column, snippet: Column) -> Column:
    """50, 30 for a priority host, up to 20 by position, 5 for each telling word; null for excluded hosts."""
    words = sum((F.contains(low(snippet), F.lit(w)).cast("int") for w in TARGET_WORDS), F.lit(0))
    score = 50 + F.when(contains_any(low(host), PRIORITY_HOSTS), 30).otherwise(0) + F.greatest(F.lit(0), 20 - 2 * position) + 5 * words
    return F.when(~contains_any(low(host), EXCLUDED_HOSTS), score)


def query_kind(query: Column) -> Column:
    return first_hit([(contains_any(low(query), words), kind) for kind, words in QUERY_KINDS], "spirits")


def page_type(html: Column) -> Column:
    """list or single, by how many patterns of each kind a page has; cards, page numbers and carts count more."""
    text = F.lower(html)
    count = lambda patterns: sum((F.when(text.rlike("(?is)" + p), 1).otherwise(0) for p in patterns), F.lit(0))
    cards = F.when(F.regexp_count(html, F.lit("(?i)" + CARD_PATTERN)) >= 3, 3).otherwise(0)
    listed = count(LIST_PATTERNS) + cards + F.when(text.rlike(PAGE_OF_PATTERN), 2).otherwise(0)
    return F.when(listed > count(SINGLE_PATTERNS) + F.when(text.rlike(CART_PATTERN), 2).otherwise(0), "list").otherwise("single")


def escalation_flags(reason: Column) -> Column:
    """struct(js_heavy, bot_protected) that a reason for a higher tier tells of a domain."""
    return F.struct(contains_any(low(reason), SCRIPT_REASONS).alias("js_heavy"), contains_any(low(reason), PROTECTION_REASONS).alias("bot_protected"))


def recommended_tier(first: Column, second: Column, least: float = 0.5) -> Column:
    """The cheapest tier that mostly works."""
    return F.when(first >= least, 1).when(second >= least, 2).otherwise(3)


def retries_lower(needs_three: Column, last_try: Column, as_of: str) -> Column:
    """Whether a source at the last tier is due for lower ones: never tried, or RETRY_DAYS full days ago."""
    days = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(last_try)) / 86400)
    return F.coalesce(needs_three, F.lit(False)) & (last_try.isNull() | (days >= RETRY_DAYS))


def producer_rank(host: Column, brand: Column, producer: Column, retailers: tuple[str, ...] = RETAILERS) -> Column:
    """0 for hosts with the brand's or producer's name, 1 for others, 2 for shops; names count from four letters on."""
    plain = lambda c: F.translate(low(c), " '-", "")
    bare = F.translate(low(host), "-.", "")
    named = lambda c: (F.length(plain(c)) > 3) & F.contains(bare, plain(c))
    return F.when(contains_any(low(host), retailers), 2).when(named(brand) | named(producer), 0).otherwise(1)


def brand_from_name(name: Column) -> Column:
    """A known brand that a name begins with; else its words before a number or age, without a kind at their end."""
    said = F.trim(name)
    known = [(F.startswith(F.lower(said), F.lit(b.lower())), b) for b in BRANDS]
    known += [(said.rlike(rf"(?i)^{b}\b"), b) for b in WHOLE_WORD_BRANDS]
    guess = F.nullif(F.regexp_replace(F.trim(F.regexp_extract(said, BRAND_END, 1)), KIND_ENDING, ""), F.lit(""))
    return F.when(F.coalesce(said, F.lit("")) != "", F.coalesce(first_hit(known), guess))
