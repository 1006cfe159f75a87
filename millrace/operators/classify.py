"""Classes of pages, links, errors and awards, by ordered rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of pages that stand in the way, in the order in which they are tried.
AGE_GATE_PATTERNS = (
    r"verify\s+your\s+age", r"(?:are\s+you\s+)?(?:of\s+)?legal\s+drinking\s+age", r"\b21\s*\+", r"21\s+(?:years?\s+)?(?:or\s+)?old(?:er)?",
    r"(?:i\s+am\s+)?(?:over\s+)?(?:18|19|20|21)\s+years?\s+old", r"age\s*(?:-|\s)?\s*gate", r"age\s*(?:-|\s)?\s*verification",
    r"enter\s+(?:your\s+)?(?:date\s+of\s+)?birth", r"confirm\s+(?:your\s+)?age",
)
CAPTCHA_PATTERNS = (r"\bcaptcha\b", r"\brecaptcha\b", r"g-recaptcha", r"hcaptcha", r"challenge[\s-]?form", r"google\.com/recaptcha", r"cloudflare.*challenge")
COOKIE_PATTERNS = (r"\bcookie\s*(?:consent|policy|notice)\b", r"\bgdpr\b", r"accept\s+(?:all\s+)?cookies", r"cookie\s+preferences", r"privacy\s+(?:consent|settings)")
RATE_PATTERNS = (r"too\s+many\s+requests", r"rate\s+limit(?:ed)?", r"slow\s+down", r"try\s+again\s+later", r"(?:ip|access)\s+blocked")
GEO_PATTERNS = (
    r"not\s+available\s+in\s+your\s+(?:region|country|location)", r"geo[\s-]?(?:blocked|restricted)", r"content\s+unavailable",
    r"access\s+denied.*(?:region|location)", r"restricted\s+(?:in\s+)?your\s+(?:region|country)",
)
MEMBERS_PATTERNS = (
    r"<form[^>]*login", r"<form[^>]*signin", r"<form[^>]*sign-in", r"<input[^>]*type=[\"']password[\"']",
    r"sign\s*in\s*to\s*(view|access|continue|read)", r"log\s*in\s*to\s*(view|access|continue|read)", r"login\s*to\s*(view|access|continue|read)",
    r"members?\s*only", r"member\s*exclusive", r"join\s*(now|today)\s*to\s*(access|view|read)", r"subscription\s*required", r"subscribe\s*to\s*(access|view|read|unlock)",
    r"\bpaywall\b", r"premium\s*content", r"unlock\s*(this|full|the)\s*(content|article)", r"paid\s*subscribers?\s*only",
    r"access\s*denied", r"restricted\s*area", r"authentication\s*required", r"please\s*(log\s*in|login|sign\s*in)",
)
MEMBERS_CODES = (401, 402, 403)
AGE_GATE_WORDS = (
    "legal drinking age", "are you 21", "are you of legal drinking age", "age verification", "verify your age", "confirm your age", "you must be 21",
    "you must be of legal age", "enter your date of birth", "please verify your age", "are you over 18", "are you over 21", "i am 21 or older",
    "i am of legal drinking age", "by entering this site", "must be of legal purchasing age",
)
SHORT_PAGE = 500
CLOUDFLARE_SIGNS = ("checking your browser", "just a moment...", "cf_chl_opt", "cf_chl_prog", "cf-browser-verification", "challenge-platform", "__cf_chl_tk")
CAPTCHA_SIGNS = ("g-recaptcha", "h-captcha", "recaptcha/api", "hcaptcha.com", 'name="captcha', "captcha_token", "captcha-challenge", "data-sitekey")
EMPTY_SHELLS = ('<div id="root"></div>', '<div id="__next"></div>', '<div id="app"></div>', "<app-root></app-root>", "<app-root>")
PAGINATION = r"(?i)[?&]page=\d+|/page/\d+|/p/\d+|[?&]offset=\d+|[?&]start=\d+"
CATEGORY = r"(?i)/category/|/categories/|/collection/|/collections/|/browse/|/shop/|/products/?$"
RELATED = r"(?i)related|similar|you-may-also|also-like|customers-also"
SKIPPED = r"(?i)\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|pdf|zip|exe)$|^mailto:|^tel:|^javascript:|^#|/cart|/checkout|/login|/signup|/account|/wishlist|/compare"
REGIONS = ("Scotch", "American", "Irish", "Japanese", "Canadian", "Australian", "Indian", "Taiwanese", "Kentucky", "Non-Kentucky", "Tennessee", "Speyside", "Islay", "Highland", "Lowland", "Campbeltown")


def any_pattern(text: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    return text.rlike(flags + "(?:" + "|".join(patterns) + ")")


def has_any(text: Column, signs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for sign in signs:
        out = out | F.contains(text, F.lit(sign))
    return out


def bare(html: Column) -> Column:
    """Text between tags, trimmed."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"^\s+|\s+$", "")


def obstacles(html: Column, code: Column) -> Column:
    """Array of (type, confidence) of what keeps a page's content away, in the order of the checks."""
    found = lambda condition, kind, sure: F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(sure).alias("confidence")))
    short = F.length(F.regexp_replace(html, r"^\s+|\s+$", "")) < SHORT_PAGE
    return F.array_compact(
        F.array(
            found(code == 429, "rate_limited", 1.0),
            F.when(code == 403, F.struct(F.lit("geo_blocked").alias("type"), F.when(any_pattern(html, GEO_PATTERNS), 0.9).otherwise(0.7).alias("confidence"))),
            found(any_pattern(html, AGE_GATE_PATTERNS), "age_gate", 0.9),
            found(any_pattern(html, CAPTCHA_PATTERNS), "captcha", 0.95),
            found(any_pattern(html, COOKIE_PATTERNS), "cookie_consent", 0.8),
            found((code != 429) & any_pattern(html, RATE_PATTERNS), "rate_limited", 0.85),
            found(short, "js_rendered", 0.7),
        )
    )


def members_only(html: Column, code: Column) -> Column:
    """Whether a page, or its status code, says that it is for members."""
    return F.coalesce(any_pattern(html, MEMBERS_PATTERNS), F.lit(False)) | F.coalesce(code.isin(*MEMBERS_CODES), F.lit(False))


def age_gate(text: Column, threshold: int = SHORT_PAGE) -> Column:
    """Whether a page is short, or asks for an age."""
    return (F.length(text) < threshold) | has_any(F.lower(text), AGE_GATE_WORDS)


def escalation(html: Column, code: Column, tier: Column, success_rate: Column) -> Column:
    """Why the next fetch tier is needed; null if it isn't. Tier 3 is the last."""
    low = F.lower(html)
    cloudflare = (F.length(html) <= 50000) & (has_any(low, CLOUDFLARE_SIGNS) | ((F.length(html) < 10000) & F.contains(low, F.lit("cloudflare ray id")) & (F.length(bare(html)) < 1000)))
    shell = F.lit(False)
    for sign in EMPTY_SHELLS:
        at = F.instr(low, sign)
        shell = shell | ((at > 0) & (F.length(bare(F.substr(html, at + len(sign)))) < 100))
    empty = F.length(bare(html)) < 200
    ok = code == 200
    reason = (
        F.when(code.isin(403, 429, 503), F.concat(F.lit("status_"), code.cast("string")))
        .when(ok & cloudflare, "cloudflare")
        .when(ok & has_any(low, CAPTCHA_SIGNS), "captcha")
        .when(ok & shell, "javascript")
        .when(ok & empty, "empty")
        .when(success_rate < 0.5, "low_success_rate")
    )
    return F.when(tier < 3, reason)


def start_tier(override: Column, needs_three: Column, protected: Column, scripted: Column, fetches: Column, rates: list[Column]) -> Column:
    """The first tier to try: overrides, then flags, then, from five fetches on, the first tier that mostly works."""
    learned = F.when(rates[0] >= 0.5, 1).when(rates[1] >= 0.5, 2).otherwise(3)
    return F.coalesce(override, F.when(needs_three | protected, 3).when(scripted, 2).when(fetches >= 5, learned).otherwise(1))


def error_class(name: Column, message: Column, code: Column) -> Column:
    """What kind of failure an exception's class, message and status code tell of; the first rule counts."""
    n, m = F.lower(name), F.lower(message)
    has = lambda c, *words: has_any(c, words)
    return (
        F.when(code == 403, "blocked")
        .when(code == 429, "rate_limit")
        .when(has(n, "timeout") | has(m, "timeout"), "timeout")
        .when(has(n, "connection", "socket", "network", "dns"), "connection")
        .when(has(m, "age") & has(m, "gate"), "age_gate")
        .when(has(n, "parse", "json", "decode"), "parse")
        .when(has(m, "api") | has(n, "api"), "api")
        .otherwise("unknown")
    )


def link_type(url: Column, text: Column, product_pattern: str) -> Column:
    """product, category, pagination (over both), related, or unknown."""
    base = F.when(url.rlike(product_pattern), "product").when(url.rlike(CATEGORY), "category")
    related = url.rlike(RELATED) | F.lower(text).rlike(RELATED)
    return F.when(url.rlike(PAGINATION), "pagination").otherwise(F.coalesce(base, F.when(related, "related"), F.lit("unknown")))


def link_priority(kind: Column, is_product: Column, is_internal: Column) -> Column:
    return F.when(~is_internal, 3).when(kind == "related", 9).when(is_product, 8).when(kind == "category", 6).otherwise(5)


def headings(html: Column, most: int = 20) -> Column:
    """Texts of h1 to h3, without inner tags, of 1 to 199 characters; the first ``most``."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    texts = F.transform(found, lambda h: F.trim(F.regexp_replace(h, "<[^>]+>", "")))
    return F.slice(F.filter(texts, lambda h: (F.length(h) > 0) & (F.length(h) < 200)), 1, most)


def keeps_structure(html: Column, heads: Column, url: Column) -> Column:
    """Whether a page is a list whose structure matters: by URL, headings, table rows, product items or cards."""
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    items = (count("(?i)<li[^>]*>") > 15) & (count(r"(?is)<li[^>]*>.*?(?:price|add.?to.?cart|\$|buy|shop).*?</li>") > 5)
    cards = sum((count(p) for p in (r"""(?i)class=["'][^"']*product[^"']*card[^"']*["']""", r"""(?i)class=["'][^"']*item[^"']*product[^"']*["']""", "(?i)data-product-id", "(?i)data-sku")), F.lit(0)) > 5
    return url.rlike(CATEGORY) | (F.size(heads) > 5) | (count("(?i)<tr[^>]*>") > 10) | items | cards


def award_level(heading: Column) -> Column:
    """World's Best, the first region's best, another "best ..." as it stands, or Winner."""
    low = F.trim(F.lower(heading))
    out = F.when(F.contains(low, F.lit("world's best")) | F.contains(low, F.lit("worlds best")), "World's Best")
    for region in REGIONS:
        out = out.when(low.rlike(rf"best\s+{region.lower()}"), f"Best {region}")
    return out.when(F.startswith(low, F.lit("best ")), F.trim(heading)).otherwise("Winner")


def first_word(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The class of the first rule (word, class) whose word the text contains."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for word, name in rules:
        hit = F.contains(low, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)
