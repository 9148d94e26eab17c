"""Link extraction and filtering over stored web pages.

All links of a page sit in that page's row, so each strategy is a row-local
array expression and the whole chain runs without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.names import PRODUCT_PATH, product_address

# ---- Fixed values ------------------------------------------------------------
SUCCESS_WORDS = ("watchcharts", "chart", "price", "watch")
CHALLENGE_PHRASES = (
    "checking your browser",
    "just a moment",
    "cf-browser-verification",
    "verify you are human",
)
BROAD_WORD = "watches"
BROAD_LIMIT = 50
LISTING_PATH = "/brand/"
# ------------------------------------------------------------------------------

ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""

Strategy = Callable[[Column, Column], Column]
"""(links, fragment) -> links: each link is a struct of ``raw`` and ``href``."""


def _absolute(raw: Column, url: Column) -> Column:
    """Resolve a link against its page address."""
    origin = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    bare = F.regexp_replace(url, r"[?#].*$", "")
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(
        F.regexp_replace(bare, r"[^/]*$", "")
    )
    return (
        F.when(raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .when(raw.startswith("#") | raw.startswith("?"), F.concat(bare, raw))
        .otherwise(F.concat(folder, raw))
    )


def links(html: Column, url: Column) -> Column:
    """All anchors of a page in document order."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))
    return F.transform(
        F.filter(found, lambda raw: raw != ""),
        lambda raw: F.struct(raw.alias("raw"), _absolute(raw, url).alias("href")),
    )


def strict(path_fragment: str = PRODUCT_PATH) -> Strategy:
    """Links under the product path whose address names the fragment."""

    def run(found: Column, fragment: Column) -> Column:
        return F.filter(
            found,
            lambda x: F.contains(x["raw"], F.lit(path_fragment)) & F.contains(F.lower(x["href"]), fragment),
        )

    return run


def broad(word: str = BROAD_WORD, first: int = BROAD_LIMIT, not_under: str = LISTING_PATH) -> Strategy:
    """Among the first links holding ``word``: those naming the fragment, no listings."""

    def run(found: Column, fragment: Column) -> Column:
        head = F.slice(F.filter(found, lambda x: F.contains(x["raw"], F.lit(word))), 1, first)
        return F.filter(
            head,
            lambda x: F.contains(F.lower(x["href"]), fragment)
            & ~F.contains(F.lower(x["href"]), F.lit(not_under)),
        )

    return run


def _hrefs(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["href"]))


def _take(arr: Column, n: Column) -> Column:
    return F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)))


def extract(
    pages: DataFrame, fragment: Column, quota: int, strategies: list[Strategy],
    key: str = "page_id", url: str = "url", html: str = "html", keep: list[str] | None = None,
) -> DataFrame:
    """Distinct links per page from a chain of strategies.

    Each strategy may add what the quota still leaves; it searches on its own, so
    links it shares with an earlier one use up its allowance. ``keep`` names page
    columns to repeat on each link.
    """
    keep = keep or []
    cur = pages.select(
        key, *keep, links(F.col(html), F.col(url)).alias("_links"), fragment.alias("_fragment")
    )
    cur = cur.withColumn("_urls", F.array().cast("array<string>"))
    for strategy in strategies:
        left = F.lit(quota) - F.size("_urls")
        found = _take(_hrefs(strategy(F.col("_links"), F.col("_fragment"))), left)
        cur = cur.withColumn("_urls", F.array_union("_urls", found))
    return cur.select(key, *keep, F.posexplode("_urls").alias("pos", "url"))


def default_chain(path_fragment: str = PRODUCT_PATH) -> list[Strategy]:
    """Two strict passes (script and path query agree on stored pages), then broad."""
    return [strict(path_fragment), strict(path_fragment), broad()]


def is_challenge(
    html: Column, success: tuple[str, ...] = SUCCESS_WORDS, phrases: tuple[str, ...] = CHALLENGE_PHRASES
) -> Column:
    """A page with under two success words that shows a challenge phrase."""
    text = F.lower(html)
    hits = reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in success])
    phrase = reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])
    return (hits < 2) & phrase


def targets(found: DataFrame, brand: Column, slug: Column, path_fragment: str = PRODUCT_PATH) -> DataFrame:
    """Target records out of extracted links."""
    parts = product_address(F.col("url"), path_fragment)
    return found.select(
        brand.alias("brand"), parts["model_name"].alias("model_name"), "url",
        parts["watch_id"].alias("watch_id"), parts["model_id"].alias("model_id"), slug.alias("slug"),
    )
