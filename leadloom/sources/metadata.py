"""What a page says about itself in its head, by patterns over its tags: no tree is built, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, let, or_null
from ..operators.links import page_type

TITLE, META, LINK, HTML = r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<meta\s[^>]*>", r"(?is)<link\s[^>]*>", r"(?is)<html\s[^>]*>"
# Fields by the meta tag that holds them.
NAMED = {"meta_description": ("description", "Description"), "meta_keywords": ("keywords",), "meta_author": ("author",), "twitter_card": ("twitter:card",), "twitter_site": ("twitter:site",), "twitter_title": ("twitter:title",), "twitter_description": ("twitter:description",)}
GRAPH = {"og_site_name": "og:site_name", "og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "og_url": "og:url", "og_type": "og:type"}
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def attribute(name: str) -> str:
    """A pattern of an attribute: its value is group 2, 3 or 4, after the quotes it has."""
    return rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _attr(tag: Column, name: str) -> Column:
    get = lambda i: or_null(F.regexp_extract(tag, attribute(name), i))
    return F.coalesce(get(2), get(3), get(4))


def _decoded(c: Column) -> Column:
    for code, mark in ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(mark))
    return js_trim(c)


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, url, page_type, title, ...) of (page_id, url, html): what is not there is empty. Of several tags of one
    name the first counts. Of the html only its few tags are kept before anything else is asked of them."""
    pairs = lambda tags: F.transform(tags, lambda t: F.struct(_attr(t, "name").alias("name"), _attr(t, "property").alias("property"), _attr(t, "content").alias("content")))
    html = F.coalesce("html", F.lit(""))
    some = pages.select(
        "page_id", "url", F.regexp_extract(html, TITLE, 1).alias("title"), pairs(F.regexp_extract_all(html, F.lit(META), F.lit(0))).alias("metas"),
        F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: F.lower(F.coalesce(_attr(t, "rel"), F.lit(""))) == "canonical").alias("canonical"), F.regexp_extract(html, HTML, 0).alias("root"),
    )
    first = lambda kind, name: F.get(F.filter("metas", lambda m: m[kind] == name), F.lit(0))["content"]
    text = lambda c: F.coalesce(_decoded(c), F.lit(""))
    named = {f: text(F.coalesce(*[or_null(_decoded(first("name", n))) for n in names])) for f, names in NAMED.items()}
    graph = {f: text(first("property", n)) for f, n in GRAPH.items()}
    title = _decoded(F.col("title"))
    return some.select("page_id", "url", let(title, lambda t: page_type(F.col("url"), t)).alias("page_type"), title.alias("title"), *[c.alias(f) for f, c in (named | graph).items()], text(_attr(F.get("canonical", F.lit(0)), "href")).alias("canonical_url"), text(_attr(F.col("root"), "lang")).alias("language"))
