"""Links of a site: page types, crawl policy, priority, discovery and the static crawl plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RIGHT, js_trim, let, matches
from ..functions.web import normalize_domain, normalize_url, strip_html

# Endings, paths, and the weighted rules of paths and anchors; the first rule that matches counts.
EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "mp4", "webm", "avi", "mov", "mp3", "wav", "zip", "tar", "gz", "rar", "7z", "exe", "dmg", "apk", "iso", "css", "js", "map", "xml", "json")
IGNORED = r"(/wp-content/plugins/|/wp-includes/|/cdn-cgi/|/(cart|checkout|basket|my-account|account|login|signin|signup|register|password-reset|logout|feed|rss|search|privacy-policy|terms-of-service|terms-and-conditions|terms-of-use|cookie-policy|disclaimer)(?![A-Za-z0-9_])|/page/\d+(?![A-Za-z0-9_])|/tag/|/category/|/author/|/archive/|/\d{4}/\d{2}/)"
PATH_RULES = (
    ("CONTACT", 120, "contact|contact-us|reach-us|get-in-touch|contactus|connect|touch|write-to-us|talk-to-us|customer-service"),
    ("ABOUT", 105, "about|about-us|aboutus|who-we-are|our-story|company|overview|corporate|mission|profile"),
    ("TEAM", 100, "team|our-team|leadership|people|our-people|meet-the-team|meet-our-team|staff|management|executives|board|directors|advisors"),
    ("LOCATION", 80, "locations|location|stores|branches|find-us|our-locations|offices|headquarters|office|store-locator"),
    ("SERVICES", 60, "services|our-services|products|solutions|what-we-do|offerings|capabilities|menu|pricing"),
    ("CAREERS", 30, "careers|jobs|join-us|work-with-us|opportunities"),
    ("SUPPORT", 20, "faq|help|support|client-support|help-center"),
    ("BLOG", -20, "blog|news|articles|press|media|posts|insights|updates|events"),
    ("PAGINATION", -50, r"tag|category|author|page/\d+|archive|/\d{4}/\d{2}"),
    ("COMMERCE_AUTH", -90, "cart|checkout|basket|my-account|account|login|signin|signup|register|password-reset"),
    ("LEGAL", -90, "privacy|terms|legal|disclaimer|cookies|cookie-policy|privacy-policy|terms-of-service|terms-of-use|tos"),
)
ANCHOR_RULES = (
    (100, r"contact(\s*us)?|get in touch|reach us|talk to us|speak with us|write to us|connect with us"),
    (90, r"about(\s*us)?|who we are|our story|company overview|about the company"),
    (85, "our people|meet the team|meet our team|our team|leadership|executive team|management|people|team"),
    (75, "find us|find a location|our locations|branches|stores|offices|headquarters"),
    (50, "our services|what we do|products|solutions|capabilities"),
    (20, "careers|join our team|join us|work with us"),
    (-100, "cart|checkout|login|sign in|my account|register"),
    (-100, "privacy policy|terms of service|terms & conditions|cookie preferences|legal notices"),
    (-30, "blog|news|latest posts"),
)
PAGE_TYPES = (
    ("CONTACT", "/contact|/reach-us|/get-in-touch", "contact us"),
    ("TEAM", "/team|/leadership|/people|/our-team|/staff", "our team|leadership"),
    ("ABOUT", "/about|/who-we-are|/company|/story", "about us"),
    ("LOCATION", "/location|/stores|/branches|/find-us", None),
    ("SERVICES", "/services|/products|/solutions|/features", None),
)
LOWEST = -40  # links at or below are not followed
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def path_of(url: Column) -> Column:
    """Lower-case path; the text itself where it is no http address."""


    def of(low: Column) -> Column:
        path = F.regexp_extract(low, r"^https?://[^/?#]*([^?#]*)", 1)
        return F.when(low.startswith("http"), F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))).otherwise(low)

    return let(F.lower(F.coalesce(url, F.lit(""))), of)


def page_type(url: Column, title: Column) -> Column:
    return let(F.struct(path_of(url).alias("p"), F.lower(F.coalesce(title, F.lit(""))).alias("t")), lambda s: _page_type(s["p"], s["t"]))


def _page_type(p: Column, t: Column) -> Column:
    out = F.when(p.isin("", "/", "/index.html", "/index.htm", "/home"), F.lit("HOMEPAGE"))
    for name, paths, titles in PAGE_TYPES:
        hit = matches(p, f"({paths})", False)
        out = out.when(hit | matches(t, f"({titles})", False) if titles else hit, F.lit(name))
    return out.otherwise(F.lit("GENERIC"))


def policy(url: Column, root: Column) -> Column:
    """Why an address may not be crawled; null if it may."""
    clean = js_trim(F.regexp_replace(F.lower(F.coalesce(root, F.lit(""))), r"^www\.", ""))
    parts = lambda t: F.struct(t.alias("t"), path_of(t).alias("path"), normalize_domain(t).alias("host"), clean.alias("root"))
    return let(let(js_trim(F.coalesce(url, F.lit(""))), parts), lambda s: _policy(s["t"], s["path"], s["host"], s["root"]))


def _policy(t: Column, path: Column, host: Column, clean: Column) -> Column:
    low = F.lower(t)
    last = F.substring_index(path, "/", -1)
    ending = F.when(F.contains(last, F.lit(".")), F.substring_index(last, ".", -1))
    scheme = F.regexp_extract(low, "^(javascript:|data:|file:|chrome:|chrome-extension:|blob:|about:)", 1)
    return (
        F.when(t == "", F.lit("Empty or invalid URL"))
        .when(scheme != "", F.concat(F.lit("Blocked protocol: "), scheme))
        .when(~matches(low, "^https?://", False), F.lit("Non-HTTP/HTTPS protocol"))
        .when(host == "", F.lit("Malformed URL syntax"))
        .when(clean == "", F.lit("Root domain not specified"))
        .when((host != clean) & ~F.endswith(host, F.concat(F.lit("."), clean)), F.concat(F.lit("External domain: "), host, F.lit(" (root: "), clean, F.lit(")")))
        .when(ending.isin(*EXTENSIONS), F.concat(F.lit("Excluded file extension: ."), ending))
        .when(matches(path, IGNORED, False), F.concat(F.lit("Excluded system path: "), path))
        .when(matches(t, r"[?&](s|q|search)(=|&|#|$)", False), F.lit("Search query result URL"))
    )


def _rule(path: Column, i: int, other: Column) -> Column:
    """The name (0) or score (1) of the first path rule that matches."""
    out = None
    for rule in PATH_RULES:
        hit = matches(path, f"/({rule[2]}){RIGHT}", False)
        out = F.when(hit, F.lit(rule[i])) if out is None else out.when(hit, F.lit(rule[i]))
    return out.otherwise(other)


def anchor_bonus(anchor: Column) -> Column:
    def of(t: Column) -> Column:
        out = F.when(t == "", F.lit(0))
        for bonus, words in ANCHOR_RULES:
            out = out.when(matches(t, rf"(?<![A-Za-z0-9_])({words}){RIGHT}"), F.lit(bonus))
        return out.otherwise(F.lit(0))

    return let(js_trim(F.coalesce(anchor, F.lit(""))), of)


def intent(url: Column, anchor: Column) -> Column:
    by_anchor = let(anchor_bonus(anchor), lambda b: F.when(b >= 95, F.lit("CONTACT")).when(b >= 85, F.lit("TEAM")).when(b >= 75, F.lit("ABOUT")).when(b >= 65, F.lit("LOCATION")).otherwise(F.lit("GENERIC")))
    return let(path_of(url), lambda p: _rule(p, 0, by_anchor))


def priority(url: Column, anchor: Column, depth: Column, container: Column, missing: Column | None = None) -> Column:
    """Score of a link, -100 to 300. missing: STRUCT of booleans email, phone, address, people, company, social."""
    box = F.upper(F.coalesce(container, F.lit("")))
    place = F.when(box.rlike("NAV|HEADER|MENU"), 15).when(box.rlike("FOOTER"), 8).when(box.rlike("BUTTON|CTA"), 10).otherwise(0)
    total = F.lit(20) + let(path_of(url), lambda p: _rule(p, 1, F.lit(0))) + anchor_bonus(anchor) + place
    if missing is not None:
        m = missing
        boost = lambda want: F.when((m["email"] | m["phone"] | m["address"]) & want.isin("CONTACT", "LOCATION"), 40).when(m["people"] & (want == "TEAM"), 45).when(m["company"] & (want == "ABOUT"), 35).otherwise(0)
        total = total + let(intent(url, anchor), boost) + F.when(m["social"] & (box.rlike("FOOTER") | matches(anchor, "social|follow")), 20).otherwise(0)
    total = total - F.greatest(depth - 1, F.lit(0)) * 20
    return F.greatest(F.lit(-100), F.least(F.lit(300), total)).cast("int")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, seq, href, anchor_text) of the anchors in the pages' html, by patterns; html goes no further."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), 1)
    texts = F.regexp_extract_all("html", F.lit(ANCHOR), 2)
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("seq", "a"))
    return rows.select("page_id", "url", "seq", js_trim(F.col("a.href")).alias("href"), strip_html(F.col("a.text")).alias("anchor_text"))


def absolute(href: Column, base: Column) -> Column:
    """A link against its page: absolute, root-relative and relative ones; normalized."""
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"(?i)^(https?://[^/?#]*[^?#]*)", 1), r"[^/]*$", "")
    folder = F.when(F.length(folder) <= F.length(root), F.concat(root, F.lit("/"))).otherwise(folder)
    full = F.when(matches(href, "^https?:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(folder, href))
    return normalize_url(full)


def discover(links: DataFrame) -> DataFrame:
    """Best link of each (page_id, target) from (page_id, seq, target, anchor_text, container, depth, root):
    allowed ones above LOWEST, the highest priority, the first of equal ones."""
    scored = links.where(policy(F.col("target"), F.col("root")).isNull()).withColumn("priority", priority(F.col("target"), F.col("anchor_text"), F.col("depth"), F.col("container"))).where(F.col("priority") > LOWEST)
    best = scored.groupBy("page_id", "target").agg(F.max_by(F.struct("seq", "anchor_text", "container", "depth", "priority"), F.struct("priority", -F.col("seq"))).alias("b"))
    return best.select("page_id", "target", "b.*").withColumn("intent", intent(F.col("target"), F.col("anchor_text")))


def static_plan(links: DataFrame, budget: int = 10) -> DataFrame:
    """The first `budget` (1 to 20) targets of each site by priority, each once: what a crawl without early exit visits."""
    budget = min(max(budget, 1), 20)
    once = links.groupBy("site", "target").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq"))
    w = Window.partitionBy("site").orderBy(F.desc("priority"), "seq", "target")
    return once.withColumn("visit", F.row_number().over(w)).where(F.col("visit") <= budget)
