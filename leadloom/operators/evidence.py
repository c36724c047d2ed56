"""Evidence rows: validation, confidence, corroboration, conflict resolution and the pivot to leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, matches, or_null, round3
from ..functions.web import evaluate_email, is_company_name, is_phone, is_social_profile, normalize_email, normalize_phone, normalize_text, normalize_url
from ..sources.storage import cut

# Base confidences of sources, page modifiers, ranks.
BASE = {"json-ld": 0.96, "microdata": 0.90, "mailto": 0.92, "tel": 0.92, "semantic-dom": 0.85, "open-graph": 0.82, "metadata": 0.80, "contextual-label": 0.72, "team-card": 0.86, "regex-fallback": 0.55, "unknown": 0.50}
KIND = {"json-ld-organization": 0.98, "json-ld-contactpoint": 0.97, "mailto-protocol": 0.94, "tel-protocol": 0.94, "semantic-address-tag": 0.90, "body-regex-fallback": 0.55}
MODIFIERS = {
    "CONTACT": {"email": 0.08, "phone": 0.08, "address": 0.08, "city": 0.06, "country": 0.06, "booking_url": 0.05},
    "ABOUT": {"company_name": 0.06, "description": 0.08, "linkedin": 0.05},
    "TEAM": {"people": 0.08, "linkedin": 0.06},
    "HOMEPAGE": {"company_name": 0.05, "website": 0.05},
    "LEGAL": {"email": -0.30, "phone": -0.30, "address": -0.20},
    "BLOG": {"email": -0.15, "phone": -0.15, "address": -0.15},
}
SOURCE_RANK = {"json-ld": 10, "mailto": 9, "tel": 9, "microdata": 8, "semantic-dom": 7, "open-graph": 6, "metadata": 5, "contextual-label": 4, "team-card": 4, "regex-fallback": 1}
PAGE_RANK = {"CONTACT": 5, "ABOUT": 4, "TEAM": 3, "HOMEPAGE": 2, "GENERIC": 1, "BLOG": 0, "LEGAL": -1}
THRESHOLD = 0.45
FIELDS = ("company_name", "email", "phone", "address", "city", "region", "country", "postal_code", "description", "linkedin", "twitter_x", "facebook", "instagram", "youtube", "github", "booking_url", "ordering_url", "menu_url", "website")


def lookup(values: dict, c: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def initial_confidence(field: Column, value: Column, source: Column, kind: Column, page_type: Column, classification: Column) -> Column:
    """Score 0 to 1 of one observation, from its source, kind, page and class."""
    src, page = F.lower(F.coalesce(source, F.lit("unknown"))), F.upper(F.coalesce(or_null(page_type), F.lit("GENERIC")))
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv]), F.coalesce(kind, F.lit(""))), lookup(BASE, src, 0.50))
    score = score + lookup({f"{p}:{f}": v for p, fs in MODIFIERS.items() for f, v in fs.items()}, F.concat_ws(":", page, field), 0.0)
    score = score + F.when((field == "email") & (classification == "business_role"), 0.05).when((field == "email") & (classification == "freemail") & ~src.isin("mailto", "json-ld"), -0.20).otherwise(0.0)
    score = score + F.when((field == "linkedin") & matches(value, r"linkedin\.com/(?:company|school)/"), 0.15).when((field == "linkedin") & matches(value, "/in/"), -0.10).otherwise(0.0)
    return F.when(value.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), round3(score))))


SOCIAL = {"linkedin": "linkedin", "twitter_x": "twitter", "facebook": "facebook", "instagram": "instagram", "youtube": "youtube", "github": "github"}
URLS = ("booking_url", "ordering_url", "menu_url", "website")


def normalized(rows: DataFrame) -> DataFrame:
    """Rows with `value` normalized by its field's rule (null where it fails the rule) and the e-mail's `classification`.

    The steps are columns of successive selects, each computed once for the rows of its field only.
    """
    field, v = F.col("field"), F.col("_v")
    url = field.isin(*SOCIAL, *URLS)
    text = ~(url | field.isin("email", "phone"))
    r = rows.withColumn("_v", js_trim(F.col("value")))
    r = r.withColumn("_n", F.when(field == "email", normalize_email(v)).when(field == "phone", normalize_phone(v)).when(url, normalize_url(v)).when(text, normalize_text(v)))
    n = F.col("_n")
    r = r.withColumn("_e", F.when(field == "email", evaluate_email(n, F.col("site"))))
    ok = F.when(field == "email", F.col("_e.is_valid")).when(field == "phone", is_phone(n)).when(field == "company_name", is_company_name(n))
    for f, p in SOCIAL.items():
        ok = ok.when(field == f, is_social_profile(n, p))
    return r.withColumn("_ok", ok.otherwise(n != "")).select(*[c for c in rows.columns if c not in ("value", "classification")], F.when(F.col("_ok"), n).alias("value"), F.when(field == "email", F.col("_e.classification")).alias("classification"))


def validate(rows: DataFrame) -> DataFrame:
    """Evidence (site, field, value, source, evidence_type, page_url, page_type, seq) normalized, scored, weak rows out.

    The normalized rows are written once: a filter on them would otherwise repeat their whole normalization in the plan.
    """
    v = cut(normalized(rows)).where("value IS NOT NULL")
    v = v.withColumn("confidence", initial_confidence(*[F.col(c) for c in ("field", "value", "source", "evidence_type", "page_type", "classification")]))
    return v.where(F.col("confidence") >= THRESHOLD)


def corroborate(rows: DataFrame) -> DataFrame:
    """Adds pages, sources and the bonus of equal values on further pages and from further sources.

    Counts come from an aggregation by (site, field, value) that combines before its shuffle, joined back on the key.
    The rows are written once before, so that their validation is not computed for both sides.
    """
    rows = cut(rows.withColumn("key", F.lower(js_trim(F.col("value")))))
    n = rows.groupBy("site", "field", "key").agg(F.count_distinct("page_url").alias("pages"), F.count_distinct("source").alias("sources"))
    bonus = F.least(F.lit(0.06), F.greatest(F.lit(0.0), (F.col("pages") - 1) * 0.03)) + F.when(F.col("sources") >= 2, 0.04).otherwise(0.0)
    out = rows.join(n, ["site", "field", "key"]).drop("key")
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), round3(F.col("confidence") + bonus))))


def rank(rows: DataFrame) -> DataFrame:
    """Rows from THRESHOLD up with their place in (site, field): confidence, page, source, pages, then the value."""
    w = Window.partitionBy("site", "field").orderBy(
        F.desc("confidence"), F.desc(lookup(PAGE_RANK, F.upper(F.coalesce("page_type", F.lit("GENERIC"))), 1)), F.desc(lookup(SOURCE_RANK, F.lower(F.coalesce("source", F.lit("unknown"))), 0)), F.desc("pages"), F.lower("value"), F.col("value"), F.col("seq")
    )
    return rows.where((F.col("confidence") >= THRESHOLD) & F.col("value").isNotNull()).withColumn("place", F.row_number().over(w))


def winners(rows: DataFrame) -> DataFrame:
    return rank(corroborate(rows)).where("place = 1")


def pivot(best: DataFrame, fields=FIELDS) -> DataFrame:
    """One row a site from its winners: a column for each field."""
    return best.groupBy("site").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
