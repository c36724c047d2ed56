"""Leads: people, contact roll-ups, scores, tiers, merging of listings with website leads, metrics, exports' filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import js_trim, nonblank, truthy
from ..functions.web import email_role, is_person_name, is_phone, normalize_email, normalize_phone, seniority

ROLE_BONUS = {"sales": 0.15, "general": 0.08, "support": 0.02, "marketing": -0.02, "careers": -0.10}
FILLED = ("company_name", "phone", "address", "city", "region", "country", "postal_code", "website", "category", "booking_url", "ordering_url", "menu_url")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


# people ------------------------------------------------------------------------------------------------------------


def dedup_people(people: DataFrame) -> DataFrame:
    """One row for each (site, lower-case name) of (site, seq, name, title, profile_url, linkedin_url, email, phone, confidence):
    the first values that are not empty, the highest confidence. Rows whose name can't be a person's are out."""
    first = lambda c: F.min_by(F.col(c), F.when(truthy(F.col(c)), F.col("seq"))).alias(c)
    good = people.where(is_person_name(F.col("name"))).withColumn("key", F.lower("name"))
    return good.groupBy("site", "key").agg(F.min("seq").alias("seq"), F.min_by("name", "seq").alias("name"), *[first(c) for c in ("title", "profile_url", "linkedin_url", "email", "phone")], F.max(F.coalesce("confidence", F.lit(0.75))).alias("confidence"))


def rank_people(people: DataFrame) -> DataFrame:
    """Adds seniority and place in the site: seniority, an e-mail, a LinkedIn address, confidence, then order."""
    w = Window.partitionBy("site").orderBy(F.desc("seniority"), F.desc(nonblank(F.col("email"))), F.desc(nonblank(F.col("linkedin_url"))), F.desc(F.coalesce("confidence", F.lit(0.0))), "seq")
    return people.withColumn("seniority", seniority(F.col("title"))).withColumn("place", F.row_number().over(w))


def decision_makers(people: DataFrame) -> DataFrame:
    return rank_people(people).where("place = 1")


# contacts ----------------------------------------------------------------------------------------------------------


def roll_up_emails(evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Company e-mails of a site, best first: (site, email, role, confidence, place). Employees' addresses are out."""
    own = people.where(truthy(F.col("email"))).select("site", F.lower(js_trim(F.col("email"))).alias("email")).distinct()
    mail = evidence.where((F.col("field") == "email") & (F.col("confidence") >= 0.45)).select("site", normalize_email(F.col("value")).alias("email"), "confidence", "seq")
    best = mail.join(own, ["site", "email"], "left_anti").groupBy("site", "email").agg(F.max("confidence").alias("confidence"), F.min("seq").alias("seq"))
    best = best.withColumn("role", email_role(F.substring_index("email", "@", 1)))
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_BONUS.items() for x in kv]), F.col("role")), F.lit(0.0))
    w = Window.partitionBy("site").orderBy(F.desc(F.round(F.col("confidence") + bonus, 6)), "seq")
    return best.withColumn("place", F.row_number().over(w))


def roll_up_phones(evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Company phones by their digits, best first: (site, digits, phone, confidence, place). Employees' phones are out."""
    own = people.where(truthy(F.col("phone"))).select("site", digits(F.col("phone")).alias("digits")).distinct()
    tel = evidence.where((F.col("field") == "phone") & (F.col("confidence") >= 0.45)).withColumn("phone", normalize_phone(F.col("value"))).where(is_phone(F.col("phone"))).withColumn("digits", digits(F.col("phone")))
    best = tel.join(own, ["site", "digits"], "left_anti").groupBy("site", "digits").agg(F.max("confidence").alias("confidence"), F.max_by("phone", F.struct("confidence", -F.col("seq"))).alias("phone"), F.min("seq").alias("seq"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("confidence"), "seq")))


def extras_text(emails: Column, phones: Column, people: Column) -> Column:
    """Text of further contacts and people, parts joined by " | "; null if there are none."""
    part = lambda label, xs: F.when(F.size(xs) > 0, F.concat(F.lit(label), F.array_join(xs, ", ")))
    text = F.concat_ws(" | ", part("Additional Emails: ", emails), part("Additional Phones: ", phones), part("Leadership / Team: ", people))
    return F.nullif(text, F.lit(""))


# score -------------------------------------------------------------------------------------------------------------


def score_parts(c: dict[str, Column]) -> dict[str, Column]:
    """Points of a lead's parts. c: company_name, phone, email, address, city, region, postal_code, website, decision_maker_name,
    email_status, and has_social, n_people, has_titled, from_listing, from_website."""
    ok = {k: nonblank(c[k]) for k in ("company_name", "phone", "email", "address", "city", "region", "postal_code", "website", "decision_maker_name")}
    pts = lambda cond, n: F.when(cond, F.lit(n))
    both = F.when(c["from_listing"] & c["from_website"], 10).otherwise(0)
    sure = F.coalesce(c["email_status"].isin("business_role", "verified", "sales"), F.lit(False))
    return {
        "company_name": pts(ok["company_name"], 10).otherwise(0),
        "phone": pts(ok["phone"], 15).otherwise(0),
        "email": pts(ok["email"], 20).otherwise(0),
        "address": pts(ok["address"], 10).when(ok["city"] & ok["postal_code"], 7).when(ok["city"] | ok["region"], 4).otherwise(0),
        "website": pts(ok["website"], 10).otherwise(0),
        "social": pts(c["has_social"], 10).otherwise(0),
        "decision_maker": pts(ok["decision_maker_name"], 15).when(c["n_people"] > 0, F.when(c["has_titled"], 12).otherwise(8)).otherwise(0),
        "corroboration": F.least(F.lit(15), both + F.when(sure, 5).when(ok["email"] & (both == 0), 3).otherwise(0)),
    }


def score(c: dict[str, Column]) -> Column:
    total = None
    for p in score_parts(c).values():
        total = p if total is None else total + p
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def tier(s: Column) -> Column:
    return F.when(s >= 75, F.lit("HIGH")).when(s >= 45, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


# merge -------------------------------------------------------------------------------------------------------------


def merge(listings: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """Listings left-joined with website leads on `key`: listing values win unless blank, website values fill.

    Adds, for each filled field, <field>_source, and enrichment_status: enriched, failed (a website without a lead) or
    skipped_no_website. Website columns: the FILLED ones, email and email_status.
    """
    w = sites.select(key, F.lit(True).alias("found"), *[F.col(c).alias(f"w_{c}") for c in (*FILLED, "email", "email_status")])
    j = listings.join(w, key, "left")
    out = j
    for c in (*FILLED, "email"):
        has, fill = nonblank(F.col(c)), nonblank(F.col(f"w_{c}"))
        out = out.withColumn(f"{c}_source", F.when(~has & fill, F.lit("WEBSITE")).when(truthy(F.col(c)), F.lit("LISTING")))
        if c == "email":
            out = out.withColumn("email_status", F.when(~has & fill, F.coalesce(F.nullif("w_email_status", F.lit("")), F.lit("verified"))).otherwise(F.col("email_status")))
        out = out.withColumn(c, F.when(~has & fill, F.col(f"w_{c}")).otherwise(F.col(c)))
    had = out.withColumn("enrichment_status", F.when(F.col("found"), F.lit("enriched")).when(nonblank(F.col("website")), F.lit("failed")).otherwise(F.lit("skipped_no_website")))
    return had.drop("found", *[f"w_{c}" for c in (*FILLED, "email", "email_status")])


def overlay(cards: DataFrame, details: DataFrame, on: list[str], columns: list[str], keep_nulls: bool = True) -> DataFrame:
    """Cards with their details' values over them. keep_nulls: a detail's null erases the card's value."""
    d = details.select(*on, F.lit(True).alias("found"), *[F.col(c).alias(f"d_{c}") for c in columns])
    j = cards.join(d, on, "left")
    pick = lambda c: F.when(F.col("found"), F.col(f"d_{c}") if keep_nulls else F.coalesce(f"d_{c}", c)).otherwise(F.col(c)).alias(c)
    return j.select(*[pick(c) if c in columns else F.col(c) for c in cards.columns])


def batch_metrics(leads: DataFrame) -> DataFrame:
    """One row: enriched, skipped, failed, with_email, with_decision_maker, mean_score over scored leads (rounded)."""
    n = lambda cond: F.count_if(cond)
    return leads.agg(n(F.col("enrichment_status") == "enriched").alias("enriched"), n(F.col("enrichment_status") == "skipped_no_website").alias("skipped"), n(F.col("enrichment_status") == "failed").alias("failed"), n(nonblank(F.col("email"))).alias("with_email"), n(nonblank(F.col("decision_maker_name"))).alias("with_decision_maker"), F.floor(F.avg("lead_score") + 0.5).cast("long").alias("mean_score"))


def valid_for_export(company: Column, website: Column, email: Column, phone: Column) -> Column:
    return nonblank(company) | nonblank(website) | nonblank(email) | nonblank(phone)


def exportable(leads: DataFrame, run_id: str, query: str, limit: int) -> DataFrame:
    """Finished leads of a run and query in their order, the first `limit` (1 to 50, 10 if not given)."""
    from ..functions.text import normalize_query

    limit = min(max(int(limit or 10), 1), 50)
    return leads.where((F.col("run_id") == run_id) & (normalize_query(F.col("source_query")) == normalize_query(F.lit(query))) & F.col("status").isin("complete", "READY")).orderBy("idx").limit(limit)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def find_listing(listings: DataFrame, asked: DataFrame) -> DataFrame:
    """The first of the listings (pos, place_id, source_url) for each asked (id, pid, url): by place id (rank 1), else by url
    (rank 2). Listings are reduced to the first of each key before they are joined, so a common one multiplies nothing."""
    first = lambda c: listings.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.min("pos").alias(f"_pos_{c}"))
    j = asked.join(first("place_id"), F.col("pid") == F.col("_place_id"), "left").join(first("source_url"), F.col("url") == F.col("_source_url"), "left")
    place, url = F.col("_pos_place_id"), F.col("_pos_source_url")
    return j.where(place.isNotNull() | url.isNotNull()).select("id", F.coalesce(place, url).alias("pos"), F.when(place.isNotNull(), 1).otherwise(2).alias("rank"))


def is_enriched(leads: DataFrame) -> DataFrame:
    """One row: whether any lead is enriched, has people, further e-mails or profiles; false without leads."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    any_ = F.coalesce(F.col("enrichment_status") == "enriched", F.lit(False)) | some("people") | some("additional_emails") | some("social")
    return leads.agg(F.coalesce(F.bool_or(any_), F.lit(False)).alias("enriched"))
