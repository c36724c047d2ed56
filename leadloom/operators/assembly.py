"""Whole leads: a site's evidence and people to one nested lead, and listings enriched by them.

The lead of a site is built by aggregations that combine before their shuffle: the winner of each field is the least of
ranked structs, contacts are reduced by address or digits before they are gathered, so that what comes together for a
site is its distinct contacts and people.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, nonblank, or_null, truthy
from ..functions.web import evaluate_email, normalize_domain, normalize_email, normalize_phone, normalize_social, normalize_url, seniority
from ..sources.storage import dealt
from .dedup import PLATFORMS, PRIMITIVES
from .evidence import FIELDS, PAGE_RANK, SOCIAL, SOURCE_RANK, THRESHOLD, lookup
from .leads import FILLED, ROLE_BONUS, digits, extras_text, rank_people, score, score_parts, tier

EMAILS = "array<struct<email:string,type:string,email_role:string,confidence:double,source_url:string,source_type:string>>"
PHONES = "array<struct<phone:string,confidence:double,source_url:string,source_type:string>>"
PEOPLE = "array<struct<name:string,title:string,email:string,phone:string,linkedin_url:string,profile_url:string,confidence:double,seniority:double>>"
PROVENANCE = "map<string,struct<source:string,confidence:double,url:string,count:int>>"
RANKINGS = "map<string,struct<confidence:double,url:string>>"
PARTS = ("company_name", "phone", "email", "address", "website", "social", "decision_maker", "corroboration")

# Fields whose listing value has a provenance, and the confidence of a website's value that has none.
LISTED = ("company_name", "phone", "website", "email", "email_status", "address", "city", "region", "country", "postal_code", "category", "business_type", "rating", "review_count", "opening_status", "price_range", "booking_url", "ordering_url", "menu_url", "place_id", "source_url", "source_query", "run_id")
DEFAULTS = {"company_name": 0.85, "phone": 0.85, "address": 0.80, "city": 0.80, "region": 0.80, "country": 0.80, "postal_code": 0.80, "website": 1.0, "category": 0.75, "booking_url": 0.85, "ordering_url": 0.85, "menu_url": 0.85, "email": 0.90}
RANKED = ("company_name", "phone", "address", "city", "region", "country", "postal_code", "email")  # those whose own confidence counts


def _winners(rows: DataFrame) -> DataFrame:
    """(site, w_<field>): for each field the first row by confidence, page, source, pages and value."""
    order = F.struct(
        (-F.col("confidence")).alias("a"), (-lookup(PAGE_RANK, F.upper(F.coalesce("page_type", F.lit("GENERIC"))), 1)).alias("b"), (-lookup(SOURCE_RANK, F.lower(F.coalesce("source", F.lit("unknown"))), 0)).alias("c"), (-F.col("pages")).alias("d"), F.lower("value").alias("e"), F.col("value").alias("f"), "seq",
        "value", "classification", "confidence", "page_url", "source",
    )
    good = rows.where((F.col("confidence") >= THRESHOLD) & F.col("value").isNotNull())
    return good.groupBy("site").agg(*[F.min(F.when(F.col("field") == f, order)).alias(f"w_{f}") for f in FIELDS])


def _gathered(rows: DataFrame, won: DataFrame, field: str, key: Column, bonus: Column, value: Column, name: str) -> DataFrame:
    """(site, name): a field's values, one for each key with its surest row, best first; equal ones as they came, the
    field's winner before all."""
    mine = rows.where((F.col("field") == field) & (F.col("confidence") >= THRESHOLD)).join(won.select("site", F.col(f"w_{field}.seq").alias("winner")), "site")
    mine = mine.withColumn("turn", F.when(F.col("seq") == F.col("winner"), F.lit(-(1 << 62))).otherwise(F.col("seq"))).withColumn("key", key)
    one = mine.groupBy("site", "key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "turn", value.alias("value"))).alias("best"), F.min("turn").alias("turn"))
    rank = F.struct((-F.round(F.col("best.value.confidence") + bonus, 6)).alias("rank"), "turn", F.col("best.value").alias("value"))
    return one.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["value"]).alias(name))


def assemble(rows: DataFrame, people: DataFrame, sites: DataFrame) -> DataFrame:
    """One lead a site (of `sites`: site, url, pages_scanned, pages_budget, stopped_early, stop_reason) from corroborated
    evidence and its people (site, seq, name, title, email, phone, linkedin_url, profile_url, confidence).

    Employees' addresses and phones are nobody else's: they are no company contacts. Contacts are ranked, the first is the
    lead's own and the rest are additional ones; `business_type` tells them in words; `rankings` has each field's
    confidence and page. A site without evidence or people is a lead with its address alone.
    """
    own = people.select("site", js_trim(F.lower("email")).alias("mail"), digits(F.coalesce("phone", F.lit(""))).alias("tel"))
    won = _winners(rows)
    root = sites.select("site", normalize_domain(F.col("url")).alias("root"))
    mails = rows.where("field = 'email'").withColumn("value", normalize_email(F.col("value"))).join(own.where(truthy(F.col("mail"))).select("site", F.col("mail").alias("value")).distinct(), ["site", "value"], "left_anti")
    mails = mails.join(root, "site").withColumn("judged", evaluate_email(F.col("value"), F.col("root"))).where("judged.is_valid")
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_BONUS.items() for x in kv]), F.col("best.value.email_role")), F.lit(0.0))
    mail = F.struct(F.col("value").alias("email"), F.coalesce("classification", "judged.classification").alias("type"), F.coalesce("judged.email_role", F.lit("general")).alias("email_role"), "confidence", F.col("page_url").alias("source_url"), F.col("source").alias("source_type"))
    mails = _gathered(mails, won, "email", F.col("value"), role, mail, "emails")
    tels = rows.where("field = 'phone'").withColumn("value", normalize_phone(F.col("value"))).withColumn("tel", digits(F.col("value"))).where("tel <> ''")
    tels = tels.join(own.where("tel <> ''").select("site", "tel").distinct(), ["site", "tel"], "left_anti")
    tel = F.struct(F.col("value").alias("phone"), "confidence", F.col("page_url").alias("source_url"), F.col("source").alias("source_type"))
    tels = _gathered(tels, won, "phone", F.col("tel"), F.lit(0.0), tel, "phones")
    person = F.struct("name", "title", "email", "phone", "linkedin_url", "profile_url", "confidence", "seniority")
    crew = rank_people(people).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", person.alias("p")))), lambda x: x["p"]).cast(PEOPLE).alias("people"))
    out = sites
    for t in (won, mails, tels, crew):
        out = out.join(t, "site", "left")
    value = lambda f: F.col(f"w_{f}.value")
    none = lambda kind: F.array().cast(kind)
    out = out.withColumns({"emails": F.coalesce(F.col("emails").cast(EMAILS), none(EMAILS)), "phones": F.coalesce(F.col("phones").cast(PHONES), none(PHONES)), "people": F.coalesce("people", none(PEOPLE))})
    first, top = lambda xs, f: F.get(xs, F.lit(0))[f], F.get("people", F.lit(0))
    rest = lambda xs, f: F.transform(F.filter(xs, lambda x, i: i > 0), lambda x: x[f])
    social = F.array(*[F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("key"), normalize_social(value(f)).alias("value"))) for f in SOCIAL])
    rankings = F.array(*[F.when(value(f).isNotNull(), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"w_{f}.confidence").alias("confidence"), F.col(f"w_{f}.page_url").alias("url")).alias("value"))) for f in FIELDS])
    entries = lambda a: F.map_from_entries(F.filter(a, lambda x: x.isNotNull()))
    names = F.transform("people", lambda p: F.concat(p["name"], F.when(truthy(p["title"]), F.concat(F.lit(" ("), p["title"], F.lit(")"))).otherwise("")))
    lead = out.select(
        "site", *[value(f).alias(f) for f in ("company_name", "address", "city", "region", "country", "postal_code", "booking_url", "ordering_url", "menu_url")], value("description").alias("category"), F.lit(None).cast("string").alias("description"),
        first("emails", "email").alias("email"), first("emails", "type").alias("email_status"), first("phones", "phone").alias("phone"), "emails", "phones", rest("emails", "email").alias("additional_emails"), rest("phones", "phone").alias("additional_phones"),
        normalize_url(F.col("url")).alias("website"), F.col("url").alias("source_url"), normalize_domain(F.col("url")).alias("source_query"), F.when(F.col("pages_scanned") > 1, "website-crawler").otherwise("website-single-page").alias("extraction_mode"),
        entries(social).alias("social"), "people", F.size("people").alias("people_count"), *[or_null(top[f]).alias(f"decision_maker_{c}") for c, f in (("name", "name"), ("title", "title"), ("email", "email"), ("linkedin", "linkedin_url"))],
        extras_text(rest("emails", "email"), rest("phones", "phone"), names).alias("business_type"), entries(rankings).cast(RANKINGS).alias("rankings"),
        F.struct("pages_scanned", "pages_budget", "stopped_early", F.coalesce("stop_reason", F.when(F.col("stopped_early"), F.lit("all_requested_fields_satisfied")).otherwise(F.lit("completed"))).alias("stop_reason")).alias("crawl_stats"),
    )
    return _scored(lead, F.lit(False), F.lit(False))


def _scored(lead: DataFrame, listed: Column, found: Column) -> DataFrame:
    """Adds lead_score, quality_tier and score_breakdown."""
    cols = {c: F.col(c) for c in ("company_name", "phone", "email", "address", "city", "region", "postal_code", "website", "decision_maker_name", "email_status")}
    cols |= {"has_social": F.exists(F.map_values("social"), nonblank), "n_people": F.size("people"), "has_titled": F.exists("people", lambda p: nonblank(p["name"]) & nonblank(p["title"])), "from_listing": listed, "from_website": found}
    cols["has_social"] = F.coalesce(cols["has_social"], F.lit(False))
    parts = score_parts(cols)
    return lead.withColumns({"lead_score": score(cols), "score_breakdown": F.struct(*[parts[p].cast("int").alias(p) for p in PARTS])}).withColumn("quality_tier", tier(F.col("lead_score")))


def enrich(listings: DataFrame, webs: DataFrame, key: str) -> DataFrame:
    """Listings, each with the lead of its website (same `key`, at most one a key, as assemble() makes it).

    A listing's value stays unless it is blank; the website's fills it, and alone gives people, the decision maker and
    further contacts; its profiles win over the listing's. `provenance` tells each field's source, score and tier are new,
    and enrichment_status is enriched, failed (a website without a lead) or skipped_no_website. Listings that are not
    enriched keep their people, contacts and score. Columns that listings lack are null.
    """
    kinds = {"social": "map<string,string>", "people": PEOPLE, "emails": EMAILS, "phones": PHONES, "additional_emails": "array<string>", "additional_phones": "array<string>", "people_count": "int", "lead_score": "int", "rating": "double", "review_count": "long", "score_breakdown": f"struct<{','.join(f'{p}:int' for p in PARTS)}>"}
    made = (*LISTED, "description", "social", "people", "people_count", "emails", "phones", "additional_emails", "additional_phones", *[f"decision_maker_{c}" for c in ("name", "title", "email", "linkedin")], "lead_score", "quality_tier", "score_breakdown")
    base = dealt(listings).withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in made if c not in listings.columns})
    taken = (*FILLED, "email", "email_status", "description", "social", "people", "emails", "phones", "rankings", *[f"decision_maker_{c}" for c in ("name", "title", "email", "linkedin")])
    j = base.join(webs.select(key, F.lit(True).alias("w"), *[F.col(c).alias(f"w_{c}") for c in taken]), key, "left").withColumn("w", F.coalesce("w", F.lit(False)))
    w, shown = F.col("w"), lambda c: truthy(F.col(c).cast("string"))
    fills = {c: w & ~nonblank(F.col(c)) & nonblank(F.col(f"w_{c}")) for c in (*FILLED, "email")}
    sure = lambda c: F.coalesce(F.try_element_at("w_rankings", F.lit(c))["confidence"], F.lit(DEFAULTS[c])) if c in RANKED else F.lit(DEFAULTS[c])
    note = lambda source, confidence=None, url=None, count=None: F.struct(F.lit(source).alias("source"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"), (F.lit(None) if url is None else url).cast("string").alias("url"), (F.lit(None) if count is None else count).cast("int").alias("count"))
    page = F.coalesce(F.try_element_at("w_rankings", F.lit("email"))["url"], F.col("w_website"))
    social = F.map_filter(F.map_zip_with(F.coalesce("social", F.create_map().cast("map<string,string>")), F.coalesce("w_social", F.create_map().cast("map<string,string>")), lambda k, a, b: js_trim(F.when(F.array_contains(F.map_keys(F.coalesce("w_social", F.create_map().cast("map<string,string>"))), k), b).otherwise(a))), lambda k, v: truthy(v))
    entry = lambda name, cond, what: F.when(cond, F.struct(F.lit(name).alias("key"), what.alias("value")))
    notes = []
    for c in LISTED:
        by = F.when(shown(c), note("LISTING"))
        if c in fills:
            by = F.when(fills[c], note("WEBSITE", sure(c), page if c == "email" else None)).otherwise(by)
        elif c == "email_status":
            by = F.when(fills["email"], note("WEBSITE")).otherwise(by)
        notes.append(entry(c, by.isNotNull(), by))
    crew = F.coalesce("w_people", F.array().cast(PEOPLE))
    described = w & nonblank(F.col("w_description"))
    notes += [entry("social", w & (F.size(social) > 0), note("WEBSITE")), entry("people", w & (F.size(crew) > 0), note("WEBSITE", count=F.size(crew))), entry("description", described, note("WEBSITE"))]
    top = F.get(crew, F.lit(0))
    chief = {f"decision_maker_{c}": F.when(w, F.when(top.isNotNull(), or_null(top[f])).otherwise(or_null(F.col(f"w_decision_maker_{c}")))).otherwise(F.col(f"decision_maker_{c}")) for c, f in (("name", "name"), ("title", "title"), ("email", "email"), ("linkedin", "linkedin_url"))}
    values = {c: F.when(f, F.col(f"w_{c}")).otherwise(F.col(c)) for c, f in fills.items()}
    values["email_status"] = F.when(fills["email"], F.coalesce(or_null(F.col("w_email_status")), F.lit("verified"))).otherwise(F.col("email_status"))
    out = j.withColumns({**values, **chief, "provenance": F.map_from_entries(F.filter(F.array(*notes), lambda x: x.isNotNull())).cast(PROVENANCE), "social": F.when(w, social).otherwise(F.col("social")), "people": F.when(w, crew).otherwise(F.col("people").cast(PEOPLE)), "description": F.when(described, F.col("w_description")).otherwise(F.col("description"))})
    out = out.withColumn("people_count", F.when(w, F.size("people")).otherwise(F.col("people_count")))
    mail, tel = js_trim(F.lower("email")), digits(F.col("phone"))
    others = {"email": F.filter(F.coalesce("w_emails", F.array().cast(EMAILS)), lambda x: truthy(x["email"]) & (js_trim(F.lower(x["email"])) != mail)), "phone": F.filter(F.coalesce("w_phones", F.array().cast(PHONES)), lambda x: truthy(x["phone"]) & (digits(x["phone"]) != tel))}
    lead = {"email": F.struct("email", F.coalesce(or_null(F.col("email_status")), F.lit("verified")).alias("type"), F.lit(None).cast("string").alias("email_role"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("source_type")), "phone": F.struct("phone", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("source_url"), F.lit("primary").alias("source_type"))}
    for c, kind in (("email", EMAILS), ("phone", PHONES)):
        has = nonblank(F.col(c))
        every = F.when(has, F.concat(F.array(lead[c]).cast(kind), others[c])).otherwise(F.array().cast(kind))
        more = F.when(has, others[c][c]).otherwise(F.array().cast("array<string>"))
        out = out.withColumns({f"{c}s": F.when(w, every).otherwise(F.col(f"{c}s").cast(kind)), f"additional_{c}s": F.when(w, more).otherwise(F.col(f"additional_{c}s"))})
    old = {c: F.col(c) for c in ("lead_score", "quality_tier", "score_breakdown")}
    from_ = lambda source: F.exists(F.map_values("provenance"), lambda p: p["source"] == source)
    new = _scored(out.withColumns({f"old_{c}": x for c, x in old.items()}).withColumns({c: F.coalesce(F.col(c), F.array().cast(k)) if c == "people" else F.coalesce(F.col(c), F.create_map().cast(k)) for c, k in (("people", PEOPLE), ("social", "map<string,string>"))}), from_("LISTING"), from_("WEBSITE"))
    new = new.withColumns({c: F.when(w, F.col(c)).otherwise(F.col(f"old_{c}")) for c in old})
    status = F.when(w, "enriched").when(nonblank(F.col("website")), "failed").otherwise("skipped_no_website")
    return new.withColumn("enrichment_status", status).drop("w", *[f"w_{c}" for c in taken], *[f"old_{c}" for c in old])


def mergeable(leads: DataFrame) -> DataFrame:
    """Enriched leads in the form in which duplicates are merged: profiles as columns, sources as flags."""
    person = lambda p: F.struct(*[p[f].alias(f) for f in ("name", "title", "email", "phone", "linkedin_url", "profile_url", "confidence")])
    by = lambda source: F.exists(F.map_values("provenance"), lambda p: p["source"] == source)
    absent = {c: F.lit(None).cast("string") for c in PRIMITIVES if c not in leads.columns}
    profiles = {p: F.try_element_at("social", F.lit("twitter_x" if p == "twitter" else p)) for p in PLATFORMS}
    flags = {"has_social": F.coalesce(F.exists(F.map_values("social"), nonblank), F.lit(False)), "from_listing": by("LISTING"), "from_website": by("WEBSITE")}
    return leads.withColumns({**absent, **profiles, **flags, "people": F.transform("people", person)})
