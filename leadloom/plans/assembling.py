"""Queries of whole leads: a site's evidence and people to one lead, listings enriched by such leads, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, dedup, evidence, leads
from ..sources.storage import cut
from . import catalogue, duck
from .inputs import rows
from .merging import fold_sql
from .registry import query

C = F.col
SITES = "SELECT DISTINCT site, 'https://www.acme.test/' AS url, CAST(1 + site % 3 AS INT) AS pages_scanned, 5 AS pages_budget, site % 4 = 0 AS stopped_early, CAST(NULL AS STRING) AS stop_reason FROM ({EVIDENCE}) e"


def web_leads(spark: SparkSession, d: str) -> DataFrame:
    """The lead of each site, written once: what is joined to it has not the whole plan of the sites' evidence below it."""
    people = leads.dedup_people(rows(spark, d, "PEOPLE"))
    return cut(assembly.assemble(evidence.corroborate(catalogue._evidence(spark, d)), people, rows(spark, d, SITES)))


_nb = lambda x: f"coalesce(trim({x}) <> '', false)"
_is = lambda x: f"coalesce({x} <> '', false)"
_num = lambda x: f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
_first = lambda c: f"arg_min({c}, seq) FILTER (coalesce({c}, '') <> '') AS {c}"
_BONUS = catalogue._map(leads.ROLE_BONUS, "role", 0)
#: CTEs up to lead: one row a site.
LEADS_SQL = f"""
WITH ranked AS (SELECT * FROM ({catalogue._PLACE}) x),
crew0 AS (SELECT site, min(seq) AS seq, arg_min(name, seq) AS name, {_first('title')}, {_first('email')}, {_first('phone')}, {_first('linkedin_url')}, max(coalesce(confidence, 0.75)) AS confidence FROM ({{PEOPLE}}) p WHERE {duck.person('name')} GROUP BY site, lower(name)),
crew AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {duck.seniority('title')} DESC, {_nb('email')} DESC, {_nb('linkedin_url')} DESC, confidence DESC, seq) AS place FROM crew0),
people AS (SELECT site, count(*) AS n, bool_or({_nb('title')}) AS titled, arg_min({{'name': name, 'title': title, 'email': email, 'linkedin': linkedin_url}}, place) AS top, string_agg(name || CASE WHEN coalesce(title, '') <> '' THEN ' (' || title || ')' ELSE '' END, ', ' ORDER BY place) AS names, string_agg(name, ', ' ORDER BY place) AS people FROM crew GROUP BY site),
won AS (SELECT site, max(value) FILTER (field = 'company_name') AS company_name, max(confidence) FILTER (field = 'company_name') AS name_confidence, max(value) FILTER (field = 'linkedin') AS linkedin, max(value) FILTER (field = 'city') AS city, max(confidence) FILTER (field = 'email') AS mail_confidence, max(page_url) FILTER (field = 'email') AS mail_page, max(confidence) FILTER (field = 'phone') AS tel_confidence, max(confidence) FILTER (field = 'city') AS city_confidence FROM ranked WHERE place = 1 GROUP BY site),
mail0 AS (SELECT site, value AS email, max(confidence) AS confidence, min(cls) AS type, {duck.email_role("split_part(value, '@', 1)")} AS role, min(CASE WHEN place = 1 THEN -1 ELSE seq END) AS turn FROM ranked r WHERE field = 'email' AND NOT EXISTS (SELECT 1 FROM crew c WHERE c.site = r.site AND lower(trim(c.email)) = r.value) GROUP BY site, value),
mail AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(confidence + {_BONUS}, 6) DESC, turn) AS nth FROM mail0),
tel0 AS (SELECT site, {_num('value')} AS digits, max(confidence) AS confidence, min(CASE WHEN place = 1 THEN -1 ELSE seq END) AS turn, arg_min(value, [-confidence, CASE WHEN place = 1 THEN -1 ELSE seq END]) AS phone FROM ranked r WHERE field = 'phone' AND NOT EXISTS (SELECT 1 FROM crew c WHERE c.site = r.site AND {_num('c.phone')} = {_num('r.value')}) GROUP BY site, {_num('value')}),
tel AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY round(confidence, 6) DESC, turn) AS nth FROM tel0),
mails AS (SELECT site, arg_min(email, nth) AS email, arg_min(type, nth) AS email_status, list(email ORDER BY nth) AS mails FROM mail GROUP BY site),
tels AS (SELECT site, arg_min(phone, nth) AS phone, list(phone ORDER BY nth) AS tels FROM tel GROUP BY site),
joined AS (SELECT s.site, w.company_name, w.name_confidence, w.mail_confidence, w.mail_page, w.tel_confidence, w.city_confidence, w.city, {duck.sub("split_part(split_part(w.linkedin, '#', 1), '?', 1)", '/+$')} AS linkedin, m.email, m.email_status, t.phone, coalesce(m.mails, []) AS mails, coalesce(t.tels, []) AS tels, 'https://www.acme.test' AS website, CASE WHEN s.pages_scanned > 1 THEN 'website-crawler' ELSE 'website-single-page' END AS extraction_mode,
    CASE WHEN s.stopped_early THEN 'all_requested_fields_satisfied' ELSE 'completed' END AS stop_reason, coalesce(p.n, 0) AS people_count, coalesce(p.titled, false) AS titled, p.names, p.people, nullif(p.top.name, '') AS decision_maker_name, nullif(p.top.title, '') AS decision_maker_title, nullif(p.top.email, '') AS decision_maker_email, nullif(p.top.linkedin, '') AS decision_maker_linkedin
    FROM ({SITES}) s LEFT JOIN won w ON w.site = s.site LEFT JOIN mails m ON m.site = s.site LEFT JOIN tels t ON t.site = s.site LEFT JOIN people p ON p.site = s.site),
lead AS (SELECT *, array_to_string(mails[2:], ', ') AS additional_emails, array_to_string(tels[2:], ', ') AS additional_phones, nullif(concat_ws(' | ', CASE WHEN len(mails) > 1 THEN 'Additional Emails: ' || array_to_string(mails[2:], ', ') END, CASE WHEN len(tels) > 1 THEN 'Additional Phones: ' || array_to_string(tels[2:], ', ') END, 'Leadership / Team: ' || names), '') AS business_type,
    (CASE WHEN {_nb('company_name')} THEN 10 ELSE 0 END + CASE WHEN phone IS NULL THEN 0 ELSE 15 END + CASE WHEN email IS NULL THEN 0 ELSE 20 END + CASE WHEN {_nb('city')} THEN 4 ELSE 0 END + 10 + CASE WHEN {_nb('linkedin')} THEN 10 ELSE 0 END + CASE WHEN decision_maker_name IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN email_status = 'business_role' THEN 5 WHEN email IS NOT NULL THEN 3 ELSE 0 END)::INT AS lead_score FROM joined)"""
_LEAD = ("site", "company_name", "city", "email", "email_status", "phone", "people_count", "decision_maker_name", "decision_maker_title", "decision_maker_email", "decision_maker_linkedin", "website", "extraction_mode", "business_type", "lead_score", "quality_tier")
_TIER = "CASE WHEN lead_score >= 75 THEN 'HIGH' WHEN lead_score >= 45 THEN 'MEDIUM' ELSE 'LOW' END"
_text = lambda c: F.array_join(c, ", ")
query(
    "lead_assembly",
    lambda s, d: web_leads(s, d).select(*_LEAD, _text("additional_emails").alias("additional_emails"), _text("additional_phones").alias("additional_phones"), C("social")["linkedin"].alias("linkedin"), C("rankings")["company_name"]["confidence"].alias("name_confidence"), C("crawl_stats.stop_reason").alias("stop_reason"), F.size("emails").alias("n_emails")),
    f"{LEADS_SQL} SELECT {', '.join(c for c in _LEAD if c != 'quality_tier')}, {_TIER} AS quality_tier, additional_emails, additional_phones, linkedin, name_confidence, stop_reason, len(mails)::INT AS n_emails FROM lead",
)

_LISTINGS = "SELECT seq, seq % 220 AS site, company_name, phone, address, city, region, CAST(NULL AS STRING) AS country, postal_code, website, category, email, email_status, place_id FROM ({LEADS}) l"


def enriched(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(C("seq") % 3 == 0, F.create_map(F.lit("linkedin"), F.lit(" own "), F.lit("yelp"), F.lit("y"), F.lit("none"), F.lit(" "))).otherwise(F.lit(None).cast("map<string,string>"))
    return assembly.enrich(rows(spark, d, _LISTINGS).withColumn("social", own), web_leads(spark, d), "site")


def _enriched(s: SparkSession, d: str) -> DataFrame:
    of = lambda c, f="source": C("provenance")[c][f]
    return enriched(s, d).select(
        "seq", "company_name", "phone", "city", "website", "email", "email_status", "enrichment_status", "decision_maker_name", "lead_score", "quality_tier", of("company_name").alias("name_source"), of("phone").alias("phone_source"), of("phone", "confidence").alias("phone_confidence"), of("email").alias("email_source"),
        of("email", "confidence").alias("email_confidence"), of("email", "url").alias("email_url"), of("email_status").alias("status_source"), of("city").alias("city_source"), of("city", "confidence").alias("city_confidence"), of("people", "count").alias("people"), of("social").alias("social_source"), F.size("provenance").alias("n_sources"),
        F.when(C("enrichment_status") == "enriched", _text("additional_emails")).alias("additional_emails"), F.when(C("enrichment_status") == "enriched", _text("additional_phones")).alias("additional_phones"), F.array_join(F.array_sort(F.transform(F.map_entries("social"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("profiles"), C("score_breakdown.corroboration").alias("corroboration"),
    )


def _enriched_sql() -> str:
    m = lambda c: f"{_nb('l.' + c)}"
    fill = lambda c: f"(w.site IS NOT NULL AND NOT {m(c)} AND {_nb('w.' + c)})"
    out = lambda c: f"CASE WHEN {fill(c)} THEN w.{c} ELSE l.{c} END AS {c}"
    source = lambda c: f"CASE WHEN {fill(c)} THEN 'WEBSITE' WHEN coalesce(l.{c} <> '', false) THEN 'LISTING' END"
    filled = ("company_name", "phone", "city", "website", "email")
    listed = ("address", "region", "postal_code", "category", "place_id")
    on = "w.site IS NOT NULL"
    others = lambda xs, c, key: f"array_to_string(list_filter({xs}, lambda x: {key('x')} <> {key(c)}), ', ')"
    low = lambda x: f"lower(trim({x}))"
    own = "seq % 3 = 0"
    return f"""{LEADS_SQL},
j AS (SELECT l.seq, {', '.join(out(c) for c in filled)}, {', '.join(f'{source(c)} AS {c}_source' for c in filled)}, CASE WHEN {fill('email')} THEN coalesce(w.email_status, 'verified') ELSE l.email_status END AS email_status, CASE WHEN {fill('email')} THEN 'WEBSITE' WHEN coalesce(l.email_status <> '', false) THEN 'LISTING' END AS status_source,
    CASE WHEN {fill('phone')} THEN coalesce(w.tel_confidence, 0.85) END AS phone_confidence, CASE WHEN {fill('email')} THEN coalesce(w.mail_confidence, 0.9) END AS email_confidence, CASE WHEN {fill('email')} THEN coalesce(w.mail_page, w.website) END AS email_url, CASE WHEN {fill('city')} THEN coalesce(w.city_confidence, 0.8) END AS city_confidence,
    {on} AS found, w.decision_maker_name, w.mails, w.tels, w.linkedin AS web_linkedin, CASE WHEN {on} THEN w.people_count END AS crew, {' + '.join(f"CASE WHEN coalesce(l.{c} <> '', false) THEN 1 ELSE 0 END" for c in listed)} AS n_listed, l.address, l.region, l.postal_code
    FROM ({_LISTINGS}) l LEFT JOIN lead w ON w.site = l.site),
k AS (SELECT *, CASE WHEN found THEN nullif(concat_ws(',', CASE WHEN {_nb('web_linkedin')} THEN 'linkedin=' || web_linkedin WHEN {own} THEN 'linkedin=own' END, CASE WHEN {own} THEN 'yelp=y' END), '') END AS joined_profiles, greatest({', '.join(f"CASE WHEN {c}_source = 'WEBSITE' THEN 1 ELSE 0 END" for c in filled)}, CASE WHEN found AND (crew > 0 OR {own} OR {_nb('web_linkedin')}) THEN 1 ELSE 0 END) = 1 AS from_web,
    n_listed > 0 OR {' OR '.join(f"coalesce({c}_source = 'LISTING', false)" for c in filled)} AS from_list FROM j),
s AS (SELECT *, least(15, CASE WHEN from_web AND from_list THEN 10 ELSE 0 END + CASE WHEN coalesce(email_status IN ('business_role', 'verified', 'sales'), false) THEN 5 WHEN {_nb('email')} AND NOT (from_web AND from_list) THEN 3 ELSE 0 END)::INT AS corr FROM k),
z AS (SELECT *, CASE WHEN found THEN least(100, CASE WHEN {_nb('company_name')} THEN 10 ELSE 0 END + CASE WHEN {_nb('phone')} THEN 15 ELSE 0 END + CASE WHEN {_nb('email')} THEN 20 ELSE 0 END + CASE WHEN {_nb('address')} THEN 10 WHEN {_nb('city')} AND {_nb('postal_code')} THEN 7 WHEN {_nb('city')} OR {_nb('region')} THEN 4 ELSE 0 END + CASE WHEN {_nb('website')} THEN 10 ELSE 0 END + CASE WHEN joined_profiles IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN decision_maker_name IS NOT NULL THEN 15 ELSE 0 END + corr)::INT END AS lead_score FROM s)
SELECT seq, company_name, phone, city, website, email, email_status, CASE WHEN found THEN 'enriched' WHEN {_nb('website')} THEN 'failed' ELSE 'skipped_no_website' END AS enrichment_status, CASE WHEN found THEN decision_maker_name END AS decision_maker_name, lead_score, CASE WHEN found THEN {_TIER} END AS quality_tier, company_name_source AS name_source, phone_source, phone_confidence, email_source, email_confidence, email_url, status_source, city_source, city_confidence,
    CASE WHEN crew > 0 THEN crew::INT END AS people, CASE WHEN joined_profiles IS NOT NULL THEN 'WEBSITE' END AS social_source, (n_listed + {' + '.join(f"CASE WHEN {c}_source IS NULL THEN 0 ELSE 1 END" for c in filled)} + CASE WHEN status_source IS NULL THEN 0 ELSE 1 END + CASE WHEN crew > 0 THEN 1 ELSE 0 END + CASE WHEN joined_profiles IS NULL THEN 0 ELSE 1 END)::INT AS n_sources,
    CASE WHEN found THEN CASE WHEN {_nb('email')} THEN {others('mails', 'email', low)} ELSE '' END END AS additional_emails, CASE WHEN found THEN CASE WHEN {_nb('phone')} THEN {others('tels', 'phone', _num)} ELSE '' END END AS additional_phones, CASE WHEN found THEN coalesce(joined_profiles, '') WHEN {own} THEN 'linkedin= own ,none= ,yelp=y' ELSE '' END AS profiles, CASE WHEN found THEN corr END AS corroboration FROM z"""


query("website_enrichment", _enriched, _enriched_sql())


def batch(spark: SparkSession, d: str) -> DataFrame:
    """Listings to deduplicated leads: evidence and people of sites to their leads, listings enriched by them, duplicates
    merged and scored."""
    out = dedup.deduplicated(assembly.mergeable(enriched(spark, d)))
    return out.select("seq", "members", "company_name", "website", "phone", "email", "email_status", "enrichment_status", "city")


def _batch_sql() -> str:
    head = _enriched_sql().rpartition("\nSELECT seq, company_name")[0]
    more = "CASE WHEN z.found AND " + _nb("z.phone") + " THEN list_filter(z.tels, lambda x: " + _num("x") + " <> " + _num("z.phone") + ") END"
    mails = "CASE WHEN z.found AND " + _nb("z.email") + " THEN list_filter(z.mails, lambda x: lower(trim(x)) <> lower(trim(z.email))) END"
    status = "CASE WHEN found THEN 'enriched' WHEN " + _nb("z.website") + " THEN 'failed' ELSE 'skipped_no_website' END"
    given = f"CASE WHEN {_is('phone')} THEN phone WHEN i.seq <> kept THEN list_filter(more, lambda p: length({_num('p')}) >= 7)[1] END"
    first = f"CASE WHEN {_is('email')} AND (i.seq = kept OR {duck.email('email')} <> '') THEN email WHEN i.seq <> kept THEN list_filter(mails, lambda m: {duck.email('m')} <> '')[1] END"
    fold = fold_sql("SELECT * FROM item", "more").replace("WITH RECURSIVE ", "", 1).strip()
    head = head.replace("WITH ranked", "WITH RECURSIVE ranked", 1)
    return f"""{head},
item AS (SELECT z.seq, z.company_name, l.place_id, z.website, z.phone, z.email, z.email_status, z.city, {status} AS enrichment_status, {more} AS more, {mails} AS mails FROM z JOIN ({_LISTINGS}) l ON l.seq = z.seq),
{fold},
f AS (SELECT kept, count(*) AS members, arg_min(website, i.seq) FILTER ({_is('website')}) AS website, arg_min({given}, i.seq) FILTER (coalesce({given}, '') <> '') AS phone, arg_min({first}, i.seq) FILTER (coalesce({first}, '') <> '') AS email FROM item i JOIN goal g ON g.seq = i.seq GROUP BY kept)
SELECT i.seq, f.members, i.company_name, CASE WHEN f.members > 1 THEN f.website ELSE i.website END AS website, CASE WHEN f.members > 1 THEN f.phone ELSE i.phone END AS phone, CASE WHEN {_is('i.email')} OR f.members = 1 THEN i.email ELSE coalesce(f.email, i.email) END AS email, i.email_status, i.enrichment_status, i.city FROM item i JOIN f ON f.kept = i.seq"""


query("batch_pipeline_end_to_end", batch, _batch_sql())

query("enriched_switch", lambda s, d: leads.is_enriched(enriched(s, d).where("enrichment_status <> 'enriched'")), f"SELECT coalesce(bool_or(profiles <> ''), false) AS enriched FROM ({_enriched_sql()}) e WHERE enrichment_status <> 'enriched'")
