"""Queries of duplicate leads: the greedy fold, the merge of duplicates, and their SQL, which folds lead by lead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from . import duck
from .inputs import rows
from .registry import query

C = F.col

_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(company_name, '')), '[^a-z0-9[:space:]]', ' ', 'g'), '[[:space:]]+'), lambda w: w <> '' AND NOT {duck.within('w', dedup.NAME_STOP)})"
_NUM = lambda x: f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"
_IS = lambda x: f"coalesce({x} <> '', false)"


def fold_sql(source: str, more: str = "NULL::VARCHAR[]") -> str:
    """CTEs up to goal(seq, kept): leads are folded one by one into a list of those kept so far."""
    alike = "CASE WHEN len(x.words) = 0 OR len(l.words) = 0 THEN false WHEN least(len(x.words), len(l.words)) >= 2 AND (list_has_all(x.words, l.words) OR list_has_all(l.words, x.words)) THEN true ELSE len(list_intersect(x.words, l.words)) >= 0.75::DOUBLE * len(list_distinct(list_concat(x.words, l.words))) END"
    same = f"CASE WHEN x.pid <> '' AND l.pid <> '' THEN x.pid = l.pid WHEN x.domain = '' OR x.domain <> l.domain THEN false WHEN length(x.digits) >= 7 AND length(l.digits) >= 7 THEN right(x.digits, 7) = right(l.digits, 7) ELSE {alike} END"
    given = f"CASE WHEN {_IS('phone')} THEN phone ELSE list_filter({more}, lambda p: length({_NUM('p')}) >= 7)[1] END"
    return f"""
WITH RECURSIVE lead_row AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, {_TOKENS} AS words, {_IS('website')} AS site, {duck.domain('website')} AS domain, {_IS('place_id')} AS place, lower(trim(coalesce(place_id, ''))) AS pid,
    {_IS('phone')} AS phone, {_NUM('phone')} AS digits, {given} IS NOT NULL AS gives, {_NUM(given)} AS given FROM ({source}) src),
fold AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS kept, []::STRUCT(k BIGINT, words VARCHAR[], site BOOLEAN, domain VARCHAR, place BOOLEAN, pid VARCHAR, phone BOOLEAN, digits VARCHAR)[] AS s
  UNION ALL
  SELECT i, seq, coalesce(m, seq), CASE WHEN m IS NULL THEN list_append(s, {{'k': seq, 'words': words, 'site': site, 'domain': domain, 'place': place, 'pid': pid, 'phone': phone, 'digits': digits}})
    ELSE list_transform(s, lambda x: CASE WHEN x.k <> m THEN x ELSE {{'k': x.k, 'words': x.words, 'site': x.site OR site, 'domain': CASE WHEN x.site THEN x.domain ELSE domain END, 'place': x.place OR place, 'pid': CASE WHEN x.place THEN x.pid ELSE pid END, 'phone': x.phone OR gives, 'digits': CASE WHEN x.phone THEN x.digits ELSE given END}} END) END
  FROM (SELECT l.*, f.s, list_filter(list_filter(f.s, lambda x: (x.pid <> '' AND x.pid = l.pid) OR (x.domain <> '' AND x.domain = l.domain)), lambda x: {same})[1].k AS m FROM fold f JOIN lead_row l ON l.i = f.i + 1) z),
goal AS (SELECT seq, kept FROM fold WHERE i > 0)"""


def leads_to_merge(spark: SparkSession, d: str) -> DataFrame:
    """RICH_LEADS with their lists, and their people as arrays in order."""
    people = rows(spark, d, "LEAD_PEOPLE").groupBy("seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("name", "title", "email", "phone", "linkedin_url", "profile_url", "confidence").alias("p")))), lambda x: x["p"]).alias("people"))
    lists = {"additional_emails": F.split("more_emails", ";"), "additional_phones": F.split("more_phones", ";")}
    return rows(spark, d, "RICH_LEADS").withColumns(lists).drop("more_emails", "more_phones").join(people, "seq", "left")


SHOWN = ("seq", "members", "company_name", *dedup.PRIMITIVES, *dedup.PLATFORMS, "email", "people_count", "decision_maker_name", "decision_maker_title", "decision_maker_email", "decision_maker_linkedin", "lead_score", "quality_tier")


def shown(df: DataFrame) -> DataFrame:
    """Merged leads with their lists as texts."""
    person = F.transform("people", lambda p: F.concat_ws("|", F.coalesce(p["name"], F.lit("")), F.coalesce(p["title"], F.lit("")), F.coalesce(p["email"], F.lit("")), F.coalesce(p["linkedin_url"], F.lit(""))))
    return df.select(*SHOWN, F.array_join("additional_emails", "; ").alias("additional_emails"), F.array_join("additional_phones", "; ").alias("additional_phones"), F.array_join(person, "; ").alias("people"))


def merge_sql() -> str:
    """The merge from goal(seq, kept): firsts by arg_min, unions by the first row of each key."""
    first = lambda c: f"arg_min({c}, j.seq) FILTER (coalesce({c}::VARCHAR, '') <> '') AS {c}"
    given = f"CASE WHEN {_IS('phone')} THEN phone WHEN j.seq <> kept THEN list_filter(phones, lambda p: length({_NUM('p')}) >= 7)[1] END"
    out = lambda c: f"CASE WHEN f.members > 1 THEN f.{c} ELSE l.{c} END AS {c}"
    scored = "lead_score, quality_tier"
    nb = lambda x: f"coalesce(trim({x}) <> '', false)"
    points = " + ".join((
        f"CASE WHEN {nb('company_name')} THEN 10 ELSE 0 END", f"CASE WHEN {nb('phone')} THEN 15 ELSE 0 END", f"CASE WHEN {nb('email')} THEN 20 ELSE 0 END", f"CASE WHEN {nb('address')} THEN 10 WHEN {nb('city')} AND {nb('postal_code')} THEN 7 WHEN {nb('city')} OR {nb('region')} THEN 4 ELSE 0 END",
        f"CASE WHEN {nb('website')} THEN 10 ELSE 0 END", "CASE WHEN has_social THEN 10 ELSE 0 END", f"CASE WHEN {nb('decision_maker_name')} THEN 15 WHEN people_count > 0 THEN CASE WHEN titled THEN 12 ELSE 8 END ELSE 0 END",
        f"least(15, CASE WHEN from_listing AND from_website THEN 10 ELSE 0 END + CASE WHEN coalesce(email_status IN ('business_role', 'verified', 'sales'), false) THEN 5 WHEN {nb('email')} AND NOT (from_listing AND from_website) THEN 3 ELSE 0 END)",
    ))
    text = lambda xs: f"array_to_string({xs}, '; ')"
    return f"""{fold_sql('{RICH_LEADS}', "string_split(more_phones, ';')")},
l AS (SELECT *, string_split(more_emails, ';') AS mails, string_split(more_phones, ';') AS phones FROM ({{RICH_LEADS}}) r),
j AS (SELECT l.*, g.kept FROM l JOIN goal g ON g.seq = l.seq),
f AS (SELECT kept, count(*) AS members, min(CASE WHEN j.seq <> kept THEN j.seq END) AS began, {', '.join(first(c) for c in (*dedup.PRIMITIVES, *dedup.PLATFORMS) if c != 'phone')}, arg_min({given}, j.seq) FILTER (coalesce({given}, '') <> '') AS phone FROM j GROUP BY kept),
mail AS (SELECT kept, key, min([seq, pos]) AS spot, arg_min(raw, [seq, pos]) AS raw FROM (SELECT kept, seq, pos, raw, {duck.email('raw')} AS key FROM (SELECT kept, seq, unnest(list_concat([email], coalesce(mails, []))) AS raw, unnest(range(1 + len(coalesce(mails, [])))) AS pos FROM j WHERE seq <> kept) u WHERE {_IS('raw')}) v WHERE key <> '' GROUP BY kept, key),
mail2 AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY spot) AS nth FROM mail),
tel AS (SELECT kept, key, min([seq, pos]) AS spot, arg_min(raw, [seq, pos]) AS raw FROM (SELECT kept, seq, pos, raw, {_NUM('raw')} AS key FROM (SELECT kept, seq, unnest(list_concat([phone], coalesce(phones, []))) AS raw, unnest(range(1 + len(coalesce(phones, [])))) AS pos FROM j WHERE seq <> kept) u) v WHERE length(key) >= 7 GROUP BY kept, key),
person AS (SELECT p.*, j.kept, greatest(p.seq, f.began) AS merge, trim(lower(CASE WHEN {_IS('p.email')} THEN p.email ELSE p.name END)) AS key FROM ({{LEAD_PEOPLE}}) p JOIN j ON j.seq = p.seq JOIN f ON f.kept = j.kept WHERE f.members > 1 AND {_IS('p.name')}),
soon AS (SELECT *, min(merge) OVER (PARTITION BY kept, key) AS brought FROM person),
one AS (SELECT kept, key, min([seq, pos]) AS spot, arg_min(name, [seq, pos]) AS name, arg_min(title, [seq, pos]) FILTER (coalesce(title, '') <> '') AS title, arg_min(email, [seq, pos]) FILTER (coalesce(email, '') <> '') AS email, arg_min(linkedin_url, [seq, pos]) FILTER (coalesce(linkedin_url, '') <> '') AS linkedin_url,
    arg_min({{'c': coalesce(confidence, 0)}}, [seq, pos]).c AS confidence, arg_min(title, [seq, pos]) FILTER (merge = brought AND coalesce(title, '') <> '') AS judged FROM soon GROUP BY kept, key),
placed AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY {duck.seniority('judged')} DESC, {nb('email')} DESC, {nb('linkedin_url')} DESC, confidence DESC, spot) AS place FROM one),
crew AS (SELECT kept, count(*) AS n, bool_or({nb('name')} AND {nb('title')}) AS titled, {text("list(concat(name, '|', coalesce(title, ''), '|', coalesce(email, ''), '|', coalesce(linkedin_url, '')) ORDER BY place)")} AS people, arg_min({{'name': name, 'title': title, 'email': email, 'linkedin': linkedin_url}}, place) AS top FROM placed GROUP BY kept),
alone AS (SELECT seq, count(*) AS n, {text("list(concat(coalesce(name, ''), '|', coalesce(title, ''), '|', coalesce(email, ''), '|', coalesce(linkedin_url, '')) ORDER BY pos)")} AS people FROM ({{LEAD_PEOPLE}}) p GROUP BY seq),
m AS (SELECT l.seq, f.members, l.company_name, {', '.join(out(c) for c in (*dedup.PRIMITIVES, *dedup.PLATFORMS))},
    CASE WHEN f.members > 1 AND NOT {_IS('l.email')} THEN coalesce((SELECT raw FROM mail2 WHERE mail2.kept = l.seq AND nth = 1), l.email) ELSE l.email END AS email,
    CASE WHEN f.members > 1 THEN {text("list_concat(coalesce(l.mails, []), coalesce((SELECT list(raw ORDER BY spot) FROM mail2 WHERE mail2.kept = l.seq AND (nth > 1 OR " + _IS('l.email') + ") AND NOT list_contains(list_transform(list_concat([coalesce(l.email, '')], coalesce(l.mails, [])), lambda e: " + duck.email('e') + "), key)), []))")} ELSE {text('l.mails')} END AS additional_emails,
    CASE WHEN f.members > 1 THEN {text("list_concat(coalesce(l.phones, []), coalesce((SELECT list(raw ORDER BY spot) FROM tel WHERE tel.kept = l.seq AND NOT list_contains(list_transform(list_concat([coalesce(f.phone, '')], coalesce(l.phones, [])), lambda e: " + _NUM('e') + "), key)), []))")} ELSE {text('l.phones')} END AS additional_phones,
    CASE WHEN f.members > 1 THEN coalesce(c.people, '') ELSE a.people END AS people, CASE WHEN f.members > 1 THEN coalesce(c.n, 0) ELSE coalesce(a.n, 0) END AS people_count, coalesce(c.titled, false) AS titled,
    CASE WHEN c.top IS NOT NULL THEN c.top.name ELSE l.decision_maker_name END AS decision_maker_name, CASE WHEN c.top IS NOT NULL THEN c.top.title ELSE l.decision_maker_title END AS decision_maker_title,
    CASE WHEN c.top IS NOT NULL THEN c.top.email ELSE l.decision_maker_email END AS decision_maker_email, CASE WHEN c.top IS NOT NULL THEN c.top.linkedin ELSE l.decision_maker_linkedin END AS decision_maker_linkedin,
    l.city, l.region, l.postal_code, l.has_social, l.from_listing, l.from_website, l.email_status, l.lead_score AS old_score, l.quality_tier AS old_tier
    FROM l JOIN f ON f.kept = l.seq LEFT JOIN crew c ON c.kept = l.seq LEFT JOIN alone a ON a.seq = l.seq),
done AS (SELECT *, CASE WHEN members > 1 THEN CAST({points} AS INT) ELSE old_score END AS lead_score FROM m),
merged AS (SELECT *, CASE WHEN members = 1 THEN old_tier WHEN lead_score >= 75 THEN 'HIGH' WHEN lead_score >= 45 THEN 'MEDIUM' ELSE 'LOW' END AS quality_tier FROM done)
"""


_MERGED = f"{merge_sql()} SELECT {', '.join(SHOWN)}, additional_emails, additional_phones, people FROM merged"
_SMALL = "SELECT seq, company_name, place_id, CAST(NULL AS STRING) AS website, phone FROM ({LEADS}) l"
query("dedup_greedy", lambda s, d: dedup.greedy(rows(s, d, "LEADS")), f"{fold_sql('{LEADS}')} SELECT seq, kept FROM goal")
query("dedup_place_id", lambda s, d: dedup.greedy(rows(s, d, _SMALL)), "SELECT seq, CASE WHEN place_id IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY place_id) END AS kept FROM ({LEADS}) l")
query("duplicate_merge", lambda s, d: shown(dedup.deduplicated(leads_to_merge(s, d))), _MERGED)


def terminal(spark: SparkSession, d: str) -> DataFrame:
    """What the end of a run shows of its leads: how many came, stayed and went, and the tiers of those that stayed."""
    out = dedup.deduplicated(leads_to_merge(spark, d))
    n = lambda t: F.count_if(C("quality_tier") == t)
    return out.agg(F.sum("members").alias("incoming"), F.count("*").alias("leads"), (F.sum("members") - F.count("*")).alias("duplicates_removed"), F.count_if(C("members") > 1).alias("merged"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))


query("terminal_dedup", terminal, f"{merge_sql()} SELECT sum(members)::BIGINT AS incoming, count(*) AS leads, (sum(members) - count(*))::BIGINT AS duplicates_removed, count(*) FILTER (members > 1) AS merged, count(*) FILTER (quality_tier = 'HIGH') AS high, count(*) FILTER (quality_tier = 'MEDIUM') AS medium, count(*) FILTER (quality_tier = 'LOW') AS low FROM merged")
