"""Queries of the crawl: visits in order and their statistics, and their SQL, which walks each site with a list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl, links
from . import catalogue, duck
from .inputs import for_duckdb, rows
from .registry import query

C = F.col
#: The first page of each address, with the fields it gives (as text).
PAGES = """
SELECT p.site, p.url, p.page_id = r.first AS root, CASE p.page_id % 4 WHEN 0 THEN 'company_name,email' WHEN 1 THEN 'phone,city' WHEN 2 THEN 'people,social' ELSE 'address' END AS found
FROM ({SITE_PAGES}) p JOIN (SELECT site, url, min(page_id) AS least FROM ({SITE_PAGES}) a GROUP BY site, url) u ON u.least = p.page_id JOIN (SELECT site, min(page_id) AS first FROM ({SITE_PAGES}) b GROUP BY site) r ON r.site = p.site
"""
#: Links of these pages to the pages that follow on the site, some of which are not there.
LINKS = "SELECT l.site, l.src AS url, l.page_id * 1000 + l.seq % 1000 AS seq, CASE WHEN l.seq % 7 = 3 THEN l.target || '-gone' ELSE l.target END AS target, l.root, l.anchor_text AS anchor, l.container AS box FROM ({SITE_LINKS}) l"


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, LINKS).where(links.policy(C("target"), C("root")).isNull())


def visits(spark: SparkSession, d: str, **options) -> DataFrame:
    pages = rows(spark, d, PAGES).withColumn("found", F.split("found", ","))
    return crawl.crawl(pages, _allowed(spark, d), **options)


def _score(x: str, depth: str, have: str, people: bool) -> str:
    """Score of a link (a struct x), given what the site has."""
    lacks = lambda f: f"NOT list_contains({have}, '{f}')"
    address = f"({lacks('address')} AND NOT (list_contains({have}, 'city') AND list_contains({have}, 'country')))"
    kind = catalogue._intent(f"{x}.url", f"{x}.anchor")
    crew = f"WHEN 'TEAM' THEN CASE WHEN {lacks('people')} THEN 45 ELSE 0 END " if people else ""
    boost = f"CASE {kind} WHEN 'CONTACT' THEN CASE WHEN {lacks('email')} OR {lacks('phone')} OR {address} THEN 40 ELSE 0 END WHEN 'LOCATION' THEN CASE WHEN {lacks('email')} OR {lacks('phone')} OR {address} THEN 40 ELSE 0 END {crew}WHEN 'ABOUT' THEN CASE WHEN {lacks('company_name')} THEN 35 ELSE 0 END ELSE 0 END"
    social = f"CASE WHEN {lacks('social')} AND ({x}.box = 'FOOTER' OR {duck.has(f'{x}.anchor', 'social|follow')}) THEN 20 ELSE 0 END"
    place = f"CASE {x}.box WHEN 'NAV' THEN 15 WHEN 'FOOTER' THEN 8 WHEN 'BUTTON' THEN 10 ELSE 0 END"
    return f"greatest(-100, least(300, 20 + {catalogue._rule(f'{x}.url', 1, '0')} + {catalogue._bonus(f'{x}.anchor')} + {place} + {boost} + {social} - greatest({depth} - 1, 0) * 20))"


def walk_sql(budget: int, deepest: int, early: bool = True, people: bool = True) -> str:
    """CTEs up to step: a row for each site and turn, with its pending links in order, as a queue keeps them."""
    has = lambda f, h="have": f"list_contains({h}, '{f}')"
    core = f"{has('company_name')} AND {has('email')} AND {has('phone')}"
    every = f"{core} AND ({has('address')} OR ({has('city')} AND {has('country')}))" + (f" AND {has('people')}" if people else "")
    why = f"""CASE WHEN {early} AND completed AND n >= 2 AND {every} THEN 'all_requested_fields_satisfied' WHEN {early} AND completed AND n >= 2 AND {core} AND len(pending) > 0 AND list_max(list_transform(pending, lambda x: x.score)) < 40 THEN 'no_more_relevant_pages'
      WHEN n >= {budget} THEN 'budget_exhausted' WHEN len(pending) = 0 THEN 'completed' END"""
    item = "STRUCT(url VARCHAR, anchor VARCHAR, box VARCHAR, depth INT, score INT, intent VARCHAR, nth BIGINT)"
    ordered = lambda xs: f"list_transform(list_sort(list_transform({xs}, lambda x, i: {{'p': -x.score, 'i': i, 'x': x}})), lambda y: y.x)"
    scored = lambda xs, have: f"list_transform({xs}, lambda x: {{'url': x.url, 'anchor': x.anchor, 'box': x.box, 'depth': x.depth, 'score': ({_score('x', 'x.depth', have, people)})::INT, 'intent': {catalogue._intent('x.url', 'x.anchor')}, 'nth': x.nth}})"
    fresh = "list_transform(list_filter(coalesce(out, []), lambda x: x.url <> cur.url AND NOT list_contains(seen2, x.url) AND NOT list_contains(list_transform(rest, lambda q: q.url), x.url)), lambda x: {'url': x.url, 'anchor': x.anchor, 'box': x.box, 'depth': cur.depth + 1, 'score': 0, 'intent': '', 'nth': x.nth})"
    best = "list_filter(new, lambda x: x.score > -40 AND len(list_filter(new, lambda y: y.url = x.url AND (y.score > x.score OR (y.score = x.score AND y.nth < x.nth)))) = 0)"
    first = f"list_sort(list_transform({best}, lambda x: {{'p': -x.score, 'i': list_min(list_transform(list_filter(new, lambda y: y.url = x.url AND y.score > -40), lambda y: y.nth)), 'x': x}}))"
    return f"""
WITH RECURSIVE page AS (SELECT * FROM ({for_duckdb(PAGES)}) p), link AS (SELECT * FROM ({for_duckdb(LINKS)}) l WHERE {catalogue._policy('target', 'root')} IS NULL),
outgoing AS (SELECT site, url AS src, list({{'url': target, 'anchor': anchor, 'box': box, 'nth': seq}} ORDER BY seq) AS out FROM link GROUP BY site, url),
step AS (
  SELECT site, 0 AS n, [{{'url': min(url), 'anchor': '', 'box': '', 'depth': 0::INT, 'score': 1000::INT, 'intent': 'HOMEPAGE', 'nth': 0::BIGINT}}]::{item}[] AS pending, []::VARCHAR[] AS have, []::VARCHAR[] AS seen, false AS completed, NULL::VARCHAR AS url, NULL::INT AS depth, NULL::VARCHAR AS intent, NULL::VARCHAR AS stop_reason FROM page WHERE root GROUP BY site
  UNION ALL
  SELECT site, n + 1, CASE WHEN NOT there THEN rest ELSE CASE WHEN n + 1 < {budget} AND cur.depth < {deepest} THEN {ordered(scored('queued', 'have2'))} ELSE {ordered(scored('rest', 'have2'))} END END, have2, seen2, there, cur.url, cur.depth, cur.intent, NULL FROM (
    SELECT *, list_concat(rest, list_transform({first}, lambda y: y.x)) AS unsorted, {ordered(f"list_concat(rest, list_transform({first}, lambda y: y.x))")} AS queued FROM (
      SELECT *, {scored(fresh, 'have2')} AS new FROM (
        SELECT s.site, s.n, s.pending[1] AS cur, s.pending[2:] AS rest, p.site IS NOT NULL AS there, list_distinct(list_concat(s.have, coalesce(string_split(p.found, ','), []))) AS have2, list_append(s.seen, s.pending[1].url) AS seen2, o.out
        FROM (SELECT *, {why} AS ended FROM step) s LEFT JOIN page p ON p.site = s.site AND p.url = s.pending[1].url LEFT JOIN outgoing o ON o.site = s.site AND o.src = s.pending[1].url WHERE s.ended IS NULL) a) b) c),
ended AS (SELECT site, {why} AS stop_reason FROM step WHERE ({why}) IS NOT NULL)"""


_VISIT = "SELECT s.site, s.url, s.n AS visit, CASE WHEN s.completed THEN 'completed' ELSE 'failed' END AS status, CASE WHEN s.completed THEN s.intent ELSE 'GENERIC' END AS intent, s.depth, e.stop_reason FROM step s JOIN ended e ON e.site = s.site WHERE s.n > 0"
_SHOWN = ("site", "url", "visit", "status", "intent", "depth", "stop_reason")
_STATS = f"SELECT site, count(*) AS pages_scanned, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed' AND intent IN ('CONTACT', 'TEAM', 'ABOUT', 'LOCATION')) AS high_value, max(depth) AS deepest, any_value(stop_reason) IN ('all_requested_fields_satisfied', 'no_more_relevant_pages') AS stopped_early, any_value(stop_reason) AS stop_reason"
query("crawl_visits", lambda s, d: visits(s, d, max_pages=5).select(*_SHOWN), f"{walk_sql(5, 2)} {_VISIT}")
query("crawl_replay_stats", lambda s, d: crawl.stats(visits(s, d, max_pages=8, max_depth=3)), f"{walk_sql(8, 3)} {_STATS}, 8 AS pages_budget FROM ({_VISIT}) v GROUP BY site")
query("crawl_scope_people", lambda s, d: crawl.stats(visits(s, d, max_pages=6, people=False)).groupBy("stop_reason").agg(F.count("*").alias("sites"), F.sum("pages_scanned").alias("pages")), f"{walk_sql(6, 2, people=False)} SELECT stop_reason, count(*) AS sites, sum(pages_scanned)::BIGINT AS pages FROM ({_STATS} FROM ({_VISIT}) v GROUP BY site) w GROUP BY stop_reason")
