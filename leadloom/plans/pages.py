"""Queries of pages: what they say about themselves, and the people on them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import leads, links
from ..sources import html, metadata
from . import catalogue, duck
from .inputs import rows
from .registry import query

C = F.col
#: Pages whose heads have each kind of tag, in either order of attributes and with either quotes, over the raw pages.
HEADS = """
SELECT page_id, url || CASE page_id % 5 WHEN 0 THEN '/contact' WHEN 1 THEN '/our-team/x' ELSE '' END AS url, CASE page_id % 4 WHEN 0 THEN '<html lang="de"><head><meta name="description" content=" First &amp; best "><meta content=''kw a, b'' name=''keywords''><meta property="og:site_name" content="Site ' || CAST(page_id AS STRING) || '"><meta property="og:title" content="T"><link rel="stylesheet" href="x.css"><link href="https://c.test/' || CAST(page_id AS STRING) || '" rel="canonical"><title> About us | S </title></head>'
  WHEN 1 THEN '<meta name=author content=Jane><meta name="twitter:card" content="summary"><meta name="twitter:title" content="a"><meta name="twitter:title" content="b"><meta name="Description" content="Second"><meta property="og:image" content="i.png"><meta property="og:type" content="website">' WHEN 2 THEN '' ELSE '<meta name="description" content=""><meta name="Description" content="Third"><meta property="og:description" content="&lt;d&gt;"><meta property="og:url" content="u"><meta name="twitter:site" content="@s"><meta name="twitter:description" content="td">' END || html AS html FROM {pages}
"""


def _meta_sql() -> str:
    attr = lambda t, n: f"coalesce({', '.join(f'''nullif(regexp_extract({t}, {duck.quoted(metadata.attribute(n))}, {i}), '')''' for i in (2, 3, 4))})"

    def decoded(x: str) -> str:
        for code, mark in metadata.ENTITIES:
            x = f"replace({x}, {duck.quoted(code)}, {duck.quoted(mark)})"
        return duck.trim(x)

    first = lambda kind, name: f"list_filter(metas, lambda m: {attr('m', kind)} = {duck.quoted(name)})[1]"
    content = lambda kind, name: decoded(attr(first(kind, name), "content"))
    named = [f"coalesce({', '.join(f'''nullif({content('name', n)}, '')''' for n in names)}, '') AS {f}" for f, names in metadata.NAMED.items()]
    graph = [f"coalesce({content('property', n)}, '') AS {f}" for f, n in metadata.GRAPH.items()]
    kinds = f"CASE WHEN {catalogue._path('url')} IN ('', '/', '/index.html', '/index.htm', '/home') THEN 'HOMEPAGE' " + " ".join(f"WHEN {duck.has(catalogue._path('url'), '(' + paths + ')', False)}" + (f" OR {duck.has('lower(title)', '(' + titles + ')', False)}" if titles else "") + f" THEN '{kind}'" for kind, paths, titles in links.PAGE_TYPES) + " ELSE 'GENERIC' END"
    tags = f"SELECT page_id, url, {decoded(f'regexp_extract(html, {duck.quoted(metadata.TITLE)}, 1)')} AS title, regexp_extract_all(html, {duck.quoted(metadata.META)}) AS metas, list_filter(regexp_extract_all(html, {duck.quoted(metadata.LINK)}), lambda t: lower({attr('t', 'rel')}) = 'canonical')[1] AS canonical, regexp_extract(html, {duck.quoted(metadata.HTML)}, 0) AS root FROM ({HEADS}) h"
    return f"SELECT page_id, url, {kinds} AS page_type, title, {', '.join(named + graph)}, coalesce({decoded(attr('canonical', 'href'))}, '') AS canonical_url, coalesce({decoded(attr('root', 'lang'))}, '') AS language FROM ({tags}) t"


query("page_metadata", lambda s, d: metadata.page_metadata(rows(s, d, HEADS)), _meta_sql())

#: Pages of people in every form: nested JSON-LD, microdata, cards, lists, names with titles beside them, role addresses.
TEAMS = """
SELECT s_suppkey AS page_id, 'https://www.s' || CAST(s_suppkey % 40 AS STRING) || '.test/team' AS url, CASE s_suppkey % 4
  WHEN 0 THEN '<script type="application/ld+json">{"@type":"Organization","name":"Acme","founder":{"@type":["Person"],"name":"Jane Roe","jobTitle":"Founder","sameAs":["https://x.test","https://linkedin.com/in/jane' || CAST(s_suppkey AS STRING) || '"],"url":"/bio/jane"},"employee":[{"@type":"Person","name":"Max Power","email":"mailto:MAX@s.test","telephone":"tel:+1 415 555 0100","member":{"@type":"person","name":"Ann Lee"}},{"@type":"Person","name":"Team 7"}],"review":{"author":{"@type":"Person","name":"Not Listed"}}}</script>'
  WHEN 1 THEN '<div itemscope itemtype="https://schema.org/Person"><b itemprop="name">Zoe  Kay</b><i itemprop="jobTitle">Sales Director</i><a itemprop="email" href="mailto:zoe@s.test">m</a><a itemprop="sameAs" href="https://linkedin.com/in/zoe">in</a></div>'
  WHEN 2 THEN '<ul class="our-team"><li><strong>Bob Stone - CEO</strong></li><li><strong>Team 7</strong><p>x</p></li><li>no name</li></ul>'
  ELSE '<div class="team-grid"><section><h3>Contact us</h3><h4>Eve Moss</h4><p>She loves to bake and has been here since 2010.</p><span>Marketing Manager</span><a href="mailto:info@s' || CAST(s_suppkey % 40 AS STRING) || '.test">mail</a><a href="tel:+1 415 555 0' || CAST(100 + s_suppkey % 800 AS STRING) || '">call</a><a href="/people/eve">more</a></section></div><div class="speaker-card"><p class="name">Jane Roe</p><p class="job-title">CTO</p><a href="mailto:jane.roe@s.test?subject=x">m</a></div>' END AS html
FROM {supplier}
"""
_AT = "s_suppkey % 4"
_FOUND = f"""
SELECT s_suppkey AS page_id, 's' || CAST(s_suppkey % 40 AS VARCHAR) || '.test' AS site, p.* FROM supplier s JOIN (VALUES
  (0, 0, 'Jane Roe', 'Founder', NULL, NULL, 'json-ld', 0.98::DOUBLE), (0, 1, 'Max Power', NULL, 'max@s.test', '+14155550100', 'json-ld', 0.98::DOUBLE), (0, 2, 'Ann Lee', NULL, NULL, NULL, 'json-ld', 0.98::DOUBLE), (1, 0, 'Zoe Kay', 'Sales Director', 'zoe@s.test', NULL, 'microdata', 0.94::DOUBLE),
  (2, 0, 'Bob Stone', 'CEO', NULL, NULL, 'team-card', 0.9::DOUBLE), (3, 0, 'Eve Moss', 'Marketing Manager', NULL, 'tel', 'team-card', 0.9::DOUBLE), (3, 1, 'Jane Roe', 'CTO', 'jane.roe@s.test', NULL, 'team-card', 0.9::DOUBLE)) AS p(kind, nth, name, title, email, phone, source, confidence) ON p.kind = {_AT}"""
_FOUND = f"SELECT page_id, site, nth, name, title, email, CASE WHEN phone = 'tel' THEN '+14155550' || CAST(100 + page_id % 800 AS VARCHAR) ELSE phone END AS phone, source, confidence, CASE WHEN kind = 0 AND nth = 0 THEN 'https://linkedin.com/in/jane' || CAST(page_id AS VARCHAR) WHEN kind = 1 THEN 'https://linkedin.com/in/zoe' END AS linkedin_url, CASE WHEN kind = 0 AND nth = 0 THEN 'https://www.' || site || '/bio/jane' WHEN kind = 3 AND nth = 0 THEN 'https://www.' || site || '/people/eve' END AS profile_url FROM ({_FOUND}) f"
_SHOWN = ("page_id", "site", "name", "title", "email", "phone", "source", "confidence", "linkedin_url", "profile_url")


def _people(s, d):
    return html.page_people(html.extract(rows(s, d, TEAMS)))


query("page_people", lambda s, d: _people(s, d).select(*_SHOWN), f"SELECT {', '.join(_SHOWN)} FROM ({_FOUND}) f")
_first = lambda c: f"arg_min({c}, page_id * 10 + nth) FILTER (coalesce({c}, '') <> '') AS {c}"
query(
    "site_people",
    lambda s, d: leads.rank_people(leads.dedup_people(_people(s, d))).select("site", "place", "name", "title", "email", "phone", "linkedin_url", "confidence", "seniority"),
    f"SELECT site, row_number() OVER (PARTITION BY site ORDER BY seniority DESC, coalesce(email <> '', false) DESC, coalesce(linkedin_url <> '', false) DESC, confidence DESC, seq)::INT AS place, name, title, email, phone, linkedin_url, confidence, seniority FROM (SELECT *, {duck.seniority('title')} AS seniority FROM (SELECT site, min(page_id * 10 + nth) AS seq, arg_min(name, page_id * 10 + nth) AS name, {_first('title')}, {_first('email')}, {_first('phone')}, {_first('linkedin_url')}, max(confidence) AS confidence FROM ({_FOUND}) f GROUP BY site, lower(name)) g) h",
)
