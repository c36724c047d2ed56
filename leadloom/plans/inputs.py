"""Rows that the queries work on, derived from the tables by SQL that both engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

#: Leads from customers: names, sites, phones and ids that repeat, and gaps.
LEADS = """
SELECT c_custkey AS seq,
  CASE c_custkey % 7 WHEN 0 THEN 'The ' WHEN 3 THEN 'Acme ' ELSE '' END || CASE c_custkey % 5 WHEN 0 THEN 'Harbor Dental' WHEN 1 THEN 'Blue River' WHEN 2 THEN 'North Star' WHEN 3 THEN 'Home' ELSE 'Cedar & Co' END || CASE c_custkey % 4 WHEN 0 THEN ' Care' WHEN 1 THEN ' Group' WHEN 2 THEN '' ELSE ' LLC' END AS company_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'P' || CAST(c_custkey % 331 AS STRING) END AS place_id,
  CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE 'https://www.site' || CAST(c_custkey % 211 AS STRING) || '.test/' END AS website,
  CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE '+1 (415) 55' || CAST(c_custkey % 10 AS STRING) || '-' || CAST(1000 + c_custkey % 83 AS STRING) END AS phone,
  CASE c_custkey % 8 WHEN 0 THEN 'info@site' || CAST(c_custkey % 211 AS STRING) || '.test' WHEN 1 THEN 'Jane.Roe@gmail.com' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'sales@site' || CAST(c_custkey % 211 AS STRING) || '.test,' WHEN 5 THEN 'user@example.com' WHEN 6 THEN 'logo@2x.png' ELSE 'mailto:team%40vendor.io?subject=x' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN 'business_role' WHEN 1 THEN 'freemail' ELSE NULL END AS email_status,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(c_custkey AS STRING) || ' Main Road, ' || n_name || ', 38005' || CAST(c_custkey % 10 AS STRING) || ', India' WHEN 2 THEN 'Address: ' || n_name || ', Gujarat 380057' WHEN 3 THEN n_name ELSE '5 Elm St, ' || n_name || ', SW1A 1AA, UK Closed' END AS address,
  CASE WHEN c_custkey % 2 = 0 THEN n_name END AS city, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS region, CASE WHEN c_custkey % 4 = 2 THEN '380057' END AS postal_code,
  CASE WHEN c_custkey % 9 < 4 THEN 'Pat Doe' END AS decision_maker_name, CAST(c_custkey % 4 AS INT) AS n_people, c_custkey % 10 = 1 AS has_social, c_custkey % 5 < 2 AS has_titled,
  CASE c_custkey % 6 WHEN 0 THEN 'Open soon' WHEN 1 THEN 'Closed · Opens 9 AM' WHEN 2 THEN 'Delivery' WHEN 3 THEN 'Popular pizza place, open' WHEN 4 THEN '' ELSE 'Opens 9:30 am' END AS opening_status,
  c_mktsegment AS category, c_acctbal AS balance
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

#: Leads with further contacts (lists as texts) and profiles, and their people, for merging.
RICH_LEADS = """
SELECT l.*, CASE WHEN seq % 5 = 0 THEN NULL ELSE CAST(seq % 41 AS DOUBLE) / 8 END AS rating, CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(seq % 900 AS BIGINT) END AS review_count,
  CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'About ' || CAST(seq AS STRING) END AS description, CASE WHEN seq % 6 = 2 THEN 'https://m.test/' || CAST(seq AS STRING) END AS map_url,
  CASE seq % 5 WHEN 0 THEN 'Billing@site' || CAST(seq % 211 AS STRING) || '.test;info@site' || CAST(seq % 7 AS STRING) || '.test' WHEN 1 THEN 'jane.roe@GMAIL.com' WHEN 2 THEN 'x' || CAST(seq % 3 AS STRING) || '@vendor.io;X1@vendor.io.' END AS more_emails,
  CASE seq % 7 WHEN 0 THEN '415-555-' || CAST(1000 + seq % 83 AS STRING) || ';12345' WHEN 3 THEN '99;030 555 ' || CAST(1000 + seq % 5 AS STRING) END AS more_phones,
  CASE WHEN seq % 4 = 3 THEN 'https://linkedin.com/company/c' || CAST(seq AS STRING) END AS linkedin, CASE WHEN seq % 5 = 1 THEN 'https://facebook.com/f' || CAST(seq AS STRING) END AS facebook, CAST(NULL AS STRING) AS instagram, CASE WHEN seq % 9 = 4 THEN '' END AS twitter,
  CASE WHEN seq % 11 = 5 THEN 'https://youtube.com/@y' || CAST(seq AS STRING) END AS youtube, CAST(NULL AS STRING) AS github, CASE WHEN seq % 8 = 7 THEN 'https://pinterest.com/p' || CAST(seq AS STRING) END AS pinterest,
  CASE WHEN seq % 9 < 4 THEN 'Owner' END AS decision_maker_title, CAST(NULL AS STRING) AS decision_maker_email, CAST(NULL AS STRING) AS decision_maker_linkedin, seq % 3 < 2 AS from_listing, seq % 2 = 0 AS from_website, CAST(seq % 50 AS INT) AS lead_score, 'LOW' AS quality_tier
FROM ({LEADS}) l
"""
LEAD_PEOPLE = """
SELECT seq, pos, CASE (seq + pos) % 7 WHEN 0 THEN 'Jane Roe' WHEN 1 THEN 'JANE ROE' WHEN 2 THEN 'Max Power' WHEN 3 THEN '' WHEN 4 THEN 'Ann Lee' WHEN 5 THEN 'Max Power ' ELSE 'Zoe Kay' END AS name,
  CASE (seq + 2 * pos) % 5 WHEN 0 THEN 'CEO' WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN 'Sales Director' ELSE 'Nurse' END AS title,
  CASE (seq + pos) % 4 WHEN 1 THEN 'Jane@site' || CAST(seq % 211 AS STRING) || '.test' WHEN 3 THEN '' END AS email, CASE WHEN seq % 3 = 0 THEN '+1 415 555 0199' END AS phone,
  CASE WHEN (seq + pos) % 3 = 1 THEN 'https://linkedin.com/in/p' || CAST(seq % 13 AS STRING) END AS linkedin_url, CAST(NULL AS STRING) AS profile_url, CASE WHEN seq % 4 = 0 THEN NULL ELSE CAST(seq % 4 AS DOUBLE) / 4 END AS confidence
FROM ({LEADS}) l JOIN (VALUES (0), (1), (2)) AS v(pos) ON pos < seq % 4
"""

#: Odd texts as listing cards hold them.
SNIPPETS = """
SELECT p_partkey AS id, CASE p_partkey % 23
  WHEN 0 THEN '4.5 (1,234)' WHEN 1 THEN '4.5' WHEN 2 THEN '(87 reviews)' WHEN 3 THEN '380057' WHEN 4 THEN '12' WHEN 5 THEN '$$' WHEN 6 THEN '₹200–400' WHEN 7 THEN '€15 - 30' WHEN 8 THEN '2FXQ+9R Ahmedabad' WHEN 9 THEN 'Search' WHEN 10 THEN 'Results for cafe'
  WHEN 11 THEN 'www.' || replace(p_name, ' ', '') || '.com' WHEN 12 THEN 'https://maps.google.com/x' WHEN 13 THEN '★ ' || p_name || '  □ ' || p_brand WHEN 14 THEN 'Copy address' WHEN 15 THEN '5 stars' WHEN 16 THEN 'Closes 10 pm' WHEN 17 THEN 'Temporarily closed' WHEN 18 THEN 'Dine-in' WHEN 19 THEN '' WHEN 20 THEN NULL
  WHEN 21 THEN 'http://' || replace(p_name, ' ', '-') || '.org/?a=1' ELSE p_name || ' ' || p_type END AS txt,
  CASE p_partkey % 9 WHEN 0 THEN 'Phone: +91 79 4000 ' || CAST(1000 + p_partkey % 9000 AS STRING) WHEN 1 THEN 'Send to phone' WHEN 2 THEN 'tel:(415) 555-0' || CAST(100 + p_partkey % 900 AS STRING) WHEN 3 THEN '12345' WHEN 4 THEN 'Call' WHEN 5 THEN '1111111' WHEN 6 THEN '0123456789' WHEN 7 THEN 'x' ELSE '020 7946 0' || CAST(100 + p_partkey % 900 AS STRING) END AS tel,
  CASE p_partkey % 8 WHEN 0 THEN 'https://www.google.com/url?q=https%3A%2F%2F' || replace(p_name, ' ', '') || '.com%2F&sa=D' WHEN 1 THEN 'shop' || CAST(p_partkey % 50 AS STRING) || '.example.org' WHEN 2 THEN 'https://Maps.Google.com/x' WHEN 3 THEN 'HTTP://Www.Site' || CAST(p_partkey % 70 AS STRING) || '.com/' WHEN 4 THEN 'menu' WHEN 5 THEN 'https://foo...com' WHEN 6 THEN 'https://a.test/p?utm_source=x&b=' || CAST(p_partkey % 10 AS STRING) || '#top' ELSE 'javascript:void(0)' END AS link,
  CASE p_partkey % 6 WHEN 0 THEN 'https://m.test/maps/place/A+B/@12.' || CAST(100 + p_partkey % 800 AS STRING) || ',-77.5,17z/data=!3d10.5!4d-20.25!19sChIJ' || CAST(p_partkey % 97 AS STRING) WHEN 1 THEN 'https://m.test/maps/search/coffee+shop%20x/@1.25,2.5' WHEN 2 THEN 'https://m.test/x?place_id=ab-' || CAST(p_partkey % 77 AS STRING) WHEN 3 THEN 'https://m.test/data=!1s0x3:0x' || CAST(p_partkey % 88 AS STRING) || '!8m2' WHEN 4 THEN 'https://m.test/data=!1sid%3A' || CAST(p_partkey % 66 AS STRING) || '!8' ELSE 'none' END AS href
FROM {part}
"""

#: People with titles, on sites.
PEOPLE = """
SELECT CAST(c_custkey % 97 AS BIGINT) AS site, c_custkey AS seq,
  CASE c_custkey % 9 WHEN 0 THEN 'Jane Smith' WHEN 1 THEN 'JANE SMITH' WHEN 2 THEN 'Ann de Groot' WHEN 3 THEN 'Our Team' WHEN 4 THEN 'Bob' WHEN 5 THEN 'Ludwig van Beethoven' WHEN 6 THEN 'Zoë Ärmel' WHEN 7 THEN 'Acme Holdings' ELSE 'Max Power 3' END AS name,
  CASE c_custkey % 11 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Co-Founder & CEO' WHEN 2 THEN 'CTO' WHEN 3 THEN 'VP Sales' WHEN 4 THEN 'Head of Design' WHEN 5 THEN 'Sales Director' WHEN 6 THEN 'Senior Manager' WHEN 7 THEN 'Nurse' WHEN 8 THEN '' WHEN 9 THEN NULL ELSE 'Joined in 2010 as lead engineer.' END AS title,
  CASE WHEN c_custkey % 4 = 1 THEN 'jane' || CAST(c_custkey % 3 AS STRING) || '@site' || CAST(c_custkey % 97 AS STRING) || '.test' END AS email,
  CASE WHEN c_custkey % 5 = 2 THEN '+1 415 555 ' || CAST(1000 + c_custkey % 40 AS STRING) END AS phone,
  CASE WHEN c_custkey % 3 = 1 THEN 'https://linkedin.com/in/p' || CAST(c_custkey % 13 AS STRING) END AS linkedin_url, CAST(NULL AS STRING) AS profile_url, CAST((c_custkey % 4) * 0.25 AS DOUBLE) AS confidence
FROM {customer}
"""

#: Evidence of sites: several fields, sources, pages and values that agree or not.
EVIDENCE = """
SELECT CAST(o_orderkey % 199 AS BIGINT) AS site, o_orderkey AS seq,
  CASE o_orderkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'company_name' WHEN 3 THEN 'linkedin' ELSE 'city' END AS field,
  CASE o_orderkey % 5 WHEN 0 THEN CASE o_orderkey % 7 WHEN 0 THEN 'info@acme.test' WHEN 1 THEN 'Sales@Acme.test' WHEN 2 THEN 'joe@gmail.com' WHEN 3 THEN 'info@acme.test' WHEN 4 THEN 'jane1@site3.test' WHEN 5 THEN 'a@b' ELSE 'careers@acme.test' END
    WHEN 1 THEN '(415) 555-' || CAST(1000 + o_orderkey % 4 AS STRING) WHEN 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Acme' WHEN 1 THEN 'ACME ' ELSE 'Home' END
    WHEN 3 THEN CASE o_orderkey % 3 WHEN 0 THEN 'https://linkedin.com/company/acme' WHEN 1 THEN 'https://linkedin.com/in/joe' ELSE 'https://example.org/x' END ELSE CASE o_orderkey % 2 WHEN 0 THEN 'Berlin' ELSE ' Paris  Nord ' END END AS value,
  CASE o_orderkey % 6 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'mailto' WHEN 2 THEN 'regex-pattern' WHEN 3 THEN 'metadata' WHEN 4 THEN 'contextual-label' ELSE 'microdata' END AS source,
  CASE WHEN o_orderkey % 17 = 0 THEN 'json-ld-organization' WHEN o_orderkey % 17 = 1 THEN 'body-regex-fallback' ELSE 'other' END AS evidence_type,
  'https://acme.test/p' || CAST(o_custkey % 4 AS STRING) AS page_url,
  CASE o_custkey % 4 WHEN 0 THEN 'CONTACT' WHEN 1 THEN 'ABOUT' WHEN 2 THEN 'BLOG' ELSE NULL END AS page_type
FROM {orders}
"""

#: Page addresses with telling paths, and links from each page to the next six of its host.
SITE_PAGES = """
SELECT page_id, CAST(page_id % 41 AS BIGINT) AS site, 'https://www.site' || CAST(page_id % 41 AS STRING) || '.test' || CASE page_id % 19
  WHEN 0 THEN '/contact' WHEN 1 THEN '/about-us' WHEN 2 THEN '/our-team' WHEN 3 THEN '/locations' WHEN 4 THEN '/services' WHEN 5 THEN '/careers' WHEN 6 THEN '/faq' WHEN 7 THEN '/blog/post' WHEN 8 THEN '/tag/x' WHEN 9 THEN '/cart' WHEN 10 THEN '/privacy-policy' WHEN 11 THEN '/files/file.pdf' WHEN 12 THEN '/?s=q' WHEN 13 THEN '' WHEN 14 THEN '/index.html' WHEN 15 THEN '/company/story' WHEN 16 THEN '/2024/05/x' WHEN 17 THEN '/page/3' ELSE '/p' || CAST(page_id AS STRING) END AS url,
  CASE page_id % 5 WHEN 0 THEN 'Contact us' WHEN 1 THEN 'About the company' WHEN 2 THEN 'Meet the team' WHEN 3 THEN 'Read more' ELSE 'Follow us' END AS anchor_text,
  CASE page_id % 4 WHEN 0 THEN 'NAV' WHEN 1 THEN 'FOOTER' WHEN 2 THEN 'BUTTON' ELSE 'MAIN' END AS container
FROM {pages}
"""
SITE_LINKS = """
SELECT a.page_id, a.site, a.url AS src, b.page_id AS seq, b.url AS target, b.anchor_text, b.container, CAST(1 + a.page_id % 3 AS INT) AS depth, 'site' || CAST(a.site AS STRING) || '.test' AS root
FROM ({SITE_PAGES}) a JOIN (VALUES (41), (82), (123), (164), (205), (246)) AS k(step) ON a.page_id + k.step > 0 JOIN ({SITE_PAGES}) b ON b.page_id = a.page_id + k.step
"""

#: Candidate events of runs (a user is a run).
RUNS = """
SELECT user_id AS run_id, event_id AS seq, ts, CAST(event_id % 7 AS INT) AS idx, 'a' || CAST(event_id % 3 AS STRING) AS attempt_id,
  CASE WHEN value > 20 THEN 'coffee shop' ELSE 'tea  House' END AS query, CASE event_type WHEN 'click' THEN 'READY' WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'READY' ELSE 'PENDING' END AS state,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'P' || CAST(event_id % 13 AS STRING) END AS place_id, event_type
FROM {events}
"""

DERIVED = {"LEADS": LEADS, "RICH_LEADS": RICH_LEADS, "LEAD_PEOPLE": LEAD_PEOPLE, "SNIPPETS": SNIPPETS, "PEOPLE": PEOPLE, "EVIDENCE": EVIDENCE, "SITE_PAGES": SITE_PAGES, "SITE_LINKS": SITE_LINKS, "RUNS": RUNS}


_INPUT, _TABLE = re.compile(r"\{(" + "|".join(DERIVED) + r")\}"), re.compile(r"\{(" + "|".join(TABLES) + r")\}")


def expand(sql: str) -> str:
    """Derived inputs by their text, until only tables are left in braces."""
    while (m := _INPUT.search(sql)) is not None:
        sql = sql.replace(m[0], DERIVED[m[1]].strip())
    return sql


def for_duckdb(sql: str) -> str:
    return _TABLE.sub(r"\1", expand(sql))


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A derived input, or any SQL over derived inputs and tables in braces, as a DataFrame."""
    text = expand(DERIVED.get(sql, sql))
    text = "".join(part if i % 2 else part.replace("{", "{{").replace("}", "}}") for i, part in enumerate(re.split(r"(\{(?:" + "|".join(TABLES) + r")\})", text)))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
