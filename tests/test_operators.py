"""Records, pages, crawl, duplicates, runs, exports and streams on small rows."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from leadloom.operators import dedup, evidence, leads
from leadloom.plans import catalogue
from leadloom.plans.inputs import rows
from leadloom.sources import export, html
from leadloom.streaming import runs as stream

LEAD = "seq long, company_name string, place_id string, website string, phone string"


def greedy(spark, data):
    return {r["seq"]: r["kept"] for r in dedup.greedy(spark.createDataFrame(data, LEAD)).collect()}


def test_duplicates(spark):
    site = "https://acme.test"
    assert greedy(spark, [(1, "A", "P1", None, None), (2, "B", "p1 ", None, None)]) == {1: 1, 2: 1}
    assert greedy(spark, [(1, "A", "P1", site, "4155550100"), (2, "A", "P2", site, "4155550100")]) == {1: 1, 2: 2}
    assert greedy(spark, [(1, "A", None, site, "+1 415 555 0100"), (2, "B", None, site, "(415) 555-0100")]) == {1: 1, 2: 1}
    assert greedy(spark, [(1, "A", None, site, "4155550100"), (2, "A", None, site, "4155550199")]) == {1: 1, 2: 2}
    assert greedy(spark, [(1, "Acme Dental", None, site, None), (2, "Acme Dental Care", None, site, None), (3, "Acme Dental", None, None, None)]) == {1: 1, 2: 1, 3: 3}
    # a kept lead takes over what it lacks, so the third joins through the second's place id
    assert greedy(spark, [(1, "Acme Dental", None, site, None), (2, "Acme Dental", "P9", site, None), (3, "Z", "P9", None, None)]) == {1: 1, 2: 1, 3: 1}


def test_html(spark):
    page = '<html><base href="https://a.test/x/"><body><nav><a href="team?utm_source=q">Our team</a></nav><p>Email: info@a.test<p>two</p><a href="mailto:b@a.test?x">m</a><a class="__cf_email__" data-cfemail="2a4b6a52045e4f595e">x</a></body>'
    out = html.extract(spark.createDataFrame([(1, "https://a.test/", page), (2, None, None)], "page_id long, url string, html string")).collect()
    mails = {(r["value"], r["source"]) for r in out if r["field"] == "email"}
    assert mails >= {("info@a.test", "contextual-label"), ("b@a.test", "mailto"), ("a@x.test", "cloudflare-decoded")}
    assert [(r["value"], r["field"], r["title"]) for r in out if r["kind"] == "link"] == [("https://a.test/x/team", "NAV", "Our team")]
    assert all(r["page_id"] == 1 for r in out)
    assert html.url_norm("HTTPS://Ä.test:443/ä b?x=1&gclid=2#f") == "https://xn--4ca.test/%C3%A4%20b?x=1"


def test_html_kinds(spark):
    ld = [{"@context": "x", "@graph": [{"@type": "WebSite", "url": "https://a.test"}, {"@type": ["LocalBusiness", "X"], "legalName": "Acme Ltd", "telephone": 123, "contactPoint": [{"@type": "ContactPoint", "email": "c@a.test"}], "address": "1 Elm St"}, {"@type": "Thing", "address": {"addressLocality": "Ulm", "postalCode": "89073"}}]}]
    import json

    page = '<title>Acme Dental | Contact</title><meta property="og:description" content="about"><meta property="og:site_name" content="Acme">' + f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">{{</script>' + '<div itemscope itemtype="https://schema.org/Store"><a itemprop="email" href="mailto:m@a.test">x</a></div><a href="/cdn-cgi/l/email-protection#2a4b6a52045e4f595e">p</a><address>5 Elm St, Ulm</address>'
    out = {(r["field"], r["value"], r["evidence_type"]) for r in html.extract(spark.createDataFrame([(1, "https://a.test/", page)], "page_id long, url string, html string")).where("kind = 'evidence'").collect()}
    assert out >= {
        ("company_name", "Acme Ltd", "json-ld-localbusiness-name"), ("phone", "123", "json-ld-localbusiness-phone"), ("email", "c@a.test", "json-ld-contactpoint-email"), ("address", "1 Elm St", "json-ld-localbusiness-address-str"),
        ("address", "Ulm, 89073", "json-ld-postal-address-full"), ("city", "Ulm", "json-ld-postal-locality"), ("postal_code", "89073", "json-ld-postal-code"), ("email", "mailto:m@a.test", "microdata-itemprop-email"),
        ("email", "a@x.test", "anchor-cf-protection"), ("address", "5 Elm St, Ulm", "semantic-html-address-tag"), ("company_name", "Acme", "open-graph-site-name"), ("company_name", "Acme Dental", "page-title-branding"), ("description", "about", "meta-description"),
    }
    assert not any(k.startswith("json-ld-website") for _, _, k in out)


def test_listings_are_found_by_place_first(spark):
    known = spark.createDataFrame([(1, None, "u1"), (2, "P1", "u1"), (3, "P1", None)], "pos long, place_id string, source_url string")
    asked = spark.createDataFrame([(10, "P1", "u1"), (11, "P9", "u1"), (12, "P9", None)], "id long, pid string, url string")
    assert sorted(map(tuple, leads.find_listing(known, asked).collect())) == [(10, 2, 1), (11, 1, 2)]


def test_merge_never_overwrites(spark):
    base = ", ".join(f"{c} string" for c in (*leads.FILLED, "email", "email_status"))
    blank = dict.fromkeys((*leads.FILLED, "email", "email_status"))
    listings = spark.createDataFrame([{"key": 1, **blank, "company_name": "A", "phone": " ", "website": "w"}, {"key": 2, **blank}], f"key long, {base}")
    sites = spark.createDataFrame([{"key": 1, **blank, "company_name": "B", "phone": "1", "email": "e@x.test"}], f"key long, {base}")
    out = {r["key"]: r for r in leads.merge(listings, sites, "key").collect()}
    assert (out[1]["company_name"], out[1]["phone"], out[1]["email_status"], out[1]["phone_source"]) == ("A", "1", "verified", "WEBSITE")
    assert out[1]["enrichment_status"] == "enriched" and out[2]["enrichment_status"] == "skipped_no_website"


def test_confidence(spark):
    f = lambda *a: spark.range(1).select(evidence.initial_confidence(*[F.lit(x).cast("string") for x in a]).alias("y")).first()["y"]
    assert f("email", "i@a.test", "mailto", "anchor-mailto", "CONTACT", "business_role") == 1.0
    assert f("email", "i@gmail.com", "regex-pattern", "x", None, "freemail") == 0.3
    assert f("linkedin", "https://linkedin.com/in/x", "semantic-dom", "x", "TEAM", None) == 0.81


def test_export(spark):
    df = spark.createDataFrame([("A, \"B\"", "01234", ["x@a.test", "y@a.test"])], "company_name string, postal_code string, additional_emails array<string>")
    body = export.csv_text(df, export.ENRICHED)
    assert body.startswith("﻿Company Name,") and '"A, ""B"""' in body and "x@a.test; y@a.test" in body and body.endswith("\r\n")
    assert (len(export.LISTING), len(export.ENRICHED), len(export.PEOPLE)) == (24, 34, 7)
    z = zipfile.ZipFile(io.BytesIO(export.xlsx({"Leads": export.layout(df, export.LISTING)})))
    assert z.testzip() is None and "01234" in z.read("xl/worksheets/sheet1.xml").decode()
    assert export.column_letters(0) == "A" and export.column_letters(27) == "AB"


def test_stream_of_candidates(spark, tmp_path):
    ddl = "run_id long, idx int, attempt_id string, seq long, ts timestamp, event string"
    events = [(1, 0, "a", 1, "2024-01-01 00:00:00", "dispatch"), (1, 0, "old", 2, "2024-01-01 00:00:01", "ready"), (1, 0, "a", 3, "2024-01-01 00:00:02", "ready"), (1, 0, "a", 4, "2024-01-01 00:00:03", "failed")]
    spark.createDataFrame(events, "run_id long, idx int, attempt_id string, seq long, t string, event string").selectExpr("run_id", "idx", "attempt_id", "seq", "cast(t as timestamp) ts", "event").write.parquet(str(tmp_path / "in"))
    q = stream.candidate_states(spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["state"], r["seq"]) for r in spark.table("states").orderBy("seq").collect()] == [("DISPATCHED", 1), ("READY", 3)]


def test_catalogue_runs(spark, sf):
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    for name in ("link_priority_top", "conflict_winner", "batch_metrics", "stale_reject"):
        assert catalogue.QUERIES[name](spark, sf).count() > 0
    assert rows(spark, sf, "LEADS").count() > 0
