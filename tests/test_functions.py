"""Scalar rules, one table of cases for each: (input, expected)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadloom.functions import listing, text, web
from leadloom.operators import dedup, links

CASES = [
    (text.clean_unicode, [(" ★ A  B□ ", "A B"), (None, "")]),
    (text.is_plus_code, [("2FXQ+9R Ahmedabad", True), ("no code", False), (None, False)]),
    (text.is_ui_title, [("Search", True), ("Results for x", True), ("Cafe", False), (None, True)]),
    (text.is_rating_text, [("4.5 (1,234)", True), ("380057", False), ("12", True), ("5 stars", True), ("Cafe 4", False)]),
    (text.is_price_text, [("$$", True), ("₹200–400", True), ("200", False)]),
    (text.opening_status, [("Open soon", "Open soon"), ("Dine-in", None), ("Popular place, open", None), ("Closes 10 pm", "Closes 10 pm")]),
    (text.clean_address, [("Address: 5 Elm St, Berlin Closed", "5 Elm St, Berlin"), ("4.5", None), ("copy address", None)]),
    (text.number, [("1,234 x", 1234.0), ("none", None)]),
    (text.normalize_query, [(" Coffee+Shop ", "coffee shop"), (None, "")]),
    (text.slug, [("Blue River & Co", "blue-river-co"), ("", "google-maps")]),
    (listing.place_id, [("x!19sChIJ12?y", "ChIJ12"), ("x!1s0x3:0x9!8", "0x3:0x9"), ("place_id=ab-1", "ab-1"), ("none", None)]),
    (listing.phone_from_text, [("Phone: +91 79 4000 1234", "+91 79 4000 1234"), ("Send to phone", None), ("12345", None)]),
    (listing.sanitize_url, [("a.test/", "https://a.test"), ("https://maps.google.com/x", None), ("nodot", None), ("HTTP://A.Test/P", "http://a.test/P")]),
    (listing.resolve_website, [("https://www.google.com/url?q=https%3A%2F%2Fx.test%2F&sa=D", "https://x.test"), ("menu", None), ("foo...com", None)]),
    (web.normalize_email, [("mailto:Team%40Vendor.io?subject=x", "team@vendor.io"), (" A@B.co. ", "a@b.co"), (None, "")]),
    (web.normalize_phone, [("tel:+1 (415) 555-0100", "+14155550100"), ("12345", ""), ("(415) 555-0100 x", "(415) 555-0100")]),
    (web.normalize_domain, [("https://www.Acme.test/x", "acme.test"), ("acme.test:80", "acme.test"), (None, "")]),
    (web.normalize_url, [("https://A.test/?utm_source=x#y", "https://a.test"), ("a.test/p?b=1&ref=2", "https://a.test/p?b=1"), ("javascript:x", "")]),
    (web.is_email, [("info@acme.test", True), ("a@b", False), ("x", False), (None, False)]),
    (web.is_phone, [("415 555 0100", True), ("1111111", False), ("12345678901", False), ("123", False)]),
    (web.normalize_social, [("https://x.com/a/?b#c", "https://x.com/a")]),
    (web.is_company_name, [("Acme", True), ("Contact us", False), ("A", False)]),
    (web.decode_protected_email, [("2a4b6a52045e4f595e", "a@x.test"), ("2", None)]),
    (web.title_brand, [("About Acme | Home", "Acme"), ("Contact Us", "Us"), ("Home", ""), ("Coca-Cola", "Coca")]),
    (web.is_person_name, [("Jane Smith", True), ("Ann de Groot", True), ("McDonald Bob", False), ("Our Team", False), ("Bob", False)]),
    (web.is_job_title, [("Chief Executive Officer", True), ("Joined in 2010 as lead.", False), ("Nurse", False)]),
    (web.seniority, [("Co-Founder & CEO", 1.0), ("CTO", 0.9), ("VP Sales", 0.85), ("Sales Director", 0.8), ("Team Lead", 0.65), ("Nurse", 0.5), (None, 0.4)]),
]


@pytest.mark.parametrize(("rule", "cases"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_rule(spark, rule, cases):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r["y"] for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [y for _, y in cases]


def one(spark, column):
    return spark.range(1).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("mail", "site", "kind", "role"),
    [("info@acme.test", "www.acme.test", "business_role", "general"), ("joe@acme.test", "acme.test", "business_individual", "direct"), ("sales@x.test", "acme.test", "external_business", "sales"), ("a@gmail.com", "acme.test", "freemail", "direct"), ("logo@2x.png", "acme.test", "asset_filename", None), ("user@acme.test", "acme.test", "placeholder", None), ("x@sentry.io", "", "vendor_tracker", None), ("bad", "", "invalid_syntax", None)],
)
def test_email_class(spark, mail, site, kind, role):
    y = one(spark, web.evaluate_email(F.lit(mail), F.lit(site)))
    assert (y["classification"], y["email_role"]) == (kind, role)


def test_addresses(spark):
    y = one(spark, listing.parse_address(F.lit("12 Main Road, Gota, Gujarat 380057, India")))
    assert y.asDict() == {"address": "12 Main Road, Gota, Gujarat 380057, India", "city": "Gota", "region": "Gujarat", "country": "India", "postal_code": "380057"}
    assert one(spark, listing.parse_address(F.lit("4.5")))["city"] is None


@pytest.mark.parametrize(("a", "b", "same"), [("La Pizzeria Milano", "Milano Pizza", True), ("Pinoz Pizza", "Milano Pizza", False), ("The Restaurant", "the restaurant", True), ("Blue River Foods", "Blue River", True), (None, "x", False)])
def test_identity(spark, a, b, same):
    assert one(spark, listing.is_identity_match(F.lit(a).cast("string"), F.lit(b))) is same


def test_names(spark):
    assert one(spark, dedup.name_similarity(F.lit("Acme Dental"), F.lit("Acme Dental Care Inc"))) == 0.85
    assert one(spark, web.split_name_title(F.lit("CEO | Jane Smith"))).asDict() == {"name": "Jane Smith", "title": "CEO"}


@pytest.mark.parametrize(("url", "reason"), [("https://acme.test/contact", None), ("https://x.test/", "External domain: x.test (root: acme.test)"), ("https://acme.test/a.pdf", "Excluded file extension: .pdf"), ("https://acme.test/cart", "Excluded system path: /cart"), ("https://acme.test/?s=x", "Search query result URL"), ("mailto:x", "Non-HTTP/HTTPS protocol"), ("javascript:x", "Blocked protocol: javascript:")])
def test_policy(spark, url, reason):
    assert one(spark, links.policy(F.lit(url), F.lit("www.acme.test"))) == reason


def test_priority(spark):
    p = lambda url, text_, depth, box: one(spark, links.priority(F.lit(url), F.lit(text_), F.lit(depth), F.lit(box)))
    assert p("https://a.test/contact", "Contact us", 1, "NAV") == 255
    assert p("https://a.test/blog", "News", 2, "") == -50
    assert one(spark, links.intent(F.lit("https://a.test/x"), F.lit("About us"))) == "TEAM"


def test_protected_address_is_made_once(spark):
    df = spark.range(1).select(web.decode_protected_email(F.concat(F.lit("2a4b6a"), F.lit("MARK"), F.col("id").cast("string"))).alias("x"))
    assert df._jdf.queryExecution().analyzed().toString().count("MARK") == 1


def test_identity_pairs_equal_the_rule(spark):
    names = ["Milano Pizza", "Milano's Pizza Shop", "", None, "Blue River", "the restaurant", "Milano Pizza"]
    a, b = spark.createDataFrame([(i, i % 2, n) for i, n in enumerate(names)], "a int, k int, x string"), spark.createDataFrame([(i, i % 3, n) for i, n in enumerate(names)], "b int, k int, y string")
    plain = a.join(b, "k").select("a", "b", listing.is_identity_match(F.col("x"), F.col("y")).alias("same"))
    assert sorted(listing.identity_pairs(a, b, "k").collect()) == sorted(plain.collect())


def test_trim_and_squeeze(spark):
    from pyspark.sql import functions as F

    from leadloom.functions.text import clean_unicode, js_trim, squeeze

    texts = [" \ta  b c \n", " \u0085", "a \u0085", "a b", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").orderBy("id")
    out = df.select(js_trim(F.col("t")), squeeze(F.col("t")), clean_unicode(F.concat(F.lit("★ "), "t"))).collect()
    assert [tuple(r) for r in out] == [("a  b c", "a b c", "a b c"), ("\u0085", "\u0085", "\u0085"), ("a \u0085", "a \u0085", "a \u0085"), ("a b", "a b", "a b"), ("", "", ""), (None, None, "")]
