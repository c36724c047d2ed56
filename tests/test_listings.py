"""Cards and panels of a listing page on rows written by hand."""

from __future__ import annotations

from leadloom.operators import listings

CARD = "id long, title string, link_label string, card_label string, in_panel boolean, href string, rows array<string>, rating_text string, reviews_text string, phone struct<href:string,label:string,text:string>, site struct<href:string,text:string>"


def card(spark, *rows):
    blank = {"title": None, "link_label": None, "card_label": None, "in_panel": None, "href": None, "rows": None, "rating_text": None, "reviews_text": None, "phone": None, "site": None}
    return spark.createDataFrame([tuple({"id": i, **blank, **r}.values()) for i, r in enumerate(rows)], CARD)


def leads(spark, *rows):
    return {r["id"]: r for r in listings.card_leads(card(spark, *rows), "id").collect()}


def test_card(spark):
    out = leads(
        spark,
        {"title": "★ Apex Dental", "href": "https://m.test/maps/place/x/@23.01,72.5,17z/data=!19sChIJ1", "rows": ["4.6 (1,204) · Dentist · $$", "Dentist · 12 Main Road, Pune, 411001, India", "Open ⋅ Closes 9 pm · +91 79 4000 1234"], "site": ("https://apex.test/", None)},
        {"title": "Results"}, {"title": None, "link_label": "Link name"}, {"title": "X", "in_panel": True}, {},
    )
    assert set(out) == {0, 2}
    a = out[0]
    assert (a["company_name"], a["rating"], a["review_count"], a["category"], a["price_range"], a["phone"], a["website"]) == ("Apex Dental", 4.6, 1204, "Dentist", "$$", "+91 79 4000 1234", "https://apex.test")
    assert (a["city"], a["postal_code"], a["place_id"], a["latitude"], a["extraction_mode"]) == ("Pune", "411001", "ChIJ1", 23.01, "result-card")
    assert (out[2]["company_name"], out[2]["category"], out[2]["rating"]) == ("Link name", None, None)


def test_parts_go_to_the_first_slot_that_is_empty(spark):
    out = leads(
        spark,
        {"title": "A B", "rows": ["4.1 · (12) · 3.3 · (99)", "A B · Cafe · Bakery · Bar"]}, {"title": "A B", "rows": ["0.0 (5) · 4.4 (7)"]}, {"title": "A B", "rows": ["Cafe · Cafe · 5 Elm St, Ulm"], "phone": ("tel:12 34 56 7", "x", None)},
        {"title": "A B", "rating_text": "4.9 stars", "rows": ["3.0 (8)"], "phone": (None, "Phone: 079 4000 1234", None)}, {"title": "A B", "rows": ["Dine-in · Temporarily closed · +1 415 555 0100 · +1 415 555 0199"]},
    )
    assert (out[0]["rating"], out[0]["review_count"], out[0]["category"]) == (4.1, 12, "A B")  # a name without digits is a category too
    assert (out[1]["rating"], out[1]["review_count"]) == (4.4, 5)
    assert (out[2]["category"], out[2]["address"], out[2]["phone"]) == ("Cafe", "5 Elm St, Ulm", "12 34 56 7")
    assert (out[3]["rating"], out[3]["review_count"], out[3]["phone"]) == (4.9, 8, "079 4000 1234")
    assert (out[4]["phone"], out[4]["category"], out[4]["opening_status"]) == ("+1 415 555 0100", None, "Temporarily closed")


def test_validated(spark):
    ddl = "seq long, company_name string, rating double, review_count double, phone string, address string, opening_status string, website string"
    out = {r["seq"]: r for r in listings.validated(spark.createDataFrame([(1, " A ★", 5.5, -1.0, "4.5", "5 Elm St Open", "Open", "a.test"), (2, "Directions", 4.0, 3.0, "1", None, None, None), (3, None, None, float("nan"), None, None, None, None), (4, "B", 1.0, 7.9, "030 1", None, None, "x")], ddl)).collect()}
    assert (out[1]["company_name"], out[1]["rating"], out[1]["review_count"], out[1]["phone"], out[1]["address"], out[1]["website"]) == ("A", None, None, None, "5 Elm St", "https://a.test")
    assert not out[2]["valid"] and out[2]["reason"] and out[2]["rating"] is None and not out[3]["valid"]
    assert (out[4]["rating"], out[4]["review_count"], out[4]["phone"], out[4]["website"]) == (1.0, 7, "030 1", None)


def test_no_cards(spark):
    assert listings.card_leads(card(spark), "id").count() == 0


def test_rules_are_dealt_to_tasks(spark):
    cards = card(spark, {"title": "A B"}, {"title": "C D"}, {"title": "E F"}).coalesce(1)
    assert listings.card_leads(cards, "id").rdd.getNumPartitions() > 1


def test_enrichment_is_dealt_to_tasks(spark):
    from leadloom.operators import assembly
    from leadloom.plans import assembling

    webs = assembling.web_leads(spark, "/root/testdata/sf0.001")
    assert webs.count() == webs.select("site").distinct().count() == 199
    rows = spark.createDataFrame([(i, i % 3, "A") for i in range(20)], "seq long, site long, company_name string").coalesce(1)
    out = assembly.enrich(rows, webs, "site")
    assert out.rdd.getNumPartitions() > 1 and out.count() == 20
