"""Leads from the cards and the detail panels of a listing page, as Columns over rows of their texts.

A card's row texts are split into parts that are read from left to right: what a part may be depends on what the parts
before it were, so the parts are folded into a state by aggregate(). A panel has several candidates for each field, in
order of trust: the first that its field's rule accepts wins, and `phone_from` and `website_from` tell which it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.listing import coordinates, is_identity_match, is_internal_url, parse_address, phone_from_text, place_id, resolve_website, sanitize_url
from ..functions.text import LEFT, PLUS_CODE, RIGHT, STATUS, _price, _rating, _ui, clean_address, clean_unicode, is_noise, is_plus_code, is_price_text, is_rating_text, is_ui_title, is_website_text, js_trim, let, matches, number, opening_status, or_null, sanitize_field, strip_prefix, truthy
from ..sources.storage import dealt

PHONE = r"(\+?\d[\d\-\s().]{6,}\d)"
STATE = LEFT + STATUS + RIGHT
SERVICE = r"^(dine-in|takeaway|delivery|in-store pickup|curbside pickup|drive-through)$"
PAIR, RATING, REVIEWS = r"^(\d\.\d)\s*\(([\d,]+)\)$", r"^(\d\.\d)$", r"^\(([\d,]+)\)$"
FIELDS = ("company_name", "category", "business_type", "address", "city", "region", "country", "postal_code", "phone", "website", "rating", "review_count", "opening_status", "booking_url", "ordering_url", "menu_url", "source_url", "place_id", "latitude", "longitude", "price_range", "extraction_mode")
_KINDS = {"rating": "double", "review_count": "long", "latitude": "double", "longitude": "double"}


def shown(c: Column) -> Column:
    """A part's visible text: cleaned, null if there is none."""
    return or_null(clean_unicode(c, boxes=False))


def validated(leads: DataFrame) -> DataFrame:
    """Leads with FIELDS (missing ones are null) cleaned by each field's rule, and `valid` and `reason`: a lead without a
    business name has neither fields nor place. Ratings are 1 to 5, reviews whole and not negative."""
    df = leads.withColumns({c: F.lit(None).cast(_KINDS.get(c, "string")) for c in FIELDS if c not in leads.columns})
    # What several fields' rules look at is a column of its own, so that it is computed once for a lead.
    df = df.withColumns({"valid": ~is_ui_title(F.col("company_name")), "_status": opening_status(F.col("opening_status")), "_category": sanitize_field(F.col("category"))})
    name, valid, status = clean_unicode(F.col("company_name")), F.col("valid"), F.col("_status")
    kept = lambda c: let(clean_unicode(F.col(c)), lambda t: F.when((t != "") & ~is_noise(t), t))
    rating, reviews = F.col("rating").cast("double"), F.col("review_count").cast("double")
    whole = let(js_trim(F.col("postal_code").cast("string")), lambda t: F.when((t != "") & ~is_noise(t), t))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    clean = {
        "company_name": name, "opening_status": status, "address": clean_address(F.col("address"), status), "category": F.col("_category"), "business_type": sanitize_field(F.coalesce(or_null(F.col("business_type")), F.col("_category"))),
        **{c: sanitize_field(F.col(c)) for c in ("city", "region", "country")}, "postal_code": whole, "phone": kept("phone"), "rating": F.when(rating.between(1.0, 5.0), rating), "review_count": F.when(finite(reviews) >= 0, F.floor(reviews).cast("long")),
        **{c: sanitize_url(F.col(c)) for c in ("website", "booking_url", "ordering_url", "menu_url", "source_url")}, "price_range": let(clean_unicode(F.col("price_range")), lambda t: F.when(is_price_text(t), t)),
        "latitude": finite(F.col("latitude").cast("double")), "longitude": finite(F.col("longitude").cast("double")), "place_id": F.col("place_id"), "extraction_mode": F.col("extraction_mode"),
    }
    clean = {c: F.when(valid, x) for c, x in clean.items()}
    return df.withColumns(clean | {"reason": F.when(~valid, F.lit("Invalid or blacklisted UI title"))}).drop("_status", "_category")


def _location(address: Column) -> Column:
    return let(address, lambda a: F.when(a.isNotNull(), parse_address(a)))


# cards ---------------------------------------------------------------------------------------------------------------


def qualified(cards: DataFrame) -> DataFrame:
    """Cards (title, link_label, card_label, in_panel) with `name` and `why_not`: null for a business's card."""
    raw = F.coalesce(shown(F.col("title")), or_null(F.col("link_label")), or_null(F.col("card_label")))
    name = clean_unicode(raw, boxes=False)
    out = cards.withColumn("name", F.when(raw.isNotNull() & ~F.coalesce("in_panel", F.lit(False)), name))
    why = F.when(F.coalesce("in_panel", F.lit(False)), "Inside active detail panel").when(raw.isNull(), "Missing company title").when(is_ui_title(name), F.concat(F.lit('UI element blacklisted title: "'), name, F.lit('"')))
    return out.withColumn("why_not", why)


def card_status(rows: Column) -> Column:
    """The first opening state in a card's row texts."""
    found = F.filter(F.transform(F.coalesce(rows, F.array().cast("array<string>")), lambda r: F.regexp_extract(clean_unicode(r, boxes=False), f"(?i){STATE}", 0)), lambda x: x != "")
    return or_null(clean_unicode(F.get(found, F.lit(0)), boxes=False))


def _facts(part: Column, name: Column) -> Column:
    """What a part could be, whatever came before it."""
    get = lambda pattern, i: or_null(F.regexp_extract(part, pattern, i))
    count = lambda x: F.regexp_replace(x, r"\D", "").try_cast("double")
    known = let(clean_unicode(part), lambda t: F.struct(_price(t).alias("price"), _rating(t).alias("rating"), (_ui(t) | matches(t, LEFT + PLUS_CODE + RIGHT)).alias("other")))
    return let(known, lambda k: let(~k["rating"] & ~k["price"] & ~k["other"], lambda text: F.struct(
        part.alias("part"), get(PAIR, 1).cast("double").alias("both"), count(get(PAIR, 2)).alias("of"), get(RATING, 1).cast("double").alias("rating"), count(get(REVIEWS, 1)).alias("reviews"), k["price"].alias("price"), or_null(js_trim(get(PHONE, 1))).alias("phone"),
        (matches(part, STATE) | matches(part, SERVICE)).alias("skip"), text.alias("text"), (text & ~part.rlike(r"\d") & (F.length(part) < 50)).alias("short"), (part == name).alias("named"),
    )))


def _read(state: Column, p: Column) -> Column:
    """The state after a part: it goes to the first slot that it fits and that is empty (a zero is no rating or count)."""
    no = lambda c: state[c].isNull()
    zero = lambda c: no(c) | (state[c] == 0)
    pair = (zero("rating") | zero("reviews")) & p["both"].isNotNull()
    kind = (
        F.when(pair, "pair").when(zero("rating") & p["rating"].isNotNull(), "rating").when(zero("reviews") & p["reviews"].isNotNull(), "reviews").when(no("price") & p["price"], "price")
        .when(no("phone") & p["phone"].isNotNull(), "phone").when(p["skip"] | ~p["text"], "none").when(no("category") & p["short"], "category").when(no("address") & ~F.coalesce(p["part"] == state["category"], F.lit(False)) & ~p["named"], "address").otherwise("none")
    )
    return let(kind, lambda k: F.struct(
        F.when((k == "pair") & zero("rating"), p["both"]).when(k == "rating", p["rating"]).otherwise(state["rating"]).alias("rating"), F.when((k == "pair") & zero("reviews"), p["of"]).when(k == "reviews", p["reviews"]).otherwise(state["reviews"]).alias("reviews"),
        F.when(k == "price", p["part"]).otherwise(state["price"]).alias("price"), F.when(k == "phone", p["phone"]).otherwise(state["phone"]).alias("phone"), F.when(k == "category", p["part"]).otherwise(state["category"]).alias("category"), F.when(k == "address", p["part"]).otherwise(state["address"]).alias("address"),
    ))


def card_leads(cards: DataFrame, key: str) -> DataFrame:
    """The lead of each business's card: `key`, FIELDS. Cards have title, link_label, card_label, in_panel, href, rows
    (array of texts), rating_text, reviews_text, phone (struct href, label, text), site (struct href, text)."""
    c = qualified(dealt(cards)).where("why_not IS NULL")
    parts = F.flatten(F.transform(F.coalesce("rows", F.array().cast("array<string>")), lambda r: F.filter(F.transform(F.split(clean_unicode(r, boxes=False), "·"), lambda p: clean_unicode(p, boxes=False)), lambda p: p != "")))
    found = lambda x: or_null(js_trim(F.regexp_extract(x, PHONE, 1)))
    dialled = F.when(F.col("phone.href").startswith("tel:"), js_trim(F.regexp_replace("phone.href", "(?i)^tel:", ""))).otherwise(F.coalesce(found(F.col("phone.label")), found(clean_unicode(F.col("phone.text"), boxes=False))))
    c = c.withColumn("facts", F.transform(parts, lambda p: _facts(p, F.col("name"))))
    begin = F.struct(number(shown(F.col("rating_text"))).alias("rating"), number(shown(F.col("reviews_text"))).alias("reviews"), F.lit(None).cast("string").alias("price"), or_null(dialled).alias("phone"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("address"))
    c = c.withColumn("state", F.aggregate("facts", begin, _read)).withColumn("status", card_status(F.col("rows")))
    href, label = F.col("site.href"), shown(F.col("site.text"))
    site = F.when(matches(href, "^https?://") & is_website_text(href), js_trim(href)).when(is_website_text(label), label)
    c = c.withColumn("place", _location(clean_address(F.col("state.address"), F.col("status")))).withColumn("at", coordinates(F.col("href")))
    lead = c.select(
        key, F.col("name").alias("company_name"), F.col("href").alias("source_url"), place_id(F.col("href")).alias("place_id"), "at.latitude", "at.longitude", F.lit("result-card").alias("extraction_mode"), F.col("status").alias("opening_status"), F.col("state.rating").alias("rating"), F.col("state.reviews").alias("review_count"),
        F.col("state.price").alias("price_range"), F.col("state.category").alias("category"), F.col("state.category").alias("business_type"), F.col("state.phone").alias("phone"), site.alias("website"), *[F.col(f"place.{f}").alias(f) for f in ("address", "city", "region", "country", "postal_code")],
    )
    return validated(lead).where("valid").select(key, *FIELDS)


# panels --------------------------------------------------------------------------------------------------------------


def panel_phone(buttons: Column, others: Column) -> Column:
    """STRUCT(value, from): of the phone buttons (href, text, item, label, whole) the first text that is a phone, then of
    the other call links (href, label, whole)."""
    bare = lambda x, p: F.when(matches(x, f"^{p}"), F.regexp_replace(x, f"(?i)^{p}", ""))
    named = lambda kind, x: F.struct(F.lit(kind).alias("from"), x.alias("x"))
    texts = F.flatten(F.transform(buttons, lambda b: F.array(named("button_href", F.when(b["href"].startswith("tel:"), bare(b["href"], "tel:"))), named("button_text", js_trim(b["text"])), named("button_item", bare(b["item"], "phone:tel:")), named("button_label", b["label"]), named("button", shown(b["whole"])))))
    more = F.transform(others, lambda a: named("call_link", F.coalesce(or_null(F.regexp_replace(a["href"], "(?i)^tel:", "")), or_null(a["label"]), shown(a["whole"]))))
    every = F.concat(F.coalesce(texts, F.array().cast("array<struct<from:string,x:string>>")), F.coalesce(more, F.array().cast("array<struct<from:string,x:string>>")))
    tried = F.transform(F.filter(every, lambda c: truthy(c["x"])), lambda c: F.struct(phone_from_text(c["x"]).alias("value"), c["from"].alias("from")))
    return F.get(F.filter(tried, lambda t: t["value"].isNotNull()), F.lit(0))


def panel_website(authority: Column, labelled: Column, hrefs: Column) -> Column:
    """STRUCT(value, from): of the website button (href, text, label, whole), the links that a label calls a website, and
    all links that don't stay on the listing's own hosts, the first that is a website."""
    named = lambda kind, x: F.struct(F.lit(kind).alias("from"), x.alias("x"))
    plain = lambda x: strip_prefix(x, r"^(website:?|web site:?)\s*")
    main = F.array(named("authority_href", authority["href"]), named("authority_text", js_trim(authority["text"])), named("authority_label", plain(authority["label"])), named("authority", plain(authority["whole"])))
    link = lambda kind, xs: F.coalesce(F.transform(xs, lambda x: named(kind, x)), F.array().cast("array<struct<from:string,x:string>>"))
    every = F.filter(F.concat(main, link("labelled", labelled), link("link", F.filter(hrefs, lambda h: matches(h, "^http") & ~is_internal_url(h)))), lambda c: truthy(c["x"]))
    tried = F.transform(every, lambda c: F.struct(resolve_website(c["x"]).alias("value"), c["from"].alias("from")))
    return F.get(F.filter(tried, lambda t: t["value"].isNotNull()), F.lit(0))


def panel_leads(panels: DataFrame, key: str) -> DataFrame:
    """The lead of each detail panel whose heading is the business that was expected: `key`, FIELDS, phone_from,
    website_from. Panels have url, expected, headings (array), hours, rating_text, rating_label, reviews_text,
    reviews_label, category_text, price_text, address (struct text, label, whole), phones, calls, authority, labelled,
    hrefs (see panel_phone and panel_website), booking, ordering, menu. A panel without such a heading gives no lead."""
    expected = F.coalesce("expected", F.lit(""))
    heads = F.filter(F.transform(F.coalesce("headings", F.array().cast("array<string>")), lambda h: clean_unicode(h, boxes=False)), lambda h: ~is_ui_title(h))
    p = dealt(panels).withColumn("_name", F.get(F.filter(heads, lambda h: (expected == "") | is_identity_match(h, expected)), F.lit(0))).where("_name IS NOT NULL")
    p = p.withColumns({"_hours": shown(F.col("hours")), "_phone": panel_phone(F.col("phones"), F.col("calls")), "_site": panel_website(F.col("authority"), F.col("labelled"), F.col("hrefs")), "_at": coordinates(F.col("url"))})
    rating = F.coalesce(number(shown(F.col("rating_text"))), or_null(F.regexp_extract("rating_label", r"(\d+\.\d+)", 1)).try_cast("double"))
    reviews = F.coalesce(number(shown(F.col("reviews_text"))), F.replace(or_null(F.regexp_extract("reviews_label", r"(?i)([\d,]+)\s*reviews?", 1)), F.lit(","), F.lit("")).try_cast("double"))
    kind = let(shown(F.col("category_text")), lambda t: F.when(~is_price_text(t) & ~is_rating_text(t) & ~is_plus_code(t), t))
    price = let(shown(F.col("price_text")), lambda t: F.when(is_price_text(t), t))
    raw = F.when(F.col("address.text").isNotNull(), js_trim(F.col("address.text"))).otherwise(F.coalesce(or_null(F.col("address.label")), shown(F.col("address.whole"))))
    p = p.withColumn("_address", clean_address(strip_prefix(raw, r"^Address:\s*"), F.col("_hours"))).withColumn("_place", _location(F.col("_address")))
    http = lambda c: F.when(matches(F.col(c), "^https?://"), js_trim(F.col(c))).alias(f"{c}_url")
    lead = p.select(
        key, F.col("_name").alias("company_name"), F.lit("detail-panel").alias("extraction_mode"), F.when(sanitize_url(F.col("url")).isNotNull(), F.col("url")).alias("source_url"), place_id(F.col("url")).alias("place_id"), "_at.latitude", "_at.longitude", F.col("_hours").alias("opening_status"), rating.alias("rating"), reviews.alias("review_count"), kind.alias("category"), kind.alias("business_type"), price.alias("price_range"),
        F.col("_address").alias("address"), *[F.col(f"_place.{f}").alias(f) for f in ("city", "region", "country", "postal_code")], F.col("_phone.value").alias("phone"), F.col("_site.value").alias("website"), http("booking"), http("ordering"), http("menu"), F.col("_phone.from").alias("phone_from"), F.col("_site.from").alias("website_from"),
    )
    return validated(lead).where("valid").select(key, *FIELDS, "phone_from", "website_from")
