"""Queries of listing cards and detail panels, and their SQL, which reads a card's parts by list_reduce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import listing, text
from ..operators import listings
from . import duck
from .inputs import rows
from .registry import query

C = F.col
#: A card of each part: odd titles, rows of parts that could be several things, phones and sites in several places.
CARDS = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Results' WHEN 2 THEN '' ELSE '★ ' || p_name || '  ' || p_brand END AS title, CASE p_partkey % 9 WHEN 0 THEN 'Label ' || p_brand WHEN 2 THEN CASE WHEN p_partkey % 4 = 1 THEN 'Shop ' || p_brand END END AS link_label, CAST(NULL AS STRING) AS card_label, p_partkey % 13 = 5 AS in_panel,
  CASE p_partkey % 4 WHEN 0 THEN 'https://m.test/maps/place/A/@12.' || CAST(100 + p_partkey % 800 AS STRING) || ',-77.5,17z/data=!19sChIJ' || CAST(p_partkey % 97 AS STRING) WHEN 1 THEN 'https://m.test/x?place_id=ab-' || CAST(p_partkey % 77 AS STRING) WHEN 2 THEN 'https://m.test/data=!3d10.5!4d-20.25' END AS href,
  CASE p_partkey % 6 WHEN 0 THEN '4.5 (1,234)' WHEN 1 THEN '4.2' WHEN 2 THEN '(87)' WHEN 3 THEN '3.9(12) · 4.1 (99)' WHEN 4 THEN '' ELSE '0.0 (3)' END || ' · ' || CASE p_partkey % 5 WHEN 0 THEN '$$' WHEN 1 THEN '₹200–400' WHEN 2 THEN p_type WHEN 3 THEN 'Bakery' ELSE '€15 - 30' END
  || '~' || CASE p_partkey % 7 WHEN 0 THEN 'Dental clinic · 12 Main Road, Pune, 411001' WHEN 1 THEN 'Cafe · Open' WHEN 2 THEN p_type || ' · 2FXQ+9R Ahmedabad · 5 Elm St, Ulm, SW1A 1AA, UK Closed' WHEN 3 THEN 'Directions · Website' WHEN 4 THEN 'Bakery · Bakery · 380057' WHEN 5 THEN '' ELSE '7 Oak Ave, Lyon · A very long description of what this place has to offer to people who like it' END
  || '~' || CASE p_partkey % 8 WHEN 0 THEN 'Open · Closes 10 pm' WHEN 1 THEN 'Closed · Opens 9 AM · +91 79 4000 1234' WHEN 2 THEN 'Dine-in · Takeaway · delivery' WHEN 3 THEN '(415) 555-0100 · 020 7946 0123' WHEN 4 THEN 'Temporarily closed' WHEN 5 THEN 'Opens soon' WHEN 6 THEN '' ELSE '3 Reviews · 44' END AS lines,
  CASE WHEN p_partkey % 10 = 3 THEN '4.8 stars' WHEN p_partkey % 10 = 4 THEN 'none' END AS rating_text, CASE WHEN p_partkey % 10 = 3 THEN '(2,001)' END AS reviews_text,
  CASE WHEN p_partkey % 11 = 1 THEN 'tel:+1 415 555 0' || CAST(100 + p_partkey % 900 AS STRING) END AS tel_href, CASE WHEN p_partkey % 11 = 2 THEN 'Phone: 079 4000 1234 now' WHEN p_partkey % 11 = 1 THEN 'Phone: 99' END AS tel_label, CASE WHEN p_partkey % 11 = 3 THEN 'call 030 1234567' END AS tel_text,
  CASE p_partkey % 12 WHEN 0 THEN 'https://shop' || CAST(p_partkey % 50 AS STRING) || '.test/' WHEN 1 THEN 'https://maps.google.com/x' WHEN 2 THEN '/menu' END AS site_href, CASE p_partkey % 12 WHEN 1 THEN 'Shop.example.org' WHEN 2 THEN 'Website' WHEN 3 THEN 'www.b' || CAST(p_partkey % 9 AS STRING) || '.test' END AS site_text
FROM {part}
"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    phone = F.struct(C("tel_href").alias("href"), C("tel_label").alias("label"), C("tel_text").alias("text"))
    return rows(spark, d, CARDS).withColumns({"rows": F.split("lines", "~"), "phone": phone, "site": F.struct(C("site_href").alias("href"), C("site_text").alias("text"))})


_shown = lambda x: duck.nz(duck.clean(x, False))
_RAW = f"coalesce({_shown('title')}, nullif(link_label, ''), nullif(card_label, ''))"
_QUALIFIED = f"SELECT *, CASE WHEN raw IS NOT NULL AND NOT in_panel THEN {duck.clean('raw', False)} END AS name, CASE WHEN in_panel THEN 'Inside active detail panel' WHEN raw IS NULL THEN 'Missing company title' WHEN {duck.ui_title(duck.clean('raw', False))} THEN 'UI element blacklisted title: \"' || {duck.clean('raw', False)} || '\"' END AS why_not FROM (SELECT *, {_RAW} AS raw FROM ({CARDS}) c) q"
_ROWS = "string_split(lines, '~')"
_STATE = duck.quoted("(?i)" + duck.re2(listings.STATE))
_STATUS = f"nullif({duck.clean(f'''list_filter(list_transform({_ROWS}, lambda r: regexp_extract({duck.clean('r', False)}, {_STATE}, 0)), lambda x: x <> '')[1]''', False)}, '')"


def address(x: str, status: str) -> str:
    """duck.address with an opening state that the address may end with."""
    t = duck.trim(duck.sub(duck.sub(duck.clean(x), r"^(copy address|address:?|location:?)\s*", ci=True), r"\s*(copy address|copied)$", ci=True))
    u = f"CASE WHEN coalesce({status}, '') <> '' AND ends_with(lower({t}), lower({status})) THEN {duck.trim(f'left({t}, length({t}) - length({status}))')} ELSE {t} END"
    s = duck.trim(duck.sub(duck.sub(u, f"{text.STATUS}$", ci=True), r"[\s,·\-]+$"))
    return f"CASE WHEN NOT ({t} = '' OR {duck.noise(t)} OR {duck.ui_title(t)}) AND {s} <> '' AND NOT {duck.noise(s)} THEN {s} END"


def _kept(x: str) -> str:
    return f"CASE WHEN {duck.clean(x)} <> '' AND NOT {duck.noise(x)} THEN {duck.clean(x)} END"


def place_sql(source: str) -> str:
    """A table with cleaned `addr`, and its city, region, country and postal code."""
    part = f"list_filter(list_transform(string_split(clean, ','), lambda x: {duck.clean('x', False)}), lambda x: x <> '' AND NOT {duck.rating('x')} AND NOT {duck.price('x')})"
    strip = lambda x: f"CASE WHEN contains({x}, postal) THEN nullif({duck.clean(f'''substr({x}, 1, strpos({x}, postal) - 1) || substr({x}, strpos({x}, postal) + length(postal))''', False)}, '') ELSE {x} END"
    a = f"SELECT *, {duck.clean('addr', False)} AS clean, nullif(trim(regexp_extract({duck.clean('addr', False)}, {duck.quoted(duck.re2(listing.POSTCODE))}, 1)), '') AS postal FROM ({source}) a"
    b = f"SELECT *, {part} AS aparts, len({part}) AS n, addr IS NOT NULL AND clean <> '' AND NOT {duck.rating('clean')} AND NOT {duck.price('clean')} AS ok FROM ({a}) b"
    c = f"SELECT *, CASE WHEN n <= 3 THEN aparts[1] ELSE aparts[n - 2] END AS city0, CASE WHEN n IN (2, 3) THEN aparts[2] WHEN n > 3 THEN aparts[n - 1] END AS region0, CASE WHEN n >= 3 THEN aparts[n] END AS country0 FROM ({b}) c"
    return f"SELECT *, CASE WHEN ok AND n > 0 THEN clean END AS address1, CASE WHEN ok AND n > 0 THEN city0 END AS city1, CASE WHEN ok AND n > 0 THEN {strip('region0')} END AS region1, CASE WHEN ok AND n > 0 THEN {strip('country0')} END AS country1, CASE WHEN ok THEN postal END AS postal1 FROM ({c}) d"


def _cards_sql() -> str:
    num = lambda x: f"try_cast(nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '') AS DOUBLE)"
    get = lambda pattern, i: f"nullif(regexp_extract(p, {duck.quoted(pattern)}, {i}), '')"
    word = f"(NOT {duck.rating('p')} AND NOT {duck.price('p')} AND NOT {duck.ui_title('p')} AND NOT {duck.plus_code('p')})"
    tel = lambda x: f"nullif(trim(regexp_extract({x}, {duck.quoted(listings.PHONE)}, 1)), '')"
    facts = f"list_transform(parts, lambda p: {{'p': p, 'both': try_cast({get(listings.PAIR, 1)} AS DOUBLE), 'of': {num(get(listings.PAIR, 2))}, 'r': try_cast({get(listings.RATING, 1)} AS DOUBLE), 'c': {num(get(listings.REVIEWS, 1))}, 'price': {duck.price('p')}, 'tel': {tel('p')}, 'skip': {duck.has('p', listings.STATE)} OR {duck.has('p', listings.SERVICE)}, 'word': {word}, 'short': {word} AND NOT regexp_matches(p, '[0-9]') AND length(p) < 50, 'named': p = name}})"
    parts = f"list_filter(flatten(list_transform({_ROWS}, lambda r: list_transform(string_split({duck.clean('r', False)}, '·'), lambda p: {duck.clean('p', False)}))), lambda p: p <> '')"
    zr, zc = "coalesce(s.r, 0) = 0", "coalesce(s.c, 0) = 0"
    kind = f"CASE WHEN ({zr} OR {zc}) AND f.both IS NOT NULL THEN 'pair' WHEN {zr} AND f.r IS NOT NULL THEN 'r' WHEN {zc} AND f.c IS NOT NULL THEN 'c' WHEN s.pr IS NULL AND f.price THEN 'pr' WHEN s.ph IS NULL AND f.tel IS NOT NULL THEN 'ph' WHEN f.skip OR NOT f.word THEN '' WHEN s.cat IS NULL AND f.short THEN 'cat' WHEN s.ad IS NULL AND NOT coalesce(f.p = s.cat, false) AND NOT f.named THEN 'ad' ELSE '' END"
    step = f"list_transform([{kind}], lambda k: {{'r': CASE WHEN k = 'pair' AND {zr} THEN f.both WHEN k = 'r' THEN f.r ELSE s.r END, 'c': CASE WHEN k = 'pair' AND {zc} THEN f.of WHEN k = 'c' THEN f.c ELSE s.c END, 'pr': CASE WHEN k = 'pr' THEN f.p ELSE s.pr END, 'ph': CASE WHEN k = 'ph' THEN f.tel ELSE s.ph END, 'cat': CASE WHEN k = 'cat' THEN f.p ELSE s.cat END, 'ad': CASE WHEN k = 'ad' THEN f.p ELSE s.ad END}})[1]"
    dial = f"CASE WHEN starts_with(tel_href, 'tel:') THEN nullif(trim(substr(tel_href, 5)), '') ELSE coalesce({tel('tel_label')}, {tel(duck.clean('tel_text', False))}) END"
    begin = f"{{'r': {duck.number(_shown('rating_text'))}, 'c': {duck.number(_shown('reviews_text'))}, 'pr': NULL::VARCHAR, 'ph': {dial}, 'cat': NULL::VARCHAR, 'ad': NULL::VARCHAR}}"
    one = f"SELECT *, list_reduce({facts}, lambda s, f: {step}, {begin}) AS state, {_STATUS} AS status FROM (SELECT *, {parts} AS parts FROM ({_QUALIFIED}) q WHERE why_not IS NULL) r"
    site = f"CASE WHEN {duck.has('site_href', '^https?://')} AND {duck.website_text('site_href')} THEN trim(site_href) WHEN {duck.website_text(_shown('site_text'))} THEN {_shown('site_text')} END"
    two = place_sql(f"SELECT *, {address('state.ad', 'status')} AS addr, {duck.status('status')} AS status1, {site} AS site FROM ({one}) o")
    return f"""SELECT id, {duck.clean('name')} AS company_name, {duck.field('state.cat')} AS category, CASE WHEN address1 IS NOT NULL THEN {address('address1', 'status1')} END AS address, {duck.field('city1')} AS city, {duck.field('region1')} AS region, {duck.field('country1')} AS country, {_kept('postal1')} AS postal_code, {_kept('state.ph')} AS phone, {duck.sanitize_url('site')} AS website,
    CASE WHEN state.r BETWEEN 1 AND 5 THEN state.r END AS rating, floor(state.c)::BIGINT AS review_count, status1 AS opening_status, {duck.sanitize_url('href')} AS source_url, {duck.place_id('href')} AS place_id, {duck.coordinate('href', 1)} AS latitude, CASE WHEN {duck.price('state.pr')} THEN {duck.clean('state.pr')} END AS price_range FROM ({two}) t"""


_CARD = ("id", "company_name", "category", "address", "city", "region", "country", "postal_code", "phone", "website", "rating", "review_count", "opening_status", "source_url", "place_id", "latitude", "price_range")
query("card_qualified", lambda s, d: listings.qualified(cards(s, d)).select("id", "name", "why_not"), f"SELECT id, name, why_not FROM ({_QUALIFIED}) q")
query("card_status", lambda s, d: cards(s, d).select("id", listings.card_status(C("rows")).alias("status")), f"SELECT id, {_STATUS} AS status FROM ({CARDS}) c")
query("card_leads", lambda s, d: listings.card_leads(cards(s, d), "id").select(*_CARD), _cards_sql())

#: A panel of each customer: headings, hours, and for phone and website several candidates, each alone or before others.
PANELS = """
SELECT c_custkey AS id, 'https://m.test/maps/place/x/@1.5,2.25/data=!19sP' || CAST(c_custkey % 99 AS STRING) AS url, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'Blue River ' || n_name ELSE 'Milano Oven' END AS expected,
  CASE c_custkey % 5 WHEN 0 THEN 'Results~Blue River ' || n_name WHEN 1 THEN 'Milano Oven House~Blue River' WHEN 2 THEN '' WHEN 3 THEN 'Milano Oven~x' ELSE '★ ' || c_name END AS heads,
  CASE c_custkey % 6 WHEN 0 THEN 'Open ' WHEN 1 THEN 'Closed · Opens 9 AM' WHEN 2 THEN 'Popular food place, open' WHEN 3 THEN '' END AS hours, CASE WHEN c_custkey % 3 = 0 THEN '4.4' WHEN c_custkey % 3 = 1 THEN '7' END AS rating_text, CASE WHEN c_custkey % 2 = 0 THEN '3.5 stars' END AS rating_label,
  CASE WHEN c_custkey % 4 = 1 THEN '(1,234)' END AS reviews_text, CASE WHEN c_custkey % 4 > 1 THEN '2,345 Reviews' END AS reviews_label, CASE c_custkey % 5 WHEN 0 THEN 'Pizza place' WHEN 1 THEN '$$' WHEN 2 THEN '4.5' ELSE c_mktsegment END AS category_text, CASE c_custkey % 3 WHEN 0 THEN '$$' WHEN 1 THEN 'cheap' END AS price_text,
  CASE WHEN c_custkey % 5 = 0 THEN ' 5 Elm St, ' || n_name || ', 380057 Open' END AS addr_text, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'Address: 12 Main Road, Pune, 411001, India' END AS addr_label, CASE WHEN c_custkey % 5 = 2 THEN 'Copy address 7 Oak Ave, Lyon' END AS addr_whole,
  CASE c_custkey % 7 WHEN 0 THEN 'tel:+14155550' || CAST(100 + c_custkey % 900 AS STRING) WHEN 1 THEN 'tel:12' END AS b_href, CASE WHEN c_custkey % 7 IN (1, 2) THEN ' 079 4000 1234 ' END AS b_text, CASE WHEN c_custkey % 7 = 3 THEN 'phone:tel:02079460123' END AS b_item, CASE WHEN c_custkey % 7 = 4 THEN 'Phone: (415) 555-0123' END AS b_label, CASE WHEN c_custkey % 7 = 5 THEN 'Call 030 1234567' END AS b_whole,
  CASE WHEN c_custkey % 7 = 6 THEN 'tel:030 7654321' END AS a_href, CASE c_custkey % 8 WHEN 0 THEN 'https://www.site' || CAST(c_custkey % 70 AS STRING) || '.test/' WHEN 1 THEN 'https://www.google.com/url?q=https%3A%2F%2Fw' || CAST(c_custkey % 9 AS STRING) || '.test%2F&sa=D' WHEN 2 THEN 'https://maps.google.com/x' END AS w_href,
  CASE WHEN c_custkey % 8 IN (2, 3) THEN ' shop' || CAST(c_custkey % 9 AS STRING) || '.example.org ' END AS w_text, CASE WHEN c_custkey % 8 = 4 THEN 'Website: bar.test' END AS w_label, CASE WHEN c_custkey % 8 = 5 THEN 'https://l' || CAST(c_custkey % 9 AS STRING) || '.test/home' END AS l_href, CASE WHEN c_custkey % 8 > 5 THEN 'https://maps.google.com/y~https://z' || CAST(c_custkey % 9 AS STRING) || '.test' END AS all_hrefs,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://book.test/r' END AS booking, CASE WHEN c_custkey % 3 = 1 THEN '/order' END AS ordering, CASE WHEN c_custkey % 3 = 2 THEN ' https://m.test/menu' END AS menu
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def panels(spark: SparkSession, d: str) -> DataFrame:
    s = lambda **of: F.struct(*[C(c).alias(n) for n, c in of.items()])
    return rows(spark, d, PANELS).withColumns({
        "headings": F.split("heads", "~"), "address": s(text="addr_text", label="addr_label", whole="addr_whole"), "phones": F.array(s(href="b_href", text="b_text", item="b_item", label="b_label", whole="b_whole")),
        "calls": F.array(F.struct(C("a_href").alias("href"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("whole"))), "authority": F.struct(C("w_href").alias("href"), C("w_text").alias("text"), C("w_label").alias("label"), F.lit(None).cast("string").alias("whole")), "labelled": F.array("l_href"), "hrefs": F.split("all_hrefs", "~"),
    })


def _panels_sql() -> str:
    cl = lambda x: duck.squeeze(duck.sub(duck.sub(f"lower({duck.clean(x, False)})", "['\"’]"), "[^a-z0-9]", " "))
    tok = lambda x: f"list_filter(string_split({cl(x)}, ' '), lambda w: length(w) >= 2 AND NOT {duck.within('w', listing.IDENTITY_STOP)})"
    common = "len(list_filter(z.a, lambda w: list_contains(z.b, w)))"
    same = f"list_transform([{{'a': {tok('h')}, 'b': {tok('expected')}, 'x': {cl('h')}, 'y': {cl('expected')}}}], lambda z: h <> '' AND (z.x = z.y OR CASE WHEN len(z.a) > 0 AND len(z.b) > 0 THEN contains(array_to_string(z.a, ' '), array_to_string(z.b, ' ')) OR contains(array_to_string(z.b, ' '), array_to_string(z.a, ' ')) OR ((z.a[1] = z.b[1] OR contains(z.a[1], z.b[1]) OR contains(z.b[1], z.a[1])) AND CASE WHEN least(len(z.a), len(z.b)) = 1 THEN {common} = 1 ELSE {common} >= ceil(least(len(z.a), len(z.b)) * 0.6) END) ELSE false END))[1]"
    heads = f"list_filter(list_transform(string_split(heads, '~'), lambda h: {duck.clean('h', False)}), lambda h: NOT {duck.ui_title('h')})"
    name = f"list_filter({heads}, lambda h: expected = '' OR {same})[1]"
    first = lambda pairs, rule: f"list_filter(list_transform(list_filter([{', '.join(f'''{{'f': '{f}', 'x': {x}}}''' for f, x in pairs)}], lambda c: coalesce(c.x, '') <> ''), lambda c: {{'f': c.f, 'x': {rule('c.x')}}}), lambda c: c.x IS NOT NULL)[1]"
    bare = lambda x, n: f"CASE WHEN {x[1]} THEN substr({x[0]}, {n}) END"
    tel = first([("button_href", bare(("b_href", "starts_with(b_href, 'tel:')"), 5)), ("button_text", duck.trim("b_text")), ("button_item", bare(("b_item", "starts_with(b_item, 'phone:tel:')"), 11)), ("button_label", "b_label"), ("button", _shown("b_whole")), ("call_link", "substr(a_href, 5)")], duck.phone_from_text)
    plain = lambda x: f"nullif({duck.trim(duck.sub(duck.clean(x, False), r'^(website:?|web site:?)' + chr(92) + 's*', ci=True))}, '')"
    hrefs = "string_split(all_hrefs, '~')"
    outside = f"list_filter({hrefs}, lambda h: {duck.has('h', '^http')} AND NOT {duck.internal('h')})"
    site = first([("authority_href", "w_href"), ("authority_text", duck.trim("w_text")), ("authority_label", plain("w_label")), ("labelled", "l_href"), ("link", f"({outside})[1]")], duck.resolve_website)
    raw = f"CASE WHEN addr_text IS NOT NULL THEN {duck.trim('addr_text')} ELSE coalesce(nullif(addr_label, ''), {_shown('addr_whole')}) END"
    prefix = duck.trim(duck.sub(duck.clean("raw", False), "^Address:" + r"\s*", ci=True))
    rating = f"coalesce({duck.number(_shown('rating_text'))}, try_cast(nullif(regexp_extract(rating_label, '([0-9]+[.][0-9]+)', 1), '') AS DOUBLE))"
    reviews = f"coalesce({duck.number(_shown('reviews_text'))}, try_cast(nullif(replace(regexp_extract(reviews_label, '(?i)([0-9,]+)[[:space:]]*reviews?', 1), ',', ''), '') AS DOUBLE))"
    kind = f"CASE WHEN NOT {duck.price('category_text')} AND NOT {duck.rating('category_text')} AND NOT {duck.plus_code('category_text')} THEN {_shown('category_text')} END"
    http = lambda x: f"{duck.sanitize_url(f'''CASE WHEN {duck.has(x, '^https?://')} THEN {duck.trim(x)} END''')} AS {x}_url"
    one = f"SELECT *, {_shown('hours')} AS status, {tel} AS tel, {site} AS site, {raw} AS raw FROM (SELECT *, {name} AS name FROM ({PANELS}) p) q WHERE name IS NOT NULL"
    two = place_sql(f"SELECT *, CASE WHEN raw IS NOT NULL THEN {address(prefix, 'status')} END AS addr, {duck.status('status')} AS status1 FROM ({one}) o")
    return f"""SELECT id, {duck.clean('name')} AS company_name, {duck.field(kind)} AS category, CASE WHEN addr IS NOT NULL THEN {address('addr', 'status1')} END AS address, {duck.field('city1')} AS city, {duck.field('region1')} AS region, {duck.field('country1')} AS country, {_kept('postal1')} AS postal_code, {_kept('tel.x')} AS phone, tel.f AS phone_from, {duck.sanitize_url('site.x')} AS website, site.f AS website_from,
    CASE WHEN {rating} BETWEEN 1 AND 5 THEN {rating} END AS rating, floor({reviews})::BIGINT AS review_count, status1 AS opening_status, {duck.place_id('url')} AS place_id, {duck.coordinate('url', 2)} AS longitude, CASE WHEN {duck.price('price_text')} THEN {duck.clean('price_text')} END AS price_range, {http('booking')}, {http('ordering')}, {http('menu')} FROM ({two}) t"""


_PANEL = ("id", "company_name", "category", "address", "city", "region", "country", "postal_code", "phone", "phone_from", "website", "website_from", "rating", "review_count", "opening_status", "place_id", "longitude", "price_range", "booking_url", "ordering_url", "menu_url")
query("panel_leads", lambda s, d: listings.panel_leads(panels(s, d), "id").select(*_PANEL), _panels_sql())

#: Leads as they come from a listing, with numbers out of range and texts that are something else.
RAW = """
SELECT seq, CASE WHEN seq % 12 = 7 THEN 'Showing results 5' ELSE company_name END AS company_name, opening_status, address, category, CASE WHEN seq % 4 = 0 THEN '' ELSE 'Shop ★' END AS business_type, CASE WHEN seq % 9 = 1 THEN '4.5 (12)' ELSE city END AS city, region, CASE WHEN seq % 5 = 0 THEN 'Menu' ELSE 'India' END AS country,
  CASE seq % 5 WHEN 0 THEN '$$' WHEN 1 THEN ' 380057 ' WHEN 2 THEN '12 reviews' ELSE postal_code END AS postal_code, CASE WHEN seq % 7 = 3 THEN '4.5' ELSE phone END AS phone, CAST(seq % 8 AS DOUBLE) - 1.5 AS rating, CAST(seq % 11 AS DOUBLE) - 2.5 AS review_count, website, CASE seq % 3 WHEN 0 THEN '$$' WHEN 1 THEN 'cheap' END AS price_range,
  CASE WHEN seq % 6 = 0 THEN 'book.test' ELSE 'nothing' END AS booking_url, CAST(seq % 90 AS DOUBLE) AS latitude FROM ({LEADS}) l
"""
_VALID = ("company_name", "opening_status", "address", "category", "business_type", "city", "region", "country", "postal_code", "phone", "rating", "review_count", "website", "price_range", "booking_url", "latitude")


def _valid_sql() -> str:
    made = {
        "company_name": duck.clean("company_name"), "opening_status": duck.status("opening_status"), "address": address("address", duck.status("opening_status")), "category": duck.field("category"), "business_type": duck.field(f"coalesce(nullif(business_type, ''), {duck.field('category')})"), **{c: duck.field(c) for c in ("city", "region", "country")},
        "postal_code": f"CASE WHEN {duck.trim('postal_code')} <> '' AND NOT {duck.noise('postal_code')} THEN {duck.trim('postal_code')} END", "phone": _kept("phone"), "rating": "CASE WHEN rating BETWEEN 1 AND 5 THEN rating END", "review_count": "CASE WHEN review_count >= 0 THEN floor(review_count)::BIGINT END", "website": duck.sanitize_url("website"),
        "price_range": f"CASE WHEN {duck.price('price_range')} THEN {duck.clean('price_range')} END", "booking_url": duck.sanitize_url("booking_url"), "latitude": "latitude",
    }
    bad = duck.ui_title("company_name")
    return f"SELECT seq, NOT {bad} AS valid, CASE WHEN {bad} THEN 'Invalid or blacklisted UI title' END AS reason, " + ", ".join(f"CASE WHEN NOT {bad} THEN {made[c]} END AS {c}" for c in _VALID) + f" FROM ({RAW}) r"


query("validate_lead_fields", lambda s, d: listings.validated(rows(s, d, RAW)).select("seq", "valid", "reason", *_VALID), _valid_sql())
