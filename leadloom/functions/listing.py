"""Listing-side record functions: addresses, coordinates, ids, phones, websites and names as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import dealt
from .products import blocked, each, ids, products
from .text import LEFT, MAP_URL, RIGHT, _price, _rating, _ui, clean_unicode, is_website_text, js_trim, let, matches, or_null, squeeze

POSTCODE = LEFT + r"([A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|\d{5,6}(?:-\d{4})?)" + RIGHT
INTERNAL_HOST = r"^(https?://)?([a-z0-9-]+\.)*(google\.[a-z.]+|gstatic\.com|googleusercontent\.com|ggpht\.com|goo\.gl|waze\.com)(/|$)"
# Labels of interface parts that are no phone numbers.
PHONE_LABELS = ("send to phone", "directions", "save", "nearby", "share", "add a label", "website", "menu", "reserve a table", "order online", "claim this business", "suggest an edit", "photos", "reviews", "about", "copy phone number", "copied", "call", "phone")
# Words that do not identify a business.
IDENTITY_STOP = (
    "la", "le", "el", "al", "les", "das", "der", "die", "del", "della", "de", "di", "the", "and", "or", "in", "at", "of", "to", "for", "near", "by", "on", "nr", "opp", "road", "rd", "street", "st", "cross", "circle", "highway", "express", "complex", "mall",
    "pizza", "pizzeria", "restaurant", "cafe", "coffee", "bistro", "bakery", "kitchen", "dhaba", "dining", "food", "foods", "gym", "fitness", "crossfit", "club", "studio", "center", "centre", "academy", "spa", "salon", "hotel", "inn", "suites", "resort", "motel",
    "shop", "store", "mart", "supermarket", "bazaar", "outlet", "emporium", "services", "service", "solutions", "enterprise", "agency", "firm", "associates", "pvt", "ltd", "limited", "llp", "inc", "co", "company", "corp", "corporation",
    "india", "ahmedabad", "gujarat", "gota", "satellite", "shyamal", "sg", "bopal", "thaltej", "vastrapur", "bodakdev", "prahladnagar", "navrangpura", "maninagar", "chandkheda",
)


def percent_decode(c: Column) -> Column:
    """%XX as UTF-8, + kept; null where the encoding is broken."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def parse_address(raw: Column) -> Column:
    """STRUCT(address, city, region, country, postal_code) of a comma-separated address."""
    bare = lambda x: clean_unicode(x, boxes=False)

    def without(x: Column, postal: Column) -> Column:
        at = F.position(postal, x)
        rest = F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + F.length(postal), F.length(x)))
        return or_null(F.when(F.coalesce(F.contains(x, postal), F.lit(False)), bare(rest)).otherwise(x))

    def of(clean: Column, postal: Column, parts: Column) -> Column:
        n, at = F.size(parts), lambda i: F.try_element_at(parts, F.lit(i))
        city = F.when(n <= 3, at(1)).otherwise(at(-3))
        region = F.when(n.isin(2, 3), at(2)).when(n > 3, at(-2))
        country = F.when(n >= 3, at(-1))
        ok = (clean != "") & ~_rating(clean) & ~_price(clean)
        some = ok & (n > 0)
        return F.struct(F.when(some, clean).alias("address"), F.when(some, city).alias("city"), F.when(some, without(region, postal)).alias("region"), F.when(some, without(country, postal)).alias("country"), F.when(ok, postal).alias("postal_code"))

    def split(clean: Column) -> Column:
        return F.filter(F.transform(F.split(clean, ","), bare), lambda x: (x != "") & ~_rating(x) & ~_price(x))

    return let(bare(raw), lambda c: let(F.struct(or_null(js_trim(F.regexp_extract(c, POSTCODE, 1))).alias("postal"), split(c).alias("parts")), lambda x: of(c, x["postal"], x["parts"])))


def coordinates(href: Column) -> Column:
    """STRUCT(latitude, longitude) from !3d..!4d.., else from @lat,lng."""
    pin, view = r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)", r"@(-?\d+\.\d+),(-?\d+\.\d+)"
    get = lambda i: F.coalesce(or_null(F.regexp_extract(href, pin, i)), or_null(F.regexp_extract(href, view, i))).cast("double")
    return F.struct(get(1).alias("latitude"), get(2).alias("longitude"))


def place_id(href: Column) -> Column:
    found = [or_null(F.regexp_extract(href, p, 1)) for p in (r"!19s([^!?/]+)", r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", r"place_id[:=]([A-Za-z0-9_-]+)", r"!1s([^!?/]+)")]
    return percent_decode(F.coalesce(*found))


def phone_from_text(c: Column) -> Column:
    n = lambda x: F.length(F.regexp_replace(x, r"\D", "")).between(6, 16)

    def of(t: Column) -> Column:
        bad = F.lower(t).isin(*PHONE_LABELS) | matches(t, r"^(send to phone|directions|save|nearby|share|add a label|website|menu)" + RIGHT)
        run = squeeze(F.regexp_extract(t, r"(\+?\d[\d\-\s().]{5,}\d)", 1))
        return let(run, lambda r: F.when((t != "") & ~bad & n(t) & (r != "") & n(r), r))

    return let(js_trim(F.regexp_replace(clean_unicode(c, boxes=False), r"(?i)^(phone:?|tel:?|call:?)\s*", "")), of)


def sanitize_url(c: Column) -> Column:
    """https added to bare domains; null for map addresses and hosts without a dot; no slash behind a bare host."""

    def unwrap(t: Column) -> Column:
        listed = F.regexp_extract(t, r"""(?i)(https?://[^\s"',\]]+)""", 1)
        return F.when(t.startswith("[") & t.endswith("]") & (listed != ""), listed).otherwise(t)

    def https(t: Column) -> Column:
        return F.when(matches(t, "^https?://"), t).when(matches(t, r"^([a-z0-9-]+\.)+[a-z]{2,}(/.*)?$"), F.concat(F.lit("https://"), t))

    def of(t: Column, head: Column) -> Column:
        tail = F.substring(t, F.length(head) + 1, F.length(t))
        tail = let(tail, lambda x: F.when((x == "") | (x == "/"), F.lit("")).when(x.rlike("^[?#]"), F.concat(F.lit("/"), x)).otherwise(x))
        return F.when(~matches(t, MAP_URL) & (head != "") & F.contains(head, F.lit(".")), F.concat(head, tail))

    full = let(js_trim(c), lambda t: let(unwrap(t), https))
    return let(full, lambda t: let(F.lower(F.regexp_extract(t, r"(?i)^(https?://[^/?#]+)", 1)), lambda h: of(t, h)))


def is_internal_url(c: Column) -> Column:
    return c.isNull() | matches(js_trim(c), INTERNAL_HOST)


def resolve_website(c: Column) -> Column:
    def unwrap(raw: Column) -> Column:
        target = or_null(percent_decode(F.regexp_extract(raw, r"[?&]q=([^&#]*)", 1)))
        return F.when(F.contains(raw, F.lit("/url?")) & F.contains(raw, F.lit("q=")), F.coalesce(target, raw)).otherwise(raw)

    def of(raw: Column) -> Column:
        bare = F.regexp_replace(clean_unicode(raw, boxes=False), r"(?i)^(https?://)?(www\.)?", "")
        bad = is_internal_url(raw) | F.contains(raw, F.lit("...")) | let(bare, lambda t: _ui(t) | _rating(t) | _price(t))
        clean = let(sanitize_url(raw), lambda t: F.when(~is_internal_url(t), t))
        plain = F.when(is_website_text(raw), F.concat(F.lit("https://"), F.regexp_replace(raw, r"(?i)^https?://", "")))
        return F.when((raw != "") & ~bad, F.coalesce(clean, plain))

    return let(js_trim(c), lambda t: let(unwrap(t), of))


def query_from_url(c: Column) -> Column:
    take = lambda kind: or_null(js_trim(F.try_url_decode(F.regexp_extract(c, rf"/maps/{kind}/([^/@?]+)", 1))))
    return F.coalesce(take("search"), take("place"))


def _core(c: Column) -> Column:
    clean = squeeze(F.regexp_replace(F.regexp_replace(F.lower(clean_unicode(c, boxes=False)), "['\"’]", ""), "[^a-z0-9]", " "))
    words = lambda t: F.filter(F.split(t, " "), lambda w: (F.length(w) >= 2) & ~w.isin(*IDENTITY_STOP))
    return let(clean, lambda t: F.struct(t.alias("clean"), words(t).alias("words"), F.array_join(words(t), " ").alias("core")))


def _same(a: Column, b: Column) -> Column:
    """Whether names of which _core() made a and b mean the same."""
    x, y = a["words"], b["words"]
    p, q = F.try_element_at(x, F.lit(1)), F.try_element_at(y, F.lit(1))
    common, least = F.size(F.filter(x, lambda w: F.array_contains(y, w))), F.least(F.size(x), F.size(y))
    first = (p == q) | F.contains(p, q) | F.contains(q, p)
    overlap = F.when(least == 1, common == 1).otherwise(common >= F.ceil(least * 0.6))
    inside = F.contains(a["core"], b["core"]) | F.contains(b["core"], a["core"])
    return (a["clean"] == b["clean"]) | F.when(least > 0, inside | (first & overlap)).otherwise(F.lit(False))


def is_identity_match(actual: Column, expected: Column) -> Column:
    """Whether two business names mean the same: equal, or equal, contained or overlapping distinctive words."""
    both = let(F.struct(_core(actual).alias("a"), _core(expected).alias("b")), lambda s: _same(s["a"], s["b"]))
    return F.coalesce((actual != "") & (expected != "") & both, F.lit(False))


def _packs(names: DataFrame, key: str, id_: str, name: str, out: str) -> DataFrame:
    """(key, out): a key's ids in blocks, and in each by name, with what the rule looks at (null for none)."""
    core = F.when(F.col("name") != "", _core(F.col("name"))).alias("core")
    of = blocked(names.select(key, F.col(id_).alias("id"), F.col(name).alias("name")), key).groupBy(key, "block", "name").agg(ids().alias("ids"))
    return of.select(key, "block", F.struct(core, "ids").alias("of")).groupBy(key, "block").agg(F.collect_list("of").alias(out)).select(key, out)


def identity_pairs(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(a, b, same): all pairs of `actual` (a, x) and `expected` (b, y) with one key, and whether their names x and y mean
    the same. Blocks of ids meet on the key and are dealt to tasks; a name is cleaned once a block and judged once for two
    blocks, and only the last step, which shuffles nothing, makes as many rows as there are pairs."""
    tiles = dealt(_packs(actual, key, "a", "x", "xs").join(_packs(expected, key, "b", "y", "ys"), key).select("xs", "ys"))
    names = tiles.select("ys", each(F.col("xs")).alias("x")).select("x", F.explode("ys").alias("y"))
    same = F.coalesce(_same(F.col("x.core"), F.col("y.core")), F.lit(False))
    return products(names.select(F.col("x.ids").alias("a"), F.col("y.ids").alias("b"), same.alias("same")), "a", "b").select("a", "b", "same")
