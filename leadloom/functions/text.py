"""Text helpers and listing-side predicates as Columns.

Whitespace and word borders follow the rules of the extraction contract: whitespace includes the Unicode blanks, word
borders are ASCII. A missing value is null; predicates of a missing value are false unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s ﻿  -     　]"
# The same class where it is searched for: ordinary letters are told apart first, by two ranges and not by every blank.
BLANK, ODD = rf"[\x00-\x20\x80-\uFFFF&&{WS}]", rf"[\x00-\x1F\x80-\uFFFF&&{WS}]"
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # ASCII word borders beside a word character

# Titles of user-interface parts that are no business names.
UI_TITLES = ("results", "search", "filters", "all filters", "nearby", "directions", "save", "share", "send to phone", "menu", "reviews", "overview", "about", "more", "back", "next", "showing results", "search instead for", "loading", "map options", "layers", "copy address", "copied")
UI_PREFIX = r"^(showing results|search instead for|results for|copy address|copied)(?![A-Za-z0-9_])"
# Patterns of opening states, plus codes, map addresses, domains, ratings and prices.
STATUS = r"(open\s*soon|closed\s*·\s*opens|closes\s*\d{1,2}(:\d{2})?\s*(am|pm)?|opens\s*\d{1,2}(:\d{2})?\s*(am|pm)?|open|closed|temporarily\s*closed|permanently\s*closed)"
PLUS_CODE = r"[2-9CFGHJKMPQRVWX0-9]{4,7}\+[2-9CFGHJKMPQRVWX0-9]{2,4}"
MAP_URL = r"(google\.[^/]+/maps|maps\.google\.|goo\.gl/maps)"
DOMAIN_TEXT = r"^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(/.*)?$"
POSTAL_ONLY = r"^\d{5,6}(-\d{4})?$"
RATINGS = (r"^\d(\.\d)?\s*\([\d,]+\s*(reviews?)?\)$", r"^\d\.\d$", r"^\([\d,]+\s*(reviews?)?\)$", r"^[\d,]+\s*reviews?$", r"^\d(\.\d)?\s*stars?$", LEFT + r"\d\.\d\s*\([\d,]+\)", r"^\d{1,4}$")
CURRENCY = "$€£¥₹"
PRICES = (rf"^[{CURRENCY}\s]+$", rf"^[{CURRENCY}\s]*\d+[\d–\s\-,.]*$", rf"^[{CURRENCY}]\d+([–\-]\d+)?$", rf"(?<=[A-Za-z0-9_])[{CURRENCY}]\d+[\d–\s\-,.]*(?<=[0-9])(?![A-Za-z0-9_])")
SERVICES = r"^(brunch|dinner|lunch|breakfast|dine-in|takeout|delivery|drive-through|in-store pickup)$"
DESCRIPTIVE = LEFT + r"(chain|known|pizza|restaurant|food|shop|store|service|family|friendly|cozy|casual|popular|serving|located)" + RIGHT


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: keeps plans small where a rule looks at a cleaned text many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of whitespace as one blank, none at the ends. A single blank is no run that must be replaced."""
    return js_trim(F.regexp_replace(c, f"{ODD}{BLANK}*| {BLANK}+", " "))


def nonblank(c: Column) -> Column:
    return F.coalesce(F.length(js_trim(c)) > 0, F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def or_null(c: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(c, F.lit(""))


def round3(c: Column) -> Column:
    """Half up at three places, as the scores are defined."""
    return F.floor(c * 1000 + 0.5) / 1000


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.coalesce(c.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def any_match(c: Column, patterns) -> Column:
    return reduce(lambda a, b: a | b, [matches(c, p) for p in patterns])


def clean_unicode(c: Column, boxes: bool = True) -> Column:
    """Without replacement marks, stars and (boxes) squares; blanks squeezed. Null gives an empty string."""
    marks = r"[\u2000-\uFFFF&&[�★⭐□]]" if boxes else r"[\u2000-\uFFFF&&[�★⭐]]"
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), marks, ""))


def is_plus_code(c: Column) -> Column:
    return matches(clean_unicode(c), LEFT + PLUS_CODE + RIGHT)


def _ui(t: Column) -> Column:
    return let(F.lower(t), lambda x: (x == "") | x.isin(*UI_TITLES) | matches(x, UI_PREFIX))


def _rating(t: Column) -> Column:
    return ~matches(t, POSTAL_ONLY) & any_match(t, RATINGS)


def _price(t: Column) -> Column:
    return matches(t, f"[{CURRENCY}]") & any_match(t, PRICES)


def _noise(t: Column) -> Column:
    return matches(t, LEFT + PLUS_CODE + RIGHT) | _rating(t) | _price(t)


def is_ui_title(c: Column) -> Column:
    """True for a missing title too."""
    return _ui(clean_unicode(c))


def is_rating_text(c: Column) -> Column:
    return let(clean_unicode(c), _rating)


def is_price_text(c: Column) -> Column:
    return let(clean_unicode(c), _price)


def is_noise(c: Column) -> Column:
    return let(clean_unicode(c), _noise)


def is_website_text(c: Column) -> Column:
    return let(clean_unicode(c), lambda t: (t != "") & ~matches(t, MAP_URL) & ~_noise(t) & ~_ui(t) & matches(t, DOMAIN_TEXT))


def opening_status(c: Column) -> Column:
    good = lambda t: (t != "") & (F.length(t) <= 60) & ~matches(t, SERVICES) & ~matches(t, DESCRIPTIVE) & matches(t, LEFT + STATUS + RIGHT)
    return let(clean_unicode(c), lambda t: F.when(good(t), t))


def sanitize_field(c: Column) -> Column:
    return let(clean_unicode(c), lambda t: F.when((t != "") & ~_noise(t) & ~_ui(t), t))


def clean_address(c: Column, status: Column | None = None) -> Column:
    def ends(s: Column) -> Column:
        return js_trim(F.regexp_replace(F.regexp_replace(s, f"(?i){STATUS}$", ""), r"[\s,·\-]+$", ""))

    def cut(t: Column) -> Column:
        if status is None:
            return t
        has = truthy(status) & F.endswith(F.lower(t), F.lower(status))
        return F.when(has, js_trim(F.substring(t, F.lit(1), F.length(t) - F.length(status)))).otherwise(t)

    t = F.regexp_replace(clean_unicode(c), r"(?i)^(copy address|address:?|location:?)\s*", "")
    t = js_trim(F.regexp_replace(t, r"(?i)\s*(copy address|copied)$", ""))
    return let(t, lambda t: let(ends(cut(t)), lambda s: F.when(~((t == "") | _noise(t) | _ui(t)) & (s != "") & ~_noise(s), s)))


def number(c: Column) -> Column:
    """The digits and dots of a text as a number, null if they are none."""
    return or_null(F.regexp_replace(c.cast("string"), r"[^\d.]", "")).try_cast("double")


def strip_prefix(c: Column, pattern: str) -> Column:
    return or_null(js_trim(F.regexp_replace(clean_unicode(c, boxes=False), f"(?i){pattern}", "")))


def normalize_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['\"’]", ""), "[^a-z0-9]", " "))


def normalize_query(c: Column) -> Column:
    return squeeze(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("+"), F.lit(" "))))


def slug(c: Column, missing: str = "google-maps", longest: int = 40) -> Column:
    """A file name's part: lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends, cut to a length."""
    t = F.when(truthy(c), F.lower(c)).otherwise(F.lit(missing))
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)
