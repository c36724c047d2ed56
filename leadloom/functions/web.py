"""Website-side normalizers and validators as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .listing import percent_decode
from .text import LEFT, RIGHT, WS, js_trim, let, matches, nonblank, squeeze, truthy

TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "trk")
# Domains, user names and endings that decide an e-mail's class.
FREE_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "outlook.com", "live.com", "icloud.com", "aol.com", "proton.me", "protonmail.com", "zoho.com", "mail.com", "gmx.com", "yandex.com")
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "domain.com", "yourdomain.com", "email.com", "sitename.com", "mysite.com", "test.com", "sample.com", "company.com")
PLACEHOLDER_USERS = ("name", "user", "username", "email", "youremail", "yourname", "test", "demo", "placeholder", "sample", "first.last", "firstname.lastname", "john.doe")
ASSET_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "svg", "ico", "css", "js", "woff", "woff2", "ttf")
VENDOR_DOMAINS = ("sentry.io", "wixpress.com", "shopify.com", "cloudflare.com", "gravatar.com", "wordpress.org", "schema.org", "googleapis.com")
ROLES = (
    ("sales", "sales|inquiries|inquiry|enquiry|enquiries|quotes|quote|deals|newbusiness|orders|order|orderdesk|bizdev"),
    ("support", "support|help|customercare|care|service|services|billing|techsupport"),
    ("general", "info|contact|hello|office|admin|mail|general|team|feedback|frontdesk|reception"),
    ("marketing", "marketing|press|media|pr|partnerships"),
    ("careers", "careers|jobs|recruiting|recruitment|talent|hr|work"),
)
EMAIL_SYNTAX = r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+$"
EMAIL_IN_TEXT = LEFT + r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+" + RIGHT
PHONE_IN_TEXT = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}" + RIGHT
DUMMY_DIGITS = ("123456789", "987654321", "012345678", "1234567890")
COMPANY_BLACKLIST = ("home", "homepage", "welcome", "index", "about", "about us", "contact", "contact us", "our company", "official site", "untitled", "404 not found")
# Job titles, words that are no names, narrative words, and seniority tiers.
TITLE = LEFT + r"(chief\s+[a-z\s]+officer|c[eotmfpir]o|founder|co-founder|president|vice\s+president|vp|director|head\s+of\s+[a-z\s&]+|managing\s+director|partner|principal|lead|manager|architect|consultant|specialist|engineer|designer|chairperson|general\s+manager|advisor|counsel)" + RIGHT
NON_NAMES = ("about", "about us", "team", "our team", "leadership", "people", "management", "board", "advisors", "contact", "read more", "view bio", "learn more", "profile", "view profile", "meet the team", "executives", "staff", "menu", "home", "services", "products", "careers", "jobs", "join us", "blog", "news", "inc", "llc", "ltd", "corp", "corporation", "technologies", "solutions", "systems", "company", "group", "holdings")
NARRATIVE = LEFT + r"(joined|founded in|graduated|holds|brings|pioneer|serving|served|previously|experience in|career|responsible for|oversees)" + RIGHT
NAME_WORD = r"^(?:[A-ZÀ-ÖØ-ß][a-zà-öø-ÿ'.-]*|de|van|von|der|da|di|la|le|du)$"
SENIORITY = (
    (1.0, "founder|co-founder|owner|co-owner|ceo|chief executive officer|president|managing director|executive director|managing partner|principal|sole proprietor"),
    (0.90, "coo|cfo|cto|cmo|cro|cio|chief operating|chief financial|chief technology|chief marketing|chief revenue|chief information|chief medical|chief officer"),
    (0.85, "vice president|vp|svp|evp|head of|divisional head"),
    (0.80, "director|partner|general manager|practice leader|branch manager"),
    (0.65, "manager|lead|supervisor|team leader|senior"),
)
SPLITTER = rf"{WS}*[-|–—:•]{WS}*"
TITLE_LEAD = r"(?i)^(about|contact|welcome to|home of|meet)\s+"


def normalize_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def strip_html(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "))


def normalize_email(c: Column) -> Column:
    def of(t: Column) -> Column:
        t = js_trim(F.lower(F.coalesce(percent_decode(t), t)))
        return js_trim(F.substring_index(F.regexp_replace(F.regexp_replace(t, r"[.,;:!?)>\]]+$", ""), "^mailto:", ""), "?", 1))

    return let(js_trim(F.coalesce(c, F.lit(""))), of)


def normalize_phone(c: Column) -> Column:
    def of(t: Column) -> Column:
        clean = squeeze(F.regexp_replace(t, rf"[^\d+()\-.\s ]", ""))
        return let(F.regexp_replace(t, r"\D", ""), lambda d: F.when(F.length(d) < 7, F.lit("")).when(t.startswith("+"), F.concat(F.lit("+"), d)).otherwise(clean))

    return let(F.substring_index(F.regexp_replace(js_trim(F.coalesce(c, F.lit(""))), "(?i)^tel:", ""), "?", 1), of)


def normalize_domain(c: Column) -> Column:
    """Host in lower case without www.; empty where there is none."""
    t = let(js_trim(F.coalesce(c, F.lit(""))), lambda t: F.when(matches(t, "^https?://"), t).otherwise(F.concat(F.lit("https://"), t)))
    host = F.regexp_extract(t, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def normalize_url(c: Column) -> Column:
    """An absolute address without fragment and tracking parameters, host in lower case; a bare host has no slash.
    The form for addresses that need no percent-encoding; `sources.html.url_norm` has the whole rule set."""

    def absolute(t: Column) -> Column:
        return F.when(matches(t, "^https?://"), t).when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(F.concat(F.lit("https://"), t))

    def query(t: Column) -> Column:
        kept = F.filter(F.split(F.regexp_extract(t, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
        return F.array_join(F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("=")))), "&")

    def joined(head: Column, path: Column, q: Column) -> Column:
        path = F.when((path == "/") & (q == ""), F.lit("")).when((path == "") & (q != ""), F.lit("/")).otherwise(path)
        return F.when(F.length(head) < 9, F.lit("")).otherwise(F.concat(head, path, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))))

    def of(t: Column) -> Column:
        parts = F.struct(F.lower(F.regexp_extract(t, r"^([^/]+//[^/?#]*)", 1)).alias("h"), F.regexp_extract(t, r"^[^/]+//[^/?#]*([^?#]*)", 1).alias("p"), query(t).alias("q"))
        return let(parts, lambda s: joined(s["h"], s["p"], s["q"]))

    bare = js_trim(F.coalesce(c, F.lit("")))
    return F.when(matches(bare, "^(javascript|data|file|chrome|blob):"), F.lit("")).otherwise(let(F.substring_index(bare, "#", 1), lambda t: let(absolute(t), of)))


def is_email(c: Column) -> Column:
    t = js_trim(c)
    return F.coalesce(F.length(t).between(5, 254), F.lit(False)) & matches(t, EMAIL_SYNTAX, ignore_case=False)


def email_role(user: Column) -> Column:
    """Function of an address's part before the @: sales, support, general, marketing, careers or direct."""
    out = None
    for role, names in ROLES:
        hit = matches(user, f"^({names})$")
        out = F.when(hit, F.lit(role)) if out is None else out.when(hit, F.lit(role))
    return out.otherwise(F.lit("direct"))


def evaluate_email(c: Column, site: Column) -> Column:
    """STRUCT(is_valid, classification, email_role) of an address in relation to a site's domain."""
    root = js_trim(F.regexp_replace(F.lower(F.coalesce(site, F.lit(""))), r"^www\.", ""))
    return let(F.struct(c.alias("c"), root.alias("root")), lambda s: _judge(s["c"], s["root"]))


def _judge(c: Column, root: Column) -> Column:
    low = F.lower(c)
    user, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    own = (root != "") & ((domain == root) | F.endswith(domain, F.concat(F.lit("."), root)))
    role = email_role(user)
    asset = F.substring_index(domain, ".", -1).isin(*ASSET_ENDINGS) | F.substring_index(domain, ".", 1).isin(*ASSET_ENDINGS)
    kind = (
        F.when(~is_email(c), F.lit("invalid_syntax"))
        .when(asset, F.lit("asset_filename"))
        .when(domain.isin(*PLACEHOLDER_DOMAINS) | user.isin(*PLACEHOLDER_USERS), F.lit("placeholder"))
        .when(domain.isin(*VENDOR_DOMAINS), F.lit("vendor_tracker"))
        .when(domain.isin(*FREE_DOMAINS), F.lit("freemail"))
        .when(own, F.when(role == "direct", F.lit("business_individual")).otherwise(F.lit("business_role")))
        .otherwise(F.lit("external_business"))
    )
    valid = ~kind.isin("invalid_syntax", "asset_filename", "placeholder", "vendor_tracker")
    return F.struct(valid.alias("is_valid"), kind.alias("classification"), F.when(valid, role).alias("email_role"))


def is_phone(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    dummy = F.lit(False)
    for s in DUMMY_DIGITS:
        dummy = dummy | F.contains(d, F.lit(s))
    return F.coalesce(F.length(d).between(7, 18) & ~d.rlike(r"^(\d)\1+$") & ~dummy, F.lit(False))


def is_social_profile(url: Column, platform: str, strict: bool = False) -> Column:
    """Whether an address is a profile on the platform. strict: x.com must be the host, not a host's end."""
    low = F.lower(js_trim(F.coalesce(url, F.lit(""))))
    has = lambda *xs: matches(low, "(" + "|".join(x.replace(".", r"\.") for x in xs) + ")", ignore_case=False)
    if platform == "linkedin":
        return has("linkedin.com/company/", "linkedin.com/in/") & ~has("/sharing/", "/login", "/signup")
    if platform == "twitter":
        host = matches(low, r"(^|//|\.)(twitter|x)\.com/") if strict else has("twitter.com/", "x.com/")
        return host & ~has("/intent/", "/share", "/home", "/login")
    if platform == "facebook":
        return has("facebook.com/") & ~has("/sharer", "/share.php", "/events/", "/login", "/dialog/")
    if platform == "instagram":
        return has("instagram.com/") & ~has("/p/", "/reel/", "/stories/", "/explore/")
    if platform == "youtube":
        return has("youtube.com/", "youtu.be/") & ~has("/watch", "/embed/", "/share") & has("/@", "/channel/", "/c/")
    if platform == "github":
        return has("github.com/") & ~has("/login", "/join", "/pricing", "/features")
    return F.lit(False)


def normalize_social(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.substring_index(js_trim(F.coalesce(url, F.lit(""))), "#", 1), "?", 1), "/+$", "")


def is_company_name(c: Column) -> Column:
    t = js_trim(c)
    return F.coalesce(F.length(t).between(2, 100) & ~F.lower(t).isin(*COMPANY_BLACKLIST), F.lit(False))


def decode_protected_email(c: Column) -> Column:
    """The address behind a hex string whose first byte is XORed onto the rest; null if it is shorter than two bytes."""

    def of(t: Column) -> Column:
        key = F.conv(F.substring(t, 1, 2), 16, 10).cast("int")
        places = F.sequence(F.lit(3), F.length(t) - 1, F.lit(2))
        text = F.aggregate(places, F.lit(""), lambda s, i: F.concat(s, F.char(F.conv(F.substring(t, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key))))
        return F.when(F.length(t) >= 4, js_trim(text))

    return let(c, of)


def title_brand(c: Column) -> Column:
    """The part of a page title that can be a company's name; empty if there is none."""
    lead = lambda x: js_trim(F.regexp_replace(js_trim(x), TITLE_LEAD, ""))

    def of(t: Column, parts: Column) -> Column:
        good = F.filter(F.transform(parts, lead), is_company_name)
        return F.when((F.size(parts) > 1) & (F.size(good) > 0), F.try_element_at(good, F.lit(1))).when(is_company_name(t), t).otherwise(F.lit(""))

    return let(lead(F.coalesce(c, F.lit(""))), lambda t: let(F.split(t, SPLITTER), lambda p: of(t, p)))


def is_person_name(c: Column) -> Column:
    def of(t: Column) -> Column:
        words = F.split(t, " ")
        good = F.forall(words, lambda w: w.rlike(NAME_WORD) & ~F.lower(w).isin(*NON_NAMES))
        return F.coalesce(~F.lower(t).isin(*NON_NAMES) & F.size(words).between(2, 4) & ~t.rlike(r"""[0-9@#$%^&*()_+=\[\]{};:"\\|<>/?]""") & good, F.lit(False))

    return let(normalize_text(c), of)


def is_job_title(c: Column) -> Column:
    return let(normalize_text(c), lambda t: (F.length(t) <= 70) & ~t.rlike("[.!?]$") & (F.size(F.split(t, " ")) <= 7) & ~matches(t, NARRATIVE) & matches(t, TITLE))


def split_name_title(c: Column) -> Column:
    """STRUCT(name, title) of "Name - Title" either way round; else the text is the name."""

    def of(s: Column) -> Column:
        p1, p2 = s["a"], s["b"]
        first, second = s["two"] & is_person_name(p1) & matches(p2, TITLE), s["two"] & is_person_name(p2) & matches(p1, TITLE)
        which = F.when(first, 1).when(second, 2).otherwise(0)
        return let(which, lambda w: F.struct(F.when(w == 1, p1).when(w == 2, p2).otherwise(s["all"]).alias("name"), F.when(w == 1, p2).when(w == 2, p1).alias("title")))

    def cut(parts: Column) -> Column:
        return F.struct(normalize_text(F.try_element_at(parts, F.lit(1))).alias("a"), normalize_text(F.try_element_at(parts, F.lit(2))).alias("b"), (F.size(parts) >= 2).alias("two"), normalize_text(c).alias("all"))

    return let(let(F.split(c, SPLITTER), cut), of)


def seniority(title: Column) -> Column:
    def of(t: Column) -> Column:
        out = F.when(F.coalesce(t, F.lit("")) == "", F.lit(0.40))
        for score, names in SENIORITY:
            out = out.when(matches(t, f"{LEFT}({names}){RIGHT}", ignore_case=False), F.lit(score))
        return out.otherwise(F.lit(0.50))

    return let(F.lower(F.when(truthy(title), js_trim(title))), of)


def sanitize_input_url(c: Column) -> Column:
    t = js_trim(F.coalesce(c, F.lit("")))
    t = F.when(matches(t, "^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    head, rest = F.lower(F.regexp_extract(t, r"^([^/]+//[^/?#\s]+)", 1)), F.regexp_extract(t, r"^[^/]+//[^/?#\s]+(.*)$", 1)
    rest = F.when(rest.rlike("^/"), rest).otherwise(F.concat(F.lit("/"), rest))
    bad = matches(js_trim(c), "^(javascript|data|file|chrome|about|blob):") | ~nonblank(c) | (head == "")
    return F.when(bad, F.lit("")).otherwise(F.concat(head, rest))


