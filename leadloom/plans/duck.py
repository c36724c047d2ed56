"""DuckDB expressions for the queries' SQL: the same rules, written for another engine (RE2 patterns, list functions)."""

from __future__ import annotations

from ..functions import listing, text, web

WS = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0B]"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def within(x: str, values) -> str:
    return f"({x} IN ({', '.join(quoted(v) for v in values)}))"


def re2(pattern: str) -> str:
    """A pattern of the functions for RE2: borders beside word characters as \\b."""
    return pattern.replace(text.LEFT, r"\b").replace(text.RIGHT, r"\b").replace(text.WS, WS)


def has(x: str, pattern: str, ci: bool = True) -> str:
    return f"coalesce(regexp_matches({x}, {quoted(('(?i)' if ci else '') + re2(pattern))}), false)"


def sub(x: str, pattern: str, to: str = "", ci: bool = False) -> str:
    return f"regexp_replace({x}, {quoted(('(?i)' if ci else '') + re2(pattern))}, {quoted(to)}, 'g')"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {quoted(re2(pattern))}, {group})"


def trim(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$")


def squeeze(x: str) -> str:
    return trim(sub(x, f"{WS}+", " "))


def nz(x: str) -> str:
    return f"nullif({x}, '')"


def clean(x: str, boxes: bool = True) -> str:
    return squeeze(sub(f"coalesce({x}, '')", "[\\x{FFFD}★⭐□]" if boxes else "[\\x{FFFD}★⭐]"))


def plus_code(x: str) -> str:
    return has(clean(x), text.LEFT + text.PLUS_CODE + text.RIGHT)


def ui_title(x: str) -> str:
    t = f"lower({clean(x)})"
    return f"({t} = '' OR {within(t, text.UI_TITLES)} OR {has(t, text.UI_PREFIX)})"


def rating(x: str) -> str:
    t = clean(x)
    return f"(NOT {has(t, text.POSTAL_ONLY)} AND ({' OR '.join(has(t, p) for p in text.RATINGS)}))"


def price(x: str) -> str:
    t = clean(x)
    last = rf"[A-Za-z0-9_][{text.CURRENCY}]\d+([\d–\s\-,.]*\d)?\b"
    return f"({has(t, f'[{text.CURRENCY}]')} AND ({' OR '.join(has(t, p) for p in (*text.PRICES[:3], last))}))"


def noise(x: str) -> str:
    return f"({plus_code(x)} OR {rating(x)} OR {price(x)})"


def website_text(x: str) -> str:
    t = clean(x)
    return f"({t} <> '' AND NOT {has(t, text.MAP_URL)} AND NOT {noise(t)} AND NOT {ui_title(t)} AND {has(t, text.DOMAIN_TEXT)})"


def status(x: str) -> str:
    t = clean(x)
    return f"CASE WHEN {t} <> '' AND length({t}) <= 60 AND NOT {has(t, text.SERVICES)} AND NOT {has(t, text.DESCRIPTIVE)} AND {has(t, text.LEFT + text.STATUS + text.RIGHT)} THEN {t} END"


def field(x: str) -> str:
    t = clean(x)
    return f"CASE WHEN {t} <> '' AND NOT {noise(t)} AND NOT {ui_title(t)} THEN {t} END"


def address(x: str) -> str:
    t = trim(sub(sub(clean(x), r"^(copy address|address:?|location:?)\s*", ci=True), r"\s*(copy address|copied)$", ci=True))
    s = trim(sub(sub(t, f"{text.STATUS}$", ci=True), r"[\s,·\-]+$"))
    return f"CASE WHEN NOT ({t} = '' OR {noise(t)} OR {ui_title(t)}) AND {s} <> '' AND NOT {noise(s)} THEN {s} END"


def number(x: str) -> str:
    return f"TRY_CAST({nz(sub(x, r'[^0-9.]'))} AS DOUBLE)"


def name(x: str) -> str:
    return squeeze(sub(sub(f"lower(coalesce({x}, ''))", "['\"’]"), "[^a-z0-9]", " "))


def query(x: str) -> str:
    return squeeze(f"lower(replace(coalesce({x}, ''), '+', ' '))")


def slug(x: str, missing: str = "google-maps") -> str:
    t = f"lower(coalesce({nz(x)}, {quoted(missing)}))"
    return f"substr({sub(sub(t, '[^a-z0-9]+', '-'), '^-+|-+$')}, 1, 40)"


def decode(x: str) -> str:
    return f"url_decode({x})"


def place_id(x: str) -> str:
    return decode("coalesce(" + ", ".join(nz(ext(x, p)) for p in (r"!19s([^!?/]+)", r"!1s(0x[0-9a-fA-F]+:0x[0-9a-fA-F]+)", r"place_id[:=]([A-Za-z0-9_-]+)", r"!1s([^!?/]+)")) + ")")


def coordinate(x: str, i: int) -> str:
    return f"CAST(coalesce({nz(ext(x, '!3d(-?[0-9]+[.][0-9]+)!4d(-?[0-9]+[.][0-9]+)', i))}, {nz(ext(x, '@(-?[0-9]+[.][0-9]+),(-?[0-9]+[.][0-9]+)', i))}) AS DOUBLE)"


def phone_from_text(x: str) -> str:
    t = trim(sub(clean(x, False), r"^(phone:?|tel:?|call:?)\s*", ci=True))
    run = squeeze(ext(t, r"(\+?\d[\d\-\s().]{5,}\d)"))
    bad = f"({within(f'lower({t})', listing.PHONE_LABELS)} OR {has(t, r'^(send to phone|directions|save|nearby|share|add a label|website|menu)' + text.RIGHT)})"
    n = lambda y: f"length({sub(y, '[^0-9]')}) BETWEEN 6 AND 16"
    return f"CASE WHEN {t} <> '' AND NOT {bad} AND {n(t)} AND {run} <> '' AND {n(run)} THEN {run} END"


def internal(x: str) -> str:
    return f"({x} IS NULL OR {has(trim(x), listing.INTERNAL_HOST)})"


def sanitize_url(x: str) -> str:
    t = trim(x)
    t = f"CASE WHEN {has(t, '^https?://')} THEN {t} WHEN {has(t, '^([a-z0-9-]+[.])+[a-z]{2,}(/.*)?$')} THEN 'https://' || {t} END"
    head = f"lower({ext(t, '(?i)^(https?://[^/?#]+)')})"
    tail = f"substr({t}, length({head}) + 1)"
    tail = f"CASE WHEN {tail} IN ('', '/') THEN '' WHEN {has(tail, '^[?#]')} THEN '/' || {tail} ELSE {tail} END"
    return f"CASE WHEN NOT {has(t, text.MAP_URL)} AND {head} <> '' AND contains({head}, '.') THEN {head} || {tail} END"


def resolve_website(x: str) -> str:
    raw = trim(x)
    raw = f"CASE WHEN contains({raw}, '/url?') AND contains({raw}, 'q=') THEN coalesce({decode(nz(ext(raw, '[?&]q=([^&#]*)')))}, {raw}) ELSE {raw} END"
    bare = sub(clean(raw, False), r"^(https?://)?(www\.)?", ci=True)
    bad = f"({internal(raw)} OR {ui_title(bare)} OR {rating(bare)} OR {price(bare)} OR contains({raw}, '...'))"
    return f"CASE WHEN NOT {bad} THEN {sanitize_url(raw)} END"


def normalize_text(x: str) -> str:
    return squeeze(sub(f"coalesce({x}, '')", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))


def strip_html(x: str) -> str:
    return squeeze(sub(f"coalesce({x}, '')", "<[^>]*>", " "))


def email(x: str) -> str:
    t = trim(f"lower({decode(trim(f'''coalesce({x}, '')'''))})")
    t = sub(sub(t, r"[.,;:!?)>\]]+$"), "^mailto:")
    return trim(f"split_part({t}, '?', 1)")


def phone(x: str) -> str:
    t = f"split_part({sub(trim(f'''coalesce({x}, '')'''), '^tel:', ci=True)}, '?', 1)"
    digits = sub(t, "[^0-9]")
    return f"CASE WHEN length({digits}) < 7 THEN '' WHEN starts_with({t}, '+') THEN '+' || {digits} ELSE {squeeze(sub(t, r'[^0-9+()\-.\s]'))} END"


def domain(x: str) -> str:
    t = trim(f"coalesce({x}, '')")
    t = f"CASE WHEN {has(t, '^https?://')} THEN {t} ELSE 'https://' || {t} END"
    return sub(f"lower({ext(t, '(?i)^https?://(?:[^/?#@]*@)?([^/?#:[:space:]]+)')})", r"^www\.")


def url(x: str) -> str:
    t = f"split_part({trim(x)}, '#', 1)"
    t = f"CASE WHEN {has(t, '^https?://')} THEN {t} WHEN starts_with({t}, '//') THEN 'https:' || {t} ELSE 'https://' || {t} END"
    head, path = f"lower({ext(t, '^([^/]+//[^/?#]*)')})", ext(t, "^[^/]+//[^/?#]*([^?#]*)")
    q = f"list_filter(string_split({ext(t, '[?](.*)$')}, '&'), lambda p: p <> '' AND NOT {within('''split_part(p, '=', 1)''', web.TRACKING)})"
    q = f"array_to_string(list_transform({q}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    path = f"CASE WHEN {path} = '/' AND {q} = '' THEN '' WHEN {path} = '' AND {q} <> '' THEN '/' ELSE {path} END"
    return f"CASE WHEN length({head}) < 9 THEN '' ELSE {head} || {path} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END END"


def is_email(x: str) -> str:
    t = trim(x)
    return f"(coalesce(length({t}) BETWEEN 5 AND 254, false) AND {has(t, web.EMAIL_SYNTAX, ci=False)})"


def email_role(user: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(user, f'^({names})$')} THEN '{role}'" for role, names in web.ROLES) + " ELSE 'direct' END"


def email_class(x: str, site: str) -> str:
    user, dom = f"split_part(lower({x}), '@', 1)", f"split_part(lower({x}), '@', -1)"
    root = trim(sub(f"lower(coalesce({site}, ''))", r"^www\."))
    own = f"({root} <> '' AND ({dom} = {root} OR ends_with({dom}, '.' || {root})))"
    first, last = f"split_part({dom}, '.', 1)", f"split_part({dom}, '.', -1)"
    return f"CASE WHEN NOT {is_email(x)} THEN 'invalid_syntax' WHEN {within(last, web.ASSET_ENDINGS)} OR {within(first, web.ASSET_ENDINGS)} THEN 'asset_filename' WHEN {within(dom, web.PLACEHOLDER_DOMAINS)} OR {within(user, web.PLACEHOLDER_USERS)} THEN 'placeholder' WHEN {within(dom, web.VENDOR_DOMAINS)} THEN 'vendor_tracker' WHEN {within(dom, web.FREE_DOMAINS)} THEN 'freemail' WHEN {own} THEN CASE WHEN {email_role(user)} = 'direct' THEN 'business_individual' ELSE 'business_role' END ELSE 'external_business' END"


def is_phone(x: str) -> str:
    d = sub(x, "[^0-9]")
    same = "^(" + "|".join(f"{i}{{2,}}" for i in range(10)) + ")$"
    return f"coalesce(length({d}) BETWEEN 7 AND 18 AND NOT {has(d, same)} AND NOT {has(d, '|'.join(web.DUMMY_DIGITS))}, false)"


def company(x: str) -> str:
    t = trim(x)
    return f"coalesce(length({t}) BETWEEN 2 AND 100 AND NOT {within(f'lower({t})', web.COMPANY_BLACKLIST)}, false)"


def brand(x: str) -> str:
    lead = lambda y: trim(sub(trim(y), r"^(about|contact|welcome to|home of|meet)\s+", ci=True))
    t = lead(f"coalesce({x}, '')")
    parts = f"regexp_split_to_array({t}, {quoted(re2(web.SPLITTER))})"
    good = f"list_filter(list_transform({parts}, lambda p: {lead('p')}), lambda p: {company('p')})"
    return f"CASE WHEN len({parts}) > 1 AND len({good}) > 0 THEN ({good})[1] WHEN {company(t)} THEN {t} ELSE '' END"


def person(x: str) -> str:
    t = normalize_text(x)
    words = f"string_split({t}, ' ')"
    good = f"len(list_filter({words}, lambda w: NOT ({has('w', web.NAME_WORD, ci=False)} AND NOT {within('lower(w)', web.NON_NAMES)}))) = 0"
    bad = r"""[0-9@#$%^&*()_+=\[\]{};:"\\|<>/?]"""
    return f"coalesce(NOT {within(f'lower({t})', web.NON_NAMES)} AND len({words}) BETWEEN 2 AND 4 AND NOT {has(t, bad)} AND {good}, false)"


def seniority(x: str) -> str:
    t = f"lower({trim(x)})"
    return f"CASE WHEN coalesce({x}, '') = '' THEN 0.40::DOUBLE " + " ".join(f"WHEN {has(t, f'{text.LEFT}({names}){text.RIGHT}')} THEN {score}::DOUBLE" for score, names in web.SENIORITY) + " ELSE 0.50::DOUBLE END"
