"""Pages parsed once: a small element tree, and the evidence, people and links that it holds.

Built-in patterns cover single facts (titles, anchors); what needs structure runs here, in one mapInPandas-style Arrow
pass that emits rows and drops the html. Filters on other columns belong before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, or_null
from ..functions.web import evaluate_email, is_job_title, is_person_name, is_phone, normalize_domain, normalize_email, normalize_phone, normalize_text, split_name_title, title_brand

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Parameters dropped from addresses, schema.org types read as organizations, labels and selectors of people.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "trk")
SOCIAL = (("linkedin", r"linkedin\.com/(company|in)/"), ("twitter_x", r"(twitter\.com|x\.com)/[a-zA-Z0-9_]+"), ("facebook", r"facebook\.com/[a-zA-Z0-9_.-]+"), ("instagram", r"instagram\.com/[a-zA-Z0-9_.-]+"), ("youtube", r"(youtube\.com/(@|channel/|c/)|youtu\.be/)"), ("github", r"github\.com/[a-zA-Z0-9_.-]+"))
LABELS = (("email", r"^(email|e-mail|write to us|contact email)\s*[:\-]\s*(.+)$"), ("phone", r"^(phone|tel|telephone|call us|mobile|contact number)\s*[:\-]\s*(.+)$"), ("address", r"^(address|headquarters|location|office|visit us)\s*[:\-]\s*(.+)$"))
GENERIC = "info|sales|contact|support|hello|team|admin|help|office|inquiries|press|careers|billing"  # fixed values: addresses that are no person's
TEXT_LIMIT = 100_000  # characters of a page searched for loose contacts, as the extraction contract says


def url_norm(url: str, base: str | None = None) -> str:
    """An absolute http address: host in lower case, default port, fragment and tracking parameters gone, path and query
    percent-encoded; empty if it is none."""
    url = (url or "").strip()
    if re.match(r"(?i)(javascript|data|file|chrome|blob):", url):
        return ""
    try:
        if not re.match(r"(?i)https?://", url):
            url = urljoin(base, url) if base else ("https:" + url if url.startswith("//") else "https://" + url)
        p = urlsplit(url)
        if p.scheme.lower() not in ("http", "https") or not p.hostname:
            return ""
        host = p.hostname.encode("idna").decode() if not p.hostname.isascii() else p.hostname
        port = "" if p.port in (None, {"http": 80, "https": 443}[p.scheme.lower()]) else f":{p.port}"
    except ValueError:
        return ""
    query = p.query and urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k not in TRACKING])
    path = quote(p.path, safe="/%:@!$&'()*+,;=-._~|") or "/"
    return urlunsplit((p.scheme.lower(), host + port, "" if path == "/" and not query else path, query, ""))


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags and n is not self]

    def having(self, attr: str) -> list[Node]:
        return [n for n in self.walk() if attr in n.attrs and n is not self]

    def text(self) -> str:
        """All text below, scripts and styles included, without separators."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                todo += reversed(n.kids)
        return "".join(out)

    def mark(self) -> str:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".lower()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if self.at.tag in shut:
            self.at = self.at.parent or self.at
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def first_text(*values) -> str | None:
    for v in values:
        if isinstance(v, str) and v.strip():
            return v.strip()
        if isinstance(v, dict) and (s := first_text(v.get("name"))):
            return s
    return None


def json_ld(root: Node) -> list:
    out = []
    for n in root.all("script"):
        if n.attrs.get("type", "").lower() == "application/ld+json":
            try:
                out.append(json.loads(n.text()))
            except ValueError:
                continue
    return out


# JSON-LD types that are evidence even without a name or contact.
ENTITY_TYPES = frozenset({"organization", "corporation", "localbusiness", "store", "restaurant", "medicalbusiness", "financialservice", "professionalservice", "automotivebusiness", "lodgingbusiness", "foodestablishment", "dentist", "physician", "attorney", "legalagency", "realestateagent", "bakery", "cafe"})


def types_of(entity: dict) -> list[str]:
    t = entity.get("@type")
    return [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]


def entities(value) -> Iterator[dict]:
    """Objects of a JSON-LD value that describe someone or something to contact: through lists, @graph (alone), contact
    points, departments and sub-organizations. They have one of ENTITY_TYPES, or a name, phone, e-mail or address."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            if isinstance(v.get("@graph"), list):
                todo += reversed(v["@graph"])
                continue
            if any(v.get(k) for k in ("name", "telephone", "email", "address")) or any(re.sub("[^a-z]", "", t.lower()) in ENTITY_TYPES for t in types_of(v)):
                yield v
            todo += [v[k] for k in ("subOrganization", "department", "contactPoint") if k in v]


TITLE_KIND = "page-title-branding"  # its value is the whole title here; extract() keeps what can be a company's name


def evidence(root: Node, url: str) -> list[tuple[str, str, str, str]]:
    """(field, value, source, evidence_type) of a page, in the order of the generators."""
    out: list[tuple[str, str, str, str]] = []

    def add(field: str, value, source: str, kind: str) -> None:
        if isinstance(value, list):
            for v in value:
                add(field, v, source, kind)
        elif isinstance(value, (str, int, float)) and str(value).strip():
            out.append((field, str(value).strip(), source, kind))

    for e in (e for doc in json_ld(root) for e in entities(doc)):
        kind = f"json-ld-{next(iter(types_of(e)), 'thing').lower()}"
        add("company_name", next((e[k] for k in ("name", "legalName", "alternateName") if e.get(k)), None), "json-ld", f"{kind}-name")
        for field, key, ending in (("email", "email", "email"), ("phone", "telephone", "phone"), ("website", "url", "url"), ("same_as_url", "sameAs", "sameas"), ("description", "description", "description"), ("price_range", "priceRange", "pricerange")):
            add(field, e.get(key), "json-ld", f"{kind}-{ending}")
        for a in e["address"] if isinstance(e.get("address"), list) else [e.get("address")]:
            if isinstance(a, str):
                add("address", a, "json-ld", f"{kind}-address-str")
            elif isinstance(a, dict):
                parts = [first_text(a.get(k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
                add("address", ", ".join(p for p in parts if p), "json-ld", "json-ld-postal-address-full")
                for field, part, p in zip(("city", "region", "postal_code", "country"), ("locality", "region", "code", "country"), parts[1:]):
                    add(field, p, "json-ld", f"json-ld-postal-{part}")
    for scope in root.having("itemscope"):
        if "schema.org" in scope.attrs.get("itemtype", ""):
            for n in scope.having("itemprop"):
                field = {"name": "company_name", "telephone": "phone", "email": "email"}.get(n.attrs["itemprop"])
                if field:
                    value = n.attrs["content"] if "content" in n.attrs else n.attrs.get("href") if n.tag in ("a", "link") else squeeze(n.text())
                    add(field, value, "microdata", f"microdata-itemprop-{n.attrs['itemprop']}")
    links = [n for n in root.all("a") if "href" in n.attrs]
    for scheme, field in (("mailto", "email"), ("tel", "phone")):
        for n in links:
            if n.attrs["href"].startswith(scheme + ":"):
                add(field, n.attrs["href"][len(scheme) + 1 :].split("?")[0], scheme, f"anchor-{scheme}")
    for n in root.walk():
        href = n.attrs.get("href", "").partition("/cdn-cgi/l/email-protection#")[2] if n.tag == "a" else ""
        for code, kind in ((href, "anchor-cf-protection"), (n.attrs.get("data-cfemail") or "", "attr-cf-protection")):
            if re.fullmatch(r"[0-9a-fA-F]{4,}", code) and len(code) % 2 == 0:
                raw = bytes.fromhex(code)
                mail = "".join(chr(b ^ raw[0]) for b in raw[1:])
                add("email", mail if "@" in mail else None, "cloudflare-decoded", kind)
    seen = set()
    for n in links:
        href, label = n.attrs["href"].strip(), squeeze(n.text()).lower()
        low = href.lower()
        if href not in seen:
            seen.add(href)
            for field, pattern in SOCIAL:
                if re.search(pattern, href, re.I):
                    add(field, href, "semantic-dom", f"social-link-{field}")
        if "calendly.com/" in low or "chilipiper.com/" in low or label in ("book now", "book online", "schedule demo"):
            add("booking_url", href, "semantic-dom", "action-link-booking")
        elif "/order" in low or "/shop" in low or label in ("order online", "shop now"):
            add("ordering_url", href, "semantic-dom", "action-link-ordering")
        elif "/menu" in low or label in ("view menu", "our menu"):
            add("menu_url", href, "semantic-dom", "action-link-menu")
    for n in root.all("address"):
        t = squeeze(n.text())
        if 5 < len(t) < 300:
            add("address", t, "semantic-dom", "semantic-html-address-tag")
    for n in root.all("p", "span", "div", "li", "td", "th"):
        t = n.text().strip()
        if t and len(t) <= 200 and sum(isinstance(k, Node) for k in n.kids) <= 2:
            for field, pattern in LABELS:
                if m := re.match(pattern, t, re.I):
                    add(field, m[2], "contextual-label", f"label-{field}-text")
    boxes = [n for n in root.walk() if n.tag == "footer" or "contact" in n.mark() or "footer" in n.mark()]
    body = boxes[0] if boxes else next(iter(root.all("body")), root)
    text = body.text()[:TEXT_LIMIT]
    for field, pattern in (("email", r"\b[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+\b"), ("phone", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b")):
        for v in dict.fromkeys(re.findall(pattern, text, re.A)):
            add(field, v, "regex-pattern", f"body-regex-{field}")
    meta = {(n.attrs.get("property") or n.attrs.get("name", "")).lower(): n.attrs.get("content") for n in reversed(root.all("meta"))}
    add("company_name", meta.get("og:site_name"), "metadata", "open-graph-site-name")
    for n in root.all("title")[:1]:
        add("company_name", squeeze(n.text()), "metadata", TITLE_KIND)
    add("description", first_text(meta.get("description"), meta.get("og:description")), "metadata", "meta-description")
    return out


# Where JSON-LD nests people, and the classes and ids of their cards.
NESTED = ("employee", "founder", "founders", "alumni", "member", "members")
CARD = re.compile("team-member|team_member|team-card|member-card|person-card|leadership-card|speaker-card|bio-card")
GRID, TEAM = re.compile("team-grid|leadership-grid"), re.compile("team|leadership")
CARD_LIMIT = 2500  # characters of a card; longer ones are whole sections


class Person(NamedTuple):
    """A person as a page tells it. Of a card all that can be a name or title is kept, for the rules to choose from: names
    in order, and titles (text, whether it is marked as one, the names that it is part of)."""

    name: str | None
    title: str | None
    email: str | None
    phone: str | None
    linkedin_url: str | None
    profile_url: str | None
    source: str
    names: list[str] | None = None
    titles: list[dict] | None = None


def people(root: Node, url: str, base: str) -> list[Person]:
    """Persons in JSON-LD (nested in organizations too), microdata and cards."""
    return [*_json_people(root, url), *_microdata_people(root), *_card_people(root, base)]


def _text(value) -> str | None:
    return squeeze(str(value)) if isinstance(value, (str, int, float)) and str(value).strip() else None


def _json_people(root: Node, url: str) -> list[Person]:
    out, todo = [], json_ld(root)
    while todo:
        v = todo.pop(0)
        if isinstance(v, list):
            todo[:0] = v
        elif isinstance(v, dict) and isinstance(v.get("@graph"), list):
            todo[:0] = v["@graph"]
        elif isinstance(v, dict):
            if any(t.lower() == "person" for t in types_of(v)) and _text(v.get("name")):
                same = v.get("sameAs") if isinstance(v.get("sameAs"), list) else [v.get("sameAs")]
                link = next((s for s in same if isinstance(s, str) and "linkedin.com/in/" in s), None)
                page = v.get("url")
                out.append(Person(_text(v["name"]), _text(v.get("jobTitle")), _text(v.get("email")), _text(v.get("telephone")), link and url_norm(link), url_norm(page, url) if isinstance(page, str) and page else None, "json-ld"))
            todo[:0] = [v[k] for k in NESTED if v.get(k)]
    return out


def _microdata_people(root: Node) -> list[Person]:
    out = []
    for scope in root.having("itemscope"):
        if "schema.org/person" not in scope.attrs.get("itemtype", "").lower():
            continue
        props: dict[str, Node] = {}
        link = None
        for n in scope.having("itemprop"):
            props.setdefault(n.attrs["itemprop"], n)
            if link is None and n.attrs["itemprop"] == "sameAs" and "linkedin.com/in/" in n.attrs.get("href", ""):
                link = url_norm(n.attrs["href"])
        text = lambda k, props=props: squeeze(props[k].text()) or None if k in props else None
        address = lambda k, props=props: (props[k].attrs.get("href") or squeeze(props[k].text()) or None) if k in props else None
        if text("name"):
            out.append(Person(text("name"), text("jobTitle"), address("email"), address("telephone"), link, None, "microdata"))
    return out


def _cards(root: Node) -> Iterator[Node]:
    """Elements that look like one person's card, in the order of the page."""
    size: dict[int, int] = {}
    for n in reversed(list(root.walk())):
        size[id(n)] = sum(len(k) if isinstance(k, str) else size[id(k)] for k in n.kids)
    todo = [(root, False, False)]
    while todo:
        n, in_ids, in_classes = todo.pop()
        mark, parent = n.attrs.get("class", "").lower(), n.parent.attrs.get("class", "").lower() if n.parent is not None else ""
        hit = CARD.search(mark) or GRID.search(parent) or (in_ids and n.tag == "article") or (in_classes and n.tag == "li")
        kids = [k for k in n.kids if isinstance(k, Node)]
        if hit and kids and size[id(n)] <= CARD_LIMIT:
            yield n
        below = in_ids or bool(TEAM.search(n.attrs.get("id", "").lower())), in_classes or bool(TEAM.search(mark))
        todo += [(k, *below) for k in reversed(kids)]


def _card_people(root: Node, base: str) -> list[Person]:
    out = []
    for card in _cards(root):
        inner = [n for n in card.walk() if n is not card]
        heads = [n for n in inner if n.tag in ("h2", "h3", "h4", "h5", "strong") or "name" in n.attrs.get("class", "").lower()]
        if not heads:
            continue
        number = {id(n): i for i, n in enumerate(heads)}

        def inside(n: Node, card=card, number=number) -> list[int]:
            found = []
            while n is not None and n is not card:
                found += [number[id(n)]] if id(n) in number else []
                n = n.parent
            return found

        marked = next((n for n in inner if re.search("title|role|position|designation", n.attrs.get("class", "").lower())), None)
        titles = [{"text": squeeze(marked.text()), "marked": True, "inside": inside(marked)}] if marked is not None else []
        titles += [{"text": squeeze(n.text()), "marked": False, "inside": inside(n)} for n in inner if n.tag in ("p", "span", "div", "h4", "h5")]
        href = [n.attrs.get("href", "") for n in inner if n.tag == "a"]
        pick = lambda test, href=href: next((h for h in href if test(h)), None)
        mail, tel = pick(lambda h: h.startswith("mailto:")), pick(lambda h: h.startswith("tel:"))
        link, page = pick(lambda h: "linkedin.com/in/" in h), pick(lambda h: re.search("/(team|people|bio)/", h))
        out.append(Person(None, None, mail and mail[7:].split("?")[0].strip(), tel and tel[4:].split("?")[0].strip(), link and url_norm(link), page and url_norm(page, base), "team-card", [squeeze(n.text()) for n in heads], titles))
    return out


def anchors(root: Node, url: str) -> list[tuple[str, str, str]]:
    """(address, text, container) of a page's links: NAV, FOOTER, BUTTON, MAIN or empty."""
    out = []
    for n in root.all("a"):
        href = n.attrs.get("href", "").strip()
        if not href or href.startswith(("#", "javascript:")) or not (target := url_norm(href, url)):
            continue
        box = "BUTTON" if n.attrs.get("role", "").lower() == "button" or re.search("btn|button|cta|action", n.attrs.get("class", "").lower()) else ""
        p = n.parent
        while p is not None and p.tag not in ("body", "html"):
            if p.tag in ("nav", "header") or re.search("nav|menu|header", p.mark()):
                box = "NAV"
                break
            if p.tag == "footer" or "footer" in p.mark():
                box = "FOOTER"
                break
            if p.tag in ("main", "article", "section") and not box:
                box = "MAIN"
            p = p.parent
        out.append((target, squeeze(n.text()), box))
    return out


SCHEMA = "page_id long, url string, seq long, kind string, field string, value string, source string, evidence_type string, title string, email string, phone string, linkedin_url string, profile_url string, names array<string>, titles array<struct<text:string,marked:boolean,inside:array<int>>>"
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<struct<text:string,marked:boolean,inside:array<int>>>": pa.list_(pa.struct([("text", pa.string()), ("marked", pa.bool_()), ("inside", pa.list_(pa.int32()))]))}


def _named(found: DataFrame) -> DataFrame:
    """Persons by the rules of names, titles and contacts: of a card the first valid name, the title that is marked as one,
    else the first other, else the one beside the name; a role's address is no person's."""
    card, host = F.col("source") == "team-card", normalize_domain(F.col("url"))
    split = F.transform("names", lambda x, i: F.struct(split_name_title(x).alias("s"), i.alias("i")))
    found = found.withColumn("_who", F.get(F.filter(split, lambda x: is_person_name(x["s"]["name"])), F.lit(0)))
    free = F.filter("titles", lambda t: ~F.array_contains(t["inside"], F.col("_who.i")))
    pick = lambda marked: F.get(F.filter(free, lambda t: (t["marked"] == F.lit(marked)) & is_job_title(t["text"])), F.lit(0))["text"]
    beside = F.col("_who.s.title")
    title = F.coalesce(pick(True), pick(False), F.when(is_job_title(beside), beside))
    name = normalize_text(F.col("value"))
    judged = evaluate_email(F.col("email"), host)
    own = judged["is_valid"] & (judged["classification"] != "business_role") & ~matches(F.substring_index(F.lower("email"), "@", 1), f"^({GENERIC})$")
    mail, tel = or_null(normalize_email(F.col("email"))), or_null(normalize_phone(F.col("phone")))
    person = F.col("kind") == "person"
    return found.withColumns({
        "value": F.when(~person, F.col("value")).when(card, F.col("_who.s.name")).otherwise(F.when(is_person_name(name), name)), "title": F.when(person & card, title).otherwise(F.col("title")),
        "email": F.when(person & card, F.when(own, mail)).when(person, mail).otherwise(F.col("email")), "phone": F.when(person & card, F.when(is_phone(F.col("phone")), tel)).when(person, tel).otherwise(F.col("phone")),
    }).drop("_who", "names", "titles")


def page_people(found: DataFrame) -> DataFrame:
    """(page_id, site, seq, name, title, profile_url, linkedin_url, email, phone, confidence, source, page_url) of the
    persons that extract() found, as dedup_people takes them: seq is unique over a site's pages up to 2^20 rows a page."""
    sure = F.when(F.col("source") == "json-ld", 0.98).when(F.col("source") == "microdata", 0.94).when(F.col("title").isNotNull(), 0.90).otherwise(0.75)
    return found.where("kind = 'person'").select("page_id", normalize_domain(F.col("url")).alias("site"), (F.col("page_id") * (1 << 20) + F.col("seq")).alias("seq"), F.col("value").alias("name"), "title", "profile_url", "linkedin_url", "email", "phone", sure.alias("confidence"), "source", F.col("url").alias("page_url"))


def extract(pages: DataFrame) -> DataFrame:
    """One row for each piece of evidence (kind evidence), person (value: the name) and link (field: the container, title:
    the anchor) of (page_id, url, html). A null html is an empty page; broken markup is read as far as it goes."""
    names, types = zip(*[(c.split(" ", 1)[0], _ARROW[c.split(" ", 1)[1]]) for c in SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for page, url, html in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                    root, seq = parse(html), 0
                    base = next((n.attrs["href"] for n in root.all("base") if n.attrs.get("href")), url)
                    for f, v, s, k in evidence(root, url or ""):
                        rows.append((page, url, seq, "evidence", f, v, s, k, *[None] * 7))
                        seq += 1
                    for p in people(root, url or "", base or ""):
                        rows.append((page, url, seq, "person", None, p.name, p.source, None, p.title, p.email, p.phone, p.linkedin_url, p.profile_url, p.names, p.titles))
                        seq += 1
                    for target, text, box in anchors(root, base or ""):
                        rows.append((page, url, seq, "link", box, target, None, None, text, *[None] * 6))
                        seq += 1
                columns = list(zip(*rows)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
    value = F.when(F.col("evidence_type") == TITLE_KIND, or_null(title_brand(F.col("value")))).otherwise(F.col("value"))
    return _named(found.withColumn("value", value)).where("value IS NOT NULL")
