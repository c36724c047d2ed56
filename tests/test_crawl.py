"""The crawl in rounds against a queue that is walked site by site."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import crawl, links

PAGES = "site long, url string, root boolean, found array<string>"
LINKS = "site long, url string, seq long, target string, anchor string, box string"


def scores(spark, targets, anchors, boxes):
    """{(target, anchor, box, depth, missing): score} and {(target, anchor): intent} by the link rules themselves."""
    flags = ("email", "phone", "address", "people", "company", "social")
    masks = [dict(zip(flags, (bool(m >> i & 1) for i in range(6)))) for m in range(64)]
    rows = [(t, a, b, d) for t in targets for a in anchors for b in boxes for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "t string, a string, b string, d int")
    made = df.select("t", "a", "b", "d", links.intent(F.col("t"), F.col("a")).alias("intent"), *[links.priority(F.col("t"), F.col("a"), F.col("d"), F.col("b"), F.struct(*[F.lit(v).alias(k) for k, v in m.items()])).alias(f"m{i}") for i, m in enumerate(masks)])
    table, kinds = {}, {}
    for r in made.collect():
        kinds[r["t"], r["a"]] = r["intent"]
        for i in range(64):
            table[r["t"], r["a"], r["b"], r["d"], i] = r[f"m{i}"]
    return table, kinds


def walk(pages, out, table, kinds, budget, deepest, early, people):
    """One site: pending links in a list that is sorted, stably, whenever one comes or all are scored anew."""
    pending = [{"url": min(u for u, p in pages.items() if p["root"]), "depth": 0, "score": 1000, "intent": "HOMEPAGE", "anchor": "", "box": ""}]
    queued, visits, have, why = {pending[0]["url"]}, [], set(), None
    while pending and len(visits) < budget:
        now = pending.pop(0)
        page = pages.get(now["url"])
        visits.append((now["url"], len(visits) + 1, "completed" if page else "failed", now["intent"] if page else "GENERIC", now["depth"]))
        if page is None:
            continue
        have |= set(page["found"] or ())
        lacks = ["email" not in have, "phone" not in have, "address" not in have and not {"city", "country"} <= have, people and "people" not in have, "company_name" not in have, "social" not in have]
        mask = sum(x << i for i, x in enumerate(lacks))
        if now["depth"] < deepest:
            found = {}
            for _, target, anchor, box in sorted(out.get(now["url"], ())):
                score = table[target, anchor, box, now["depth"] + 1, mask]
                if target == now["url"] or score <= links.LOWEST or (target in found and score <= found[target]["score"]):
                    continue
                new = {"url": target, "depth": now["depth"] + 1, "score": score, "intent": kinds[target, anchor], "anchor": anchor, "box": box}
                found.setdefault(target, new).update(new)
            for item in sorted(found.values(), key=lambda x: -x["score"]):
                if item["url"] not in queued and len(visits) < budget:
                    queued.add(item["url"])
                    pending.append(item)
                    pending.sort(key=lambda x: -x["score"])
        for p in pending:
            if p["depth"]:
                p["score"], p["intent"] = table[p["url"], p["anchor"], p["box"], p["depth"], mask], kinds[p["url"], p["anchor"]]
        pending.sort(key=lambda x: -x["score"])
        if early and len(visits) >= 2:
            core = {"company_name", "email", "phone"} <= have
            if core and not lacks[2] and not lacks[3]:
                why = "all_requested_fields_satisfied"
                break
            if core and pending and pending[0]["score"] < 40:
                why = "no_more_relevant_pages"
                break
    why = why or ("budget_exhausted" if len(visits) >= budget else "completed")
    return [(*v, why) for v in visits]


@pytest.mark.parametrize("budget, deepest, early, people", [(7, 2, True, True), (5, 3, False, True), (9, 3, True, False)])
def test_crawl_equals_a_queue(spark, budget, deepest, early, people):
    r = random.Random(budget)
    paths = ["contact", "about", "team", "locations", "services", "blog/x", "careers", "p1", "p2", "p3", "faq", "tag/x", "cart"]
    anchors, boxes = ["", "Contact us", "Our team", "Follow us"], ["", "NAV", "FOOTER"]
    urls = [f"https://a.test/{p}" for p in paths]
    table, kinds = scores(spark, urls, anchors, boxes)
    pages, out, rows = collections.defaultdict(dict), collections.defaultdict(lambda: collections.defaultdict(list)), []
    for site in range(25):
        there = [u for u in urls if r.random() < 0.8]
        fields = ("company_name", "email", "phone", "address", "people", "social", "city", "country")
        for u in ["https://a.test", *there]:
            pages[site][u] = {"root": u == "https://a.test", "found": r.choice([None, r.sample(fields, r.randint(0, 4))])}
            for _ in range(r.randint(0, 9)):
                rows.append((site, u, len(rows), r.choice(urls), r.choice(anchors), r.choice(boxes)))
                out[site][u].append(rows[-1][2:])
    given = spark.createDataFrame([(s, u, p["root"], p["found"]) for s in pages for u, p in pages[s].items()], PAGES)
    got = crawl.crawl(given, spark.createDataFrame(rows, LINKS), budget, deepest, early, people)
    expected = {(s, *v) for s in pages for v in walk(pages[s], out[s], table, kinds, budget, deepest, early, people)}
    assert {(x["site"], x["url"], x["visit"], x["status"], x["intent"], x["depth"], x["stop_reason"]) for x in got.collect()} == expected


def test_statistics_and_little(spark):
    none = spark.createDataFrame([], LINKS)
    one = crawl.crawl(spark.createDataFrame([(1, "https://a.test", True, None), (2, "https://b.test", False, None)], PAGES), none)
    assert [tuple(r) for r in crawl.stats(one).collect()] == [(1, 1, 1, 0, 0, 0, False, "completed", 10)]
    links_ = spark.createDataFrame([(1, "https://a.test", 1, "https://a.test/contact", None, None), (1, "https://a.test", 2, "https://a.test", "Home", "NAV")], LINKS)
    got = crawl.stats(crawl.crawl(spark.createDataFrame([(1, "https://a.test", True, ["company_name"]), (1, "https://a.test/contact", False, ["email", "phone", "address", "people"])], PAGES), links_)).first()
    assert (got["pages_scanned"], got["high_value"], got["stopped_early"], got["stop_reason"]) == (2, 1, True, "all_requested_fields_satisfied")
