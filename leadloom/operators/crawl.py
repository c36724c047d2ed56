"""Best-first crawl of sites over page snapshots, in rounds: every round each site that goes on visits one page.

A round takes the best pending link of each site by an aggregation, joins it with the page of that address and the links
of that page, and re-scores what is pending by what the site's pages have not given yet. Only visited pages and their
links are ever read, and no site is gathered in a task: a site's state is a row, its pending links are rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .links import LOWEST, intent, priority

HIGH_VALUE = ("CONTACT", "TEAM", "ABOUT", "LOCATION")
ENOUGH = 40  # a pending link below is no reason to go on once company, e-mail and phone are there


def _lacks(have: Column, people: bool) -> Column:
    """What a site's pages have not given yet, as link scores take it."""
    no = lambda f: ~F.array_contains(have, f)
    address = no("address") & ~(F.array_contains(have, "city") & F.array_contains(have, "country"))
    return F.struct(no("email").alias("email"), no("phone").alias("phone"), address.alias("address"), (no("people") & F.lit(people)).alias("people"), no("company_name").alias("company"), no("social").alias("social"))


def _stop(state: DataFrame, budget: int, early_exit: bool, people: bool) -> Column:
    """Why a site stops before its next visit; null if it goes on. A failed page is no occasion to stop early."""
    lacks = _lacks(F.col("have"), people)
    core = ~lacks["company"] & ~lacks["email"] & ~lacks["phone"]
    after = F.lit(early_exit) & F.col("completed") & (F.col("n") >= 2)
    return (
        F.when(after & core & ~lacks["address"] & ~lacks["people"], "all_requested_fields_satisfied")
        .when(after & core & (F.col("top") < ENOUGH), "no_more_relevant_pages")
        .when(F.col("n") >= budget, "budget_exhausted")
        .when(F.col("best").isNull(), "completed")
    )


def crawl(pages: DataFrame, links: DataFrame, max_pages: int = 10, max_depth: int = 2, early_exit: bool = True, people: bool = True) -> DataFrame:
    """(site, url, visit, status, intent, depth, stop_reason, pages_budget) of each visit.

    pages: (site, url, root, found), one row for an address, found is an array of the fields it gives (company_name, email,
    phone, address, city, country, people, social); a site begins at its root (the first address of several). links:
    (site, url, seq, target, anchor, box), those that policy allows. Links to addresses without a page are failed visits,
    which use up budget. At most max_pages (1 to 20) visits and max_depth (1 to 3) links from the root. people=False is
    the scope in which people are not asked for. Of links to one target on a page the best counts, the first of equal
    ones; pending links of equal score keep their order.
    """
    budget, deepest = min(max(max_pages or 10, 1), 20), min(max(max_depth or 2, 1), 3)
    pages = pages.select("site", "url", "root", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    links = links.select("site", "url", "seq", "target", F.coalesce("anchor", F.lit("")).alias("anchor"), F.coalesce("box", F.lit("")).alias("box"))
    roots = cut(pages.where("root").groupBy("site").agg(F.min("url").alias("url")))
    number = lambda *xs: F.array(*xs).cast("array<long>")
    pending = roots.select("site", "url", F.lit(0).alias("depth"), F.lit("").alias("anchor"), F.lit("").alias("box"), F.lit(1000).alias("score"), F.lit("HOMEPAGE").alias("intent"), number(F.lit(-1000)).alias("place"))
    state = roots.select("site", F.array().cast("array<string>").alias("have"), F.lit(0).alias("n"), F.lit(False).alias("completed"), F.array().cast("array<string>").alias("seen"))
    visits, ends = [], []
    for turn in range(budget + 1):
        best = pending.groupBy("site").agg(F.min(F.struct("place", "url", "depth", "intent")).alias("best"), F.max("score").alias("top"))
        state = cut(state.join(best, "site", "left").withColumn("stop_reason", _stop(state, budget, early_exit, people)))
        ends.append(state.where("stop_reason IS NOT NULL").select("site", "stop_reason"))
        on = state.where("stop_reason IS NULL").select("site", "have", "n", "seen", "best.url", "best.depth", "best.intent")
        if turn == budget or on.isEmpty():
            break
        seen = on.join(pages.select("site", "url", "found"), ["site", "url"], "left").withColumn("completed", F.col("found").isNotNull())
        have = F.array_union("have", F.coalesce("found", F.array().cast("array<string>")))
        seen = cut(seen.select("site", "url", "depth", "intent", "completed", have.alias("have"), (F.col("n") + 1).alias("n"), F.array_append("seen", F.col("url")).alias("seen")))
        visits.append(seen.select("site", "url", F.col("n").alias("visit"), F.when(F.col("completed"), "completed").otherwise("failed").alias("status"), F.when(F.col("completed"), F.col("intent")).otherwise("GENERIC").alias("intent"), "depth"))
        state = seen.select("site", "have", "n", "completed", "seen")
        if turn + 1 < budget:
            pending = cut(_queue(pending, seen, links, deepest, people))
        else:
            pending = cut(_kept(pending, seen, people))
    stops = reduce(DataFrame.unionByName, ends)
    return reduce(DataFrame.unionByName, visits).join(stops, "site").withColumn("pages_budget", F.lit(budget))


def _kept(pending: DataFrame, seen: DataFrame, people: bool) -> DataFrame:
    """Pending links without the visited ones, scored anew at sites whose page was there. `place` is what they are ordered
    by: the score, then the order they had before, in which the last score comes first."""
    now = seen.select("site", F.col("url").alias("visited"), "completed", _lacks(F.col("have"), people).alias("lacks"))
    left = pending.join(now, "site").where(F.col("url") != F.col("visited"))
    score = F.when(F.col("completed"), priority(F.col("url"), F.col("anchor"), F.col("depth"), F.col("box"), F.col("lacks"))).otherwise(F.col("score"))
    kind = F.when(F.col("completed"), intent(F.col("url"), F.col("anchor"))).otherwise(F.col("intent"))
    left = left.withColumns({"new": score, "kind": kind})
    before = F.concat(F.array(-F.col("new"), -F.col("score"), F.lit(0)).cast("array<long>"), F.expr("slice(place, 2, greatest(size(place) - 1, 0))"))
    return left.select("site", "url", "depth", "anchor", "box", F.col("new").alias("score"), F.col("kind").alias("intent"), F.when(F.col("completed"), before).otherwise(F.col("place")).alias("place"))


def _queue(pending: DataFrame, seen: DataFrame, links: DataFrame, deepest: int, people: bool) -> DataFrame:
    """What is pending after a round: what was, and the visited pages' links that neither are nor were."""
    pages = seen.where(F.col("completed") & (F.col("depth") < deepest)).select("site", "url", "depth", "seen", _lacks(F.col("have"), people).alias("lacks"))
    out = links.join(pages, ["site", "url"]).where((F.col("target") != F.col("url")) & ~F.array_contains("seen", F.col("target"))).withColumn("depth", F.col("depth") + 1)
    out = out.withColumn("score", priority(F.col("target"), F.col("anchor"), F.col("depth"), F.col("box"), F.col("lacks"))).where(F.col("score") > LOWEST)
    once = out.groupBy("site", "target").agg(F.min(F.struct((-F.col("score")).alias("p"), "seq", "anchor", "box", "depth")).alias("b"), F.min("seq").alias("seq"))
    once = once.join(pending.select("site", F.col("url").alias("target")), ["site", "target"], "left_anti")
    score = -F.col("b.p")
    new = once.select("site", F.col("target").alias("url"), "b.depth", "b.anchor", "b.box", score.alias("score"), intent(F.col("target"), F.col("b.anchor")).alias("intent"), F.array(F.col("b.p"), F.col("b.p"), F.lit(1), F.col("seq")).cast("array<long>").alias("place"))
    return _kept(pending, seen, people).unionByName(new)


def stats(visits: DataFrame) -> DataFrame:
    """(site, pages_scanned, completed, failed, high_value, deepest, stopped_early, stop_reason, pages_budget)."""
    done = F.col("status") == "completed"
    early = F.first("stop_reason").isin("all_requested_fields_satisfied", "no_more_relevant_pages")
    return visits.groupBy("site").agg(F.count("*").alias("pages_scanned"), F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), F.count_if(done & F.col("intent").isin(*HIGH_VALUE)).alias("high_value"), F.max("depth").alias("deepest"), early.alias("stopped_early"), F.first("stop_reason").alias("stop_reason"), F.first("pages_budget").alias("pages_budget"))
