"""Toxicity by weak supervision.

Voters vote for a label or abstain: hand-written lexicons and patterns (see toxicity_voters), single terms (words and
word beginnings, that occur or are dense) that lean towards either label in labelled documents, and the label itself
where there is one. A generative model of the votes given the unseen true label, a tree of pairwise dependences for each
label (so that each voter's accuracy, its abstentions and its correlation with another are estimated), is fitted to
all documents that may be learned from by expectation maximisation. A linear classifier over voters and terms is
trained on the model's posteriors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, maybe_broadcast, pieces, release, table
from .near_duplicates import row_id
from .toxicity_voters import OF_WORD, VOTERS, Text, cast

LABELLED = 24_000  # labelled documents that terms are mined from, at most about, half of each label where there are so many
FITTED = 30_000  # documents that the classifier is trained on, at most about
TERMS = 2000  # mined terms
MINED = 60  # of which vote too
BEGINNINGS = (3, 4, 5, 6)  # lengths of word beginnings
DENSE = 0.006  # share of a text's words at which a term is dense
ROUNDS = 4  # of expectation maximisation
TRUST = 0.98  # accuracy of the given labels
THRESHOLD = 0.3
SCALE = 1 << 20  # posteriors are summed as whole numbers, so that reruns agree

_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 100_000  # words whose terms a task keeps


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked *)."""
    return [word] + [word[:n] + "*" for n in BEGINNINGS if len(word) > n]


def occurring(words: Counter, look: Callable[[str], Iterable]) -> Counter:
    """How often each of the terms look(word) occurs among a text's words."""
    n: Counter = Counter()
    for word, times in words.items():
        for t in look(word):
            n[t] += times
    return n


def is_dense(times: int, words: int) -> bool:
    return times > 1 and times >= DENSE * words


def held_out() -> Column:
    return F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2"), F.lit(False))


def _share(limit: int, n: int) -> Column:
    """A condition on the id's hash that about `limit` of n rows meet."""
    return F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(1 << 30)) < F.lit(int(min(1.0, limit / max(1, n)) * (1 << 30)))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic 0/1), one row an id, of rows that may be learned from; the larger label where rows disagree."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def mine(docs: DataFrame, labels: DataFrame) -> list[str]:
    """Terms by the strength with which they tell the labels apart, voters first; TERMS at most.

    Counts are made by task and summed by term in a shuffle; the driver gets the best TERMS only.
    """
    of = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    some = cut(labels.where(F.when(F.col("toxic") == 1, _share(LABELLED // 2, of.get(1, 0))).otherwise(_share(LABELLED // 2, of.get(0, 0)))))
    rows = docs.select("doc_id", "text").join(maybe_broadcast(some), "doc_id").select("text", "toxic")

    def count(batches):
        for part in pieces(batches):
            n = (Counter(), Counter())
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = Counter(_WORD.findall((text or "").lower()))
                size = words.total()
                for t, times in occurring(words, terms_of).items():
                    n[toxic][t] += 1
                    n[toxic][t + "^"] += is_dense(times, size)
            keys = sorted({k for c in n for k, x in c.items() if x})
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["term", "pos", "neg"])
        release()

    totals = {r["toxic"]: r["count"] for r in some.groupBy("toxic").count().collect()}
    p, q = totals.get(1, 0), totals.get(0, 0)
    if not p or not q:
        return []
    odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (q + 1.0))
    found = in_arrow(rows, count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg >= 5").withColumn("odds", odds)
    toxic = found.where("odds > 1").orderBy(F.desc(F.round(F.col("odds") * F.sqrt("pos"), 9)), "term").limit(TERMS * 3 // 4).collect()
    clean = found.where("odds < -1").orderBy(F.round(F.col("odds") * F.sqrt("neg"), 9), "term").limit(TERMS // 4).collect()
    return [r["term"] for r in toxic] + [r["term"] for r in clean]


def features(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, row_id, terms array<int>) of every whole text: numbers of the hand-written voters that vote, then those of
    the mined terms that occur (a term's dense form is marked ^), in order."""
    first = len(VOTERS)
    number = {t: first + i for i, t in enumerate(terms)}

    def run(batches):
        known: dict[str, tuple] = {}

        def look(word: str) -> tuple:
            got = known.get(word)
            if got is None:
                if len(known) >= _CACHE:
                    known.clear()
                got = known[word] = (*(t for t in terms_of(word) if t in number or t + "^" in number), *OF_WORD.get(word, ()))
            return got

        def numbers(text: str | None) -> list[int]:
            lower = (text or "").lower()
            words = Counter(_WORD.findall(lower))
            size, n = words.total(), occurring(words, look)
            out = cast(Text(lower, size, {t: x for t, x in n.items() if isinstance(t, int)}))
            mined = [(t, x) for t, x in n.items() if isinstance(t, str)]
            return out + sorted([number[t] for t, _ in mined if t in number] + [number[t + "^"] for t, x in mined if t + "^" in number and is_dense(x, size)])

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([numbers(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "row_id", "terms"])
        known.clear()
        release()

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text", row_id().alias("row_id")), run, "doc_id long, row_id long, terms array<int>")


def _ballots(votes: list[list[int]], k: int) -> np.ndarray:
    """A row of 0 (abstains) and 1 (votes) for each list of voters."""
    out = np.zeros((len(votes), k), np.int8)
    out[np.repeat(np.arange(len(votes)), [len(v) for v in votes]), np.array([i for v in votes for i in v], np.int64)] = 1
    return out


class LabelModel:
    """P(label) and, for each label, P(vote | label, parent's vote) along a tree over the voters."""

    def __init__(self, pairs: np.ndarray, totals: np.ndarray, silent: int = len(VOTERS)):
        """pairs[c, i, j]: documents of label c for which voters i and j both vote (i = j: i votes); totals[c]: documents;
        the first `silent` voters say nothing where they abstain."""
        k, self.silent = pairs.shape[1], silent
        self.k, self.prior = k, (totals + 1.0) / (totals.sum() + 2.0)
        n = totals[:, None, None] + 4.0
        one = (np.einsum("cii->ci", pairs) + 2.0) / n[:, :, 0]
        both = (pairs + 1.0) / n
        info = np.zeros((k, k))
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (one if a else 1 - one)[:, :, None], (one if b else 1 - one)[:, None, :]
                joint = both if a and b else one[:, :, None] - both if a else one[:, None, :] - both if b else 1 - one[:, :, None] - one[:, None, :] + both
                joint = np.maximum(joint, 1e-9)
                info += np.einsum("c,cij->ij", self.prior, joint * np.log(joint / (pa_ * pb)))
        self.parent = np.full(k, -1)
        inside, best, via = np.zeros(k, bool), np.full(k, -np.inf), np.full(k, -1)
        for _ in range(k):  # the tree of largest mutual information given the label
            i = int(np.where(inside, -np.inf, np.where(best == -np.inf, -1e9, best)).argmax())
            inside[i], self.parent[i] = True, via[i]
            closer = ~inside & (info[i] > best)
            best[closer], via[closer] = info[i][closer], i
        # log P(vote = v | parent's vote = u, label c): [c, i, u, v]
        self.table = np.zeros((2, k, 2, 2))
        for i, j in enumerate(self.parent):
            for c in (0, 1):
                yes = one[c, j] if j >= 0 else 1.0
                p1 = both[c, i, j] / yes if j >= 0 else one[c, i]
                p0 = (one[c, i] - both[c, i, j]) / max(1e-9, 1 - yes) if j >= 0 else one[c, i]
                for u, p in ((1, p1), (0, p0)):
                    p = min(max(p, 1e-5), 1 - 1e-5)
                    self.table[c, i, u] = np.log([1 - p, p])

    def posterior(self, ballots: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) by the votes and the label given (not a number: none). A hand-written voter that
        abstains says nothing (there are voters for clean texts), so its abstentions cancel; the absence of a term counts."""
        v = ballots.astype(np.int64)
        u = np.where(self.parent >= 0, v[:, self.parent], 0)
        score = [np.log(self.prior[c]) + (self.table[c][np.arange(self.k), u, v] * (v | (np.arange(self.k) >= self.silent))).sum(1) + np.where(np.isnan(label), 0.0, np.log(np.where(label == c, TRUST, 1 - TRUST))) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))


def fit_label_model(patterns: DataFrame, k: int, silent: int = len(VOTERS)) -> LabelModel:
    """Expectation maximisation over (votes array<int>, toxic or null, n), started from the labelled rows.

    A round is one pass: each task sums posterior-weighted pairs of votes, k x k numbers are summed in a shuffle.
    """

    def moments(model: LabelModel | None):
        def run(batches):
            total, pairs = np.zeros(2, np.int64), np.zeros((2, k, k), np.int64)
            for b in pieces(batches, 4096):
                ballots, n = _ballots(b.column(0).to_pylist(), k), np.asarray(b.column(2)).astype(np.float64)
                label = np.array([np.nan if x is None else x for x in b.column(1).to_pylist()], float)
                p = np.where(label == 1, TRUST, 1 - TRUST) if model is None else model.posterior(ballots, label)
                use = ~np.isnan(label) if model is None else np.ones(len(p), bool)
                votes = ballots.astype(np.float64)
                for c, w in ((0, n * (1 - p) * use), (1, n * p * use)):
                    w = np.round(w * SCALE)
                    total[c] += int(w.sum())
                    pairs[c] += np.round(votes.T @ (votes * w[:, None])).astype(np.int64)
            lines = np.zeros((2 * k + 2, k), np.int64)
            lines[: 2 * k], lines[2 * k :, 0] = pairs.reshape(2 * k, k), total
            yield pa.RecordBatch.from_arrays([pa.array(range(2 * k + 2), pa.int32()), pa.array(lines.tolist(), pa.list_(pa.int64()))], names=["line", "cells"])

        sums = [F.sum(F.col("cells")[j]).alias(f"c{j}") for j in range(k)]
        flat = np.zeros((2 * k + 2, k))
        for r in in_arrow(patterns, run, "line int, cells array<long>").groupBy("line").agg(*sums).collect():  # 2 k + 2 rows
            flat[r["line"]] = np.array(r[1:]) / SCALE
        return LabelModel(flat[: 2 * k].reshape(2, k, k), flat[2 * k :, 0], silent)

    model = moments(None)
    for _ in range(ROUNDS):
        model = moments(model)
    return model


def train(rows: list[list[int]], target: np.ndarray, size: int, decay: float = 2e-5, steps: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by full-batch Adam."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.array([t for r in rows for t in r], np.int64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    for step in range(1, steps + 1):
        z = w[size] + np.bincount(owner, w[term], minlength=len(rows))
        gap = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(term, gap[owner], minlength=size), gap.sum()) / len(rows)
        g[:size] += decay * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, row_id, score) of every whole text; see op3."""
    learn = training_labels(labels)
    terms = mine(docs, learn)
    table_ = cut(features(docs, terms))
    if terms:
        k = len(VOTERS) + min(len(terms), MINED)
        seen = table_.where(~held_out()).join(learn, "doc_id", "left").withColumn("votes", F.filter("terms", lambda t: t < k))
        model = fit_label_model(cut(seen.groupBy("votes", "toxic").agg(F.count("*").alias("n")).select("votes", "toxic", "n")), k)
        fit = seen.where(F.col("doc_id").isNotNull() & _share(FITTED, seen.count())).select("doc_id", "votes", "toxic", "terms").orderBy("doc_id", "terms").toPandas()
        p = model.posterior(_ballots([list(v) for v in fit["votes"]], k), fit["toxic"].astype(float).to_numpy())
        weights, bias = train([list(t) for t in fit["terms"]], p, len(terms) + len(VOTERS))
    else:  # nothing to learn from: the hand-written voters decide alone
        weights, bias = np.array([1.5 if label else -0.5 for label, _ in VOTERS.values()]), -1.5
    pairs = F.array(*[F.lit(float(round(x, 9))) for x in weights])
    z = F.aggregate("terms", F.lit(float(bias)), lambda s, t: s + F.element_at(pairs, t + 1))
    return table_.select("doc_id", "row_id", F.round(1 / (1 + F.exp(-z)), 9).alias("score"))


def op3(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op3_toxicity.

    Null and empty texts have no terms: their score is the classifier's bias. Labels other than 0 and 1, and null ids,
    teach nothing; without both labels the hand-written voters decide alone. Texts that are held out (by id) take no part
    in anything that is learned. Repeated rows repeat.
    """
    return score(docs, labels).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic. Each row is judged by its own text, whatever its id. Columns come out
    as they went in, whatever their names."""
    found = score(docs, table(spark, sf_dir, "labels")).where(F.col("score") >= THRESHOLD)
    gone = cut(found.select(F.col("row_id").alias("toxic_row")).distinct())
    rows = docs.select(row_id().alias("toxic_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return rows.join(maybe_broadcast(gone), "toxic_row", "left_anti").select("document.*")
