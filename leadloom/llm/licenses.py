"""License scans: keyword-gated signature rules with priorities and interval-containment suppression."""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows
from .license_rules import BASE, Rule, rules

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # in lower-cased UTF-8: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`


class Hit(NamedTuple):
    label: str
    start: int  # first word
    end: int  # word after the last
    priority: int
    confidence: float


class Scanner:
    """All rules behind one keyword gate: only rules whose keywords all occur among a text's words are tried."""

    def __init__(self, own: list[Rule] | None = None):
        self.rules = rules() if own is None else own
        self.gate: dict[bytes, list[int]] = defaultdict(list)
        self.always = []
        for i, r in enumerate(self.rules):
            if r.keywords:
                self.gate[max(r.keywords, key=lambda w: (len(w), w))].append(i)
            else:
                self.always.append(i)
        self.keys = frozenset(k for r in self.rules for k in r.keywords)
        self.base = [(label, re.compile(b"(?<![^ ])" + p.encode() + b"(?![^ ])"), p.encode()) for label, p in BASE]

    def scan(self, text: str | None) -> tuple[int, list[Hit], list[Hit]]:
        """(number of words, base hits, the rules' hits that no other hit suppresses)."""
        words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        here = self.keys.intersection(words)
        line = b" ".join(words)
        base = [(label, p) for label, p, raw in self.base if raw in line]
        tried = sorted(i for k in here for i in self.gate.get(k, ()) if self.rules[i].keywords <= here) + self.always
        if not base and not tried:
            return len(words), [], []
        starts = None
        found: list[Hit] = []

        def place(m: re.Match) -> tuple[int, int]:
            nonlocal starts
            if starts is None:
                starts = [0, *(x.end() for x in re.finditer(b" ", line))]
            return bisect.bisect_right(starts, m.start()) - 1, bisect.bisect_left(starts, m.end())

        sure = [Hit(label, *place(m), 9, 0.9) for label, p in base for m in p.finditer(line)]
        for i in tried:
            r = self.rules[i]
            found += [Hit(r.label, *place(m), r.priority, r.confidence) for m in r.pattern.finditer(line)]
        return len(words), sorted(sure, key=lambda h: (h.start, h.end)), suppress(found)


def suppress(hits: list[Hit]) -> list[Hit]:
    """Hits by start, without those contained in a kept hit of higher priority, or of the same and at least as long.

    Priorities are few: for each, from the highest, hits that a kept one of a higher priority contains go, then those
    that another of the same priority contains. With hits ordered by start, "contained in an earlier one" is "ends no
    later than the largest end so far", so each priority is one sort and one walk over what is kept so far.
    """
    kept: list[Hit] = []  # by start
    for priority in sorted({h.priority for h in hits}, reverse=True):
        new, reach, i = [], -1, 0
        inside = -1  # largest end of this priority's hits so far
        for h in sorted((h for h in hits if h.priority == priority), key=lambda h: (h.start, -h.end)):
            while i < len(kept) and kept[i].start <= h.start:
                reach = max(reach, kept[i].end)
                i += 1
            if h.end > reach and h.end > inside:
                new.append(h)
                inside = h.end
        kept = sorted(kept + new, key=lambda h: (h.start, h.end, h.label))
    return kept


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, hits): arrays of (label, start, end, priority, confidence), in words from 0."""
    hit = "array<struct<label:string,start:int,end:int,priority:int,confidence:double>>"
    arrow = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32()), ("confidence", pa.float64())]))

    def make():
        s = scanner()

        def one(key, text):
            n, base, hits = s.scan(text)
            return key, n, [h._asdict() for h in base], [h._asdict() for h in hits]

        return lambda keys, texts: tuple(zip(*map(one, keys, texts)))

    return map_rows(docs, ["doc_id", "text"], make, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", arrow), ("hits", arrow)]), f"doc_id long, n_words long, base {hit}, hits {hit}")


DIGEST = """
SELECT doc_id, n_words, cast(size(base) AS bigint) AS n_base,
  cast(array_min(transform(base, h -> h.start)) AS bigint) AS first_word, cast(array_max(transform(base, h -> h.start)) AS bigint) AS last_word,
  array_join(array_sort(array_distinct(transform(base, h -> h.label))), ',') AS base_labels,
  array_join(array_sort(array_distinct(transform(concat(base, hits), h -> h.label))), ',') AS labels,
  1D - aggregate(concat(base, hits), 1D, (p, h) -> p * (1D - h.confidence)) AS score
FROM {hits}
"""


def op1(spark, docs: DataFrame) -> DataFrame:
    """The contract of op1_license_scan; score is one minus the chance that every hit is wrong.

    Null and empty texts have no words, empty labels, null first_word and last_word, and score 0. Repeated rows repeat;
    an empty table gives no rows. One pass over the texts, no shuffle.
    """
    return spark.sql(DIGEST, hits=detect(docs))
