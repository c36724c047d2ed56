"""Language identification by cross-parsing entropy.

Labelled text of each language goes into a suffix automaton. A text is parsed into longest matches against each one:
every phrase is the longest string, from where the last phrase ended, that the language's text contains. The language
that needs the fewest phrases, times the log of its text's length over the length parsed, wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, maybe_broadcast

DOCS = 20  # labelled documents a language at most, whole
DENSE = 1 << 25  # cells of automata kept as dense tables (4 bytes each); further languages have sorted transitions
GROUP = 16  # languages parsed in step
SEGMENT = 512  # characters that are parsed ahead in step; the parse from the segment before replaces it until they meet
SHARPNESS = 20.0  # of the score


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Labelled texts of every language, a bounded sample of each: DOCS rows a language at most.

    Rows of a language are drawn by their id's hash: a threshold keeps a few times DOCS of them, whatever their number,
    before they are ranked.
    """
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0")
    rows = rows.withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40))
    counts = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(8.0 * DOCS) / F.count("*")).alias("most"))
    few = rows.join(maybe_broadcast(cut(counts)), "lang").where("u <= most").select("lang", "u", "doc_id", F.col("text").alias("part"))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "part"))).where(F.col("n") <= DOCS)
    out: dict[str, list[str]] = {}
    for r in few.orderBy("lang", "n").collect():
        out.setdefault(r["lang"], []).append(r["part"])
    return out


class Alphabet:
    """Code points to classes: 0 for what is no letter, 1 for letters outside the labelled text, 2 and up for its letters."""

    def __init__(self, texts: list[str]):
        letters = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        number = {c: i + 2 for i, c in enumerate(letters)}
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.uint32 if self.size > 65_535 else np.uint16 if self.size > 255 else np.uint8)
        for cp in (*range(0xD800), *range(0xE000, 0x110000)):
            c = chr(cp)
            if c.isalpha():
                self.table[cp] = number.get(c.lower(), 1)

    def classes(self, text: str) -> np.ndarray:
        """Classes of the text's characters, runs of non-letters as one and none at the ends."""
        x = self.table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        if not len(x):
            return x
        keep = np.empty(len(x), bool)
        keep[0] = x[0] != 0
        np.not_equal(x[1:], 0, out=keep[1:])
        keep[1:] |= x[:-1] != 0
        x = x[keep]
        return x[:-1] if len(x) and x[-1] == 0 else x


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton whose paths from state 0 are the text's substrings (Blumer et al.)."""
    move: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        now = len(move)
        move.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(move)
                move.append(dict(move[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return move


class Group:
    """Automata of some languages, side by side: one table of moves, dense or as sorted keys with their next states."""

    def __init__(self, width: int, automata: list[tuple[int, np.ndarray]], dense: bool):
        """automata: (states, rows (state x width + letter, next state) in order) of each language."""
        sizes = np.array([n for n, _ in automata], np.int64) + 1  # the last state ends any phrase
        offsets = np.cumsum(sizes) - sizes
        self.width, self.dead, self.dense = width, (offsets + sizes - 1).astype(np.int32), dense
        self.keys = np.concatenate([own[:, 0] + offset * width for (_, own), offset in zip(automata, offsets)])
        self.next = np.concatenate([(own[:, 1] + offset).astype(np.int32) for (_, own), offset in zip(automata, offsets)])
        starts = [self.look(np.arange(width) + offset * width) for offset in offsets]
        self.starts = np.concatenate([np.where(x < 0, d, x) for x, d in zip(starts, self.dead)]).astype(np.int32)
        if dense:
            table = np.full(int(sizes.sum()) * width, -1, np.int32)
            table[self.keys] = self.next
            self.keys, self.next = None, table

    def look(self, cells: np.ndarray) -> np.ndarray:
        """Next states, -1 where there are none."""
        if self.keys is None:
            return self.next.take(cells)
        at = np.minimum(np.searchsorted(self.keys, cells), len(self.keys) - 1)
        return np.where(self.keys.take(at) == cells, self.next.take(at), np.int32(-1))

    def ahead(self, grid: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parses each lane from its first character: (last states by language and lane, whether a phrase begins by step,
        language and lane). The first active[step] lanes have a character at a step."""
        state = np.repeat(self.dead[:, None], grid.shape[1], 1)
        begins = np.zeros((len(grid), *state.shape), bool)
        base = (np.arange(len(self.dead), dtype=np.int64) * self.width)[:, None]
        for step, n in enumerate(active):
            c = grid[step, :n]
            now = self.look(state[:, :n].astype(np.int64) * self.width + c)
            miss = now < 0
            begins[step, :, :n] = miss
            state[:, :n] = np.where(miss, self.starts.take(base + c), now)
        return state, begins

    def phrases(self, grid: np.ndarray, size: np.ndarray, active: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by language and lane, whether they are not final) of texts in segments; after[lane]: the next one's lane or -1.

        Every segment is parsed ahead. Then the parse of the one before goes on into it, in place of what was parsed ahead,
        up to the first character where both begin a phrase: from there on they are the same. Where they meet nowhere in
        a whole segment with another one behind, the count isn't final.
        """
        state, begins = self.ahead(grid, active)
        count = begins.sum(0, dtype=np.int64)
        lanes = np.flatnonzero(after >= 0)
        lang, lane = np.repeat(np.arange(len(self.dead)), len(lanes)), np.tile(lanes, len(self.dead))
        now, into, open_ = state[lang, lane], after[lane], np.zeros(count.shape, bool)
        step = 0
        while len(lane):
            ends = size[into] <= step
            if ends.any():
                open_[lang[ends], lane[ends]] = after[into[ends]] >= 0
                lang, lane, now, into = lang[~ends], lane[~ends], now[~ends], into[~ends]
            c = grid[step, into] if len(lane) else np.zeros(0, np.int64)
            to = self.look(now.astype(np.int64) * self.width + c)
            miss, known = to < 0, begins[min(step, len(begins) - 1), lang, into]
            np.add.at(count, (lang, into), miss.astype(np.int64) - known)
            now = np.where(miss, self.starts.take(lang * self.width + c), to)
            go = ~(miss & known)
            lang, lane, now, into = lang[go], lane[go], now[go], into[go]
            step += 1
        return count, open_


class Model:
    """The automata of all languages in groups, so that many texts are parsed against a group's languages in step."""

    def __init__(self, labelled: dict[str, list[str]]):
        self.names = sorted(labelled)
        self.alphabet = Alphabet([t for k in self.names for t in labelled[k]])
        self.length, self.groups = [], []  # groups: (first language, Group)
        cells, some, width = 0, [], self.alphabet.size
        for i, k in enumerate(self.names):
            parts = [self.alphabet.classes(t) for t in labelled[k]]
            text = [int(c) for p in parts for c in (0, *p)] + [0]
            moves = suffix_automaton(text)
            self.length.append(len(text))
            dense = cells + (len(moves) + 1) * width <= DENSE
            if some and (dense != was or len(some) == GROUP):
                self.groups.append((i - len(some), Group(width, some, was)))
                some = []
            cells += (len(moves) + 1) * width * dense
            own = np.array([(s * width + c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int64)
            some.append((len(moves), own[np.argsort(own[:, 0])]))
            was = dense
        if some:
            self.groups.append((len(self.names) - len(some), Group(width, some, was)))

    def phrases(self, texts: list[np.ndarray], segment: int = 0) -> np.ndarray:
        """Phrases by text and language, of whole texts. Segments are lanes, longest first, moved one character a step."""
        segment = segment or SEGMENT
        cuts = [(i, at) for i, x in enumerate(texts) for at in range(0, len(x), segment)]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        if not cuts:
            return out
        owner = np.array([i for i, _ in cuts])
        size = np.array([min(segment, len(texts[i]) - at) for i, at in cuts])
        order = np.argsort(-size, kind="stable")
        place = np.argsort(order, kind="stable")
        after = np.where(np.append(owner[1:] == owner[:-1], False), np.append(place[1:], 0), -1)[order]
        owner, size = owner[order], size[order]
        grid = np.zeros((size[0], len(cuts)), np.int64)
        for lane, o in enumerate(order):
            i, at = cuts[o]
            grid[: size[lane], lane] = texts[i][at : at + segment]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        for first, group in self.groups:
            count, unsure = group.phrases(grid, size, active, after)
            for lang in range(len(count)):
                out[:, first + lang] = np.bincount(owner, weights=count[lang], minlength=len(texts))
            for i in np.unique(owner[unsure.any(0)]):  # such texts are parsed in one piece
                x = texts[i].astype(np.int64)[:, None]
                alone, _ = group.phrases(x, np.array([len(x)]), np.ones(len(x), np.int64), np.array([-1]))
                out[i, first : first + len(alone)] = alone[:, 0]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        classes = [self.alphabet.classes(t or "") for t in texts]
        counts, out = self.phrases(classes), []
        for x, n in zip(classes, counts):
            if not len(x) or not self.names:
                out.append(("und", 0.0))
                continue
            h = [int(p) * math.log2(size) / len(x) for p, size in zip(n, self.length)]
            best = min(range(len(h)), key=lambda i: (h[i], self.names[i]))
            out.append((self.names[best], 1.0 / sum(math.exp(-SHARPNESS * (y - h[best])) for y in h)))
        return out


_MODELS: dict[int, Model] = {}


def model(labelled: dict[str, list[str]]) -> Model:
    """One model for each worker process."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(labelled.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(labelled)
    return _MODELS[key]


def identify(docs: DataFrame, labelled: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text. One pass, no shuffle."""

    def make():
        m = model(labelled)
        return lambda keys, texts: (keys, *zip(*m.predict(texts)))

    return map_rows(docs, ["doc_id", "text"], make, pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]), "doc_id long, lang_pred string, score double")


def op7(spark, docs: DataFrame) -> DataFrame:
    """The contract of op7_language_id; score is the winner's share of exp(-SHARPNESS x phrase entropy) over languages.

    Null texts, texts without a letter, and all texts where nothing is labelled are `und` with score 0. Ties go to the
    smaller language code. A null doc_id is never learned from and not held out. Repeated rows repeat.
    """
    held = F.coalesce(F.expr("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0"), F.lit(False))
    return identify(docs, sample(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
