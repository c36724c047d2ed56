"""Secret scans: probabilistic automata inferred from labelled credentials score every candidate string.

learn() builds a prefix tree of the credentials of one format and merges states whose outgoing frequencies are
statistically compatible (Hoeffding bound, red-blue order): ALERGIA. A candidate's score is its log-likelihood a
character under the best format's automaton over that under a background model of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_arrow, map_rows, pieces, release

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PART = re.compile("[^=]+")
_BORDERS = "/._+-"
_DELIMITER = re.compile(f"[{_BORDERS}]")

ALPHA = 0.05  # of the merge test
SEED = 20  # of the labelled credentials
EACH = 200  # labelled credentials a format
FLOOR = -6.0  # nats a character that no ordinary string falls below
MARGIN = 0.3  # nats a character by which a format must beat ordinary strings
NAMES = string.ascii_letters + string.digits


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def labelled(seed: int = SEED, each: int = EACH) -> dict[str, tuple[int, list[str]]]:
    """Format -> (length of its fixed head, labelled credentials), made from a seed; nothing here was ever in use."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choices(chars, k=n))
    b32, b64, hexa = string.ascii_uppercase + "234567", NAMES + "-_", "0123456789abcdef"
    forms = {
        "aws": (4, lambda: r.choice(("AKIA", "ASIA")) + some(b32, 16)),
        "github": (4, lambda: r.choice(("ghp_", "gho_", "ghs_", "ghu_")) + some(NAMES, 36)),
        "gitlab": (6, lambda: "glpat-" + some(b64, 20)),
        "slack": (5, lambda: r.choice(("xoxb-", "xoxp-", "xoxa-")) + some(string.digits, 12) + "-" + some(string.digits, 12) + "-" + some(NAMES, 24)),
        "stripe": (8, lambda: r.choice(("sk_live_", "sk_test_", "rk_live_")) + some(NAMES, 24)),
        "google": (4, lambda: "AIza" + some(b64, 35)),
        "jwt": (3, lambda: "eyJ" + some(NAMES, r.randint(15, 48)) + ".eyJ" + some(NAMES, r.randint(20, 160)) + "." + some(b64, 43)),
        "sendgrid": (3, lambda: "SG." + some(b64, 22) + "." + some(b64, 43)),
        "npm": (4, lambda: "npm_" + some(NAMES, 36)),
        "hexkey": (0, lambda: some(hexa, r.choice((24, 32, 40, 64)))),
        "uuid": (0, lambda: "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))),
        "opaque": (0, lambda: some(NAMES, r.randint(24, 48))),
    }
    return {kind: (head, [form() for _ in range(each)]) for kind, (head, form) in forms.items()}


def ordinary(seed: int = SEED, each: int = EACH) -> dict[str, tuple[int, list[str]]]:
    """What is no credential: words, names in camel case or with marks, numbers, addresses and versions."""
    r = random.Random(seed + 1)
    syllables = "a e i o u an er in on re th ti es st le la co de ment tion ing ous lich ung keit eau que ado er os".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(2, 8)))
    digits = lambda n: "".join(r.choices(string.digits, k=n))
    return {
        "words": (0, [word() for _ in range(2 * each)]),
        "camel": (0, ["".join([word(), *(word().title() for _ in range(r.randint(1, 5)))]) + r.choice(("", "", digits(1), digits(3))) for _ in range(each)]),
        "classes": (0, [r.choice(("", "_", ".")).join(word().title() for _ in range(r.randint(2, 6))) for _ in range(each)]),
        "names": (0, [r.choice("_-./").join(w.title() if r.random() < 0.3 else w for w in (word(), word(), word())) + r.choice(("", digits(1), digits(4))) for _ in range(each)]),
        "upper": (0, [(word() + r.choice(("", "_", "-", digits(2))) + word() + r.choice(("", digits(2)))).upper() for _ in range(each)]),
        "numbers": (0, [r.choice(("", "+")) + digits(r.randint(8, 24)) for _ in range(each)]),
        "marked": (0, [r.choice("-./").join(digits(r.randint(1, 5)) for _ in range(r.randint(3, 6))) for _ in range(each)]),
    }


_CLASS = {c: "0" if c in string.digits else "f" if c in "abcdef" else "z" if c in string.ascii_lowercase else "F" if c in "ABCDEF" else "Z" for c in NAMES}
_CLASSES = str.maketrans(_CLASS)
_WIDTH = {"0": math.log(10), "f": math.log(6), "z": math.log(20), "F": math.log(6), "Z": math.log(20)}
FEW = 8  # labelled lengths up to which a format has just these; beyond, all between the shortest and the longest


def symbols(s: str, head: int) -> list[str]:
    """The characters of a format's fixed head as such (marked by =), then digits, hex letters and letters as classes."""
    return [*(f"={c}" for c in s[:head]), *s[head:].translate(_CLASSES)]


class Automaton(NamedTuple):
    """Probabilistic automaton: moves[state] has symbol -> (next state, log probability of a character of that class);
    ends[state] is that of the end; lengths are those a string may have, by the examples it was learned from."""

    head: int
    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    lengths: frozenset[int] | range

    @property
    def longest(self) -> int:
        return max(self.lengths)

    def begins(self) -> dict[str, tuple[int, float]]:
        """The fixed heads that the format was learned with, and the state and log-likelihood after each."""
        paths = [("", 0, 0.0)]
        for _ in range(self.head):
            paths = [(p + k[1:], to, total + x) for p, at, total in paths for k, (to, x) in self.moves[at].items() if k[0] == "=" and len(k) > 1]
        return {p: (at, total) for p, at, total in paths if p}

    def walk(self, classes: str, at: int = 0, total: float = 0.0) -> list[float]:
        """Log-likelihood, with its end, of each prefix of the classes, as far as the automaton can go on."""
        moves, ends = self.moves, self.ends
        out = [total + ends[at]]
        for c in classes:
            step = moves[at].get(c)
            if step is None:
                break
            at = step[0]
            total += step[1]
            out.append(total + ends[at])
        return out


def learn(examples: Iterable[str], head: int = 0, alpha: float = ALPHA) -> Automaton:
    """ALERGIA: a prefix tree of the examples, whose states merge where the Hoeffding bound can't tell them apart."""
    kids: list[dict[str, int]] = [{}]
    out: list[Counter] = [Counter()]
    ends, visits = [0], [0]
    sizes = set()
    for s in examples:
        at = 0
        visits[0] += 1
        sizes.add(len(s))
        for k in symbols(s, head):
            out[at][k] += 1
            if k not in kids[at]:
                kids[at][k] = len(kids)
                kids.append({})
                out.append(Counter())
                ends.append(0)
                visits.append(0)
            at = kids[at][k]
            visits[at] += 1
        ends[at] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            limit = width * (visits[a] ** -0.5 + visits[b] ** -0.5)
            if limit < 1 and any(abs(x / visits[a] - y / visits[b]) > limit for x, y in [(ends[a], ends[b]), *((out[a][k], out[b][k]) for k in {*out[a], *out[b]})]):
                return False
            todo += [(kids[a][k], kids[b][k]) for k in kids[b] if k in kids[a] and kids[a][k] != kids[b][k]]
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            visits[a] += visits[b]
            ends[a] += ends[b]
            out[a].update(out[b])
            for k, child in kids[b].items():
                if k in kids[a]:
                    todo.append((kids[a][k], child))
                else:
                    kids[a][k] = child

    red = [0]
    while blue := next(((r, k) for r in red for k in sorted(kids[r]) if kids[r][k] not in red), None):
        parent, k = blue
        b = kids[parent][k]
        same = next((r for r in red if (k[0] != "=" or len(k) == 1) and compatible(r, b)), None)
        if same is None:
            red.append(b)
        else:
            kids[parent][k] = same
            fold(same, b)
    number = {r: i for i, r in enumerate(red)}
    moves = [{k: (number[kids[r][k]], math.log(n / visits[r]) - _WIDTH.get(k, 0.0)) for k, n in out[r].items()} for r in red]
    lengths = frozenset(sizes) if len(sizes) <= FEW else range(min(sizes), max(sizes) + 1)
    return Automaton(head, moves, [math.log(max(ends[r], 0.01) / visits[r]) for r in red], lengths)


class Grammar(NamedTuple):
    formats: dict[str, Automaton]
    plain: list[Automaton]
    heads: dict[str, list[tuple[str, int, float]]]  # fixed head -> (format, state and log-likelihood after it)
    head: re.Pattern  # where a format's fixed head begins
    shortest: int  # characters of the shortest labelled credential: no format takes fewer
    longest: int  # and of the longest: nothing is followed further
    candidate: re.Pattern  # runs of credential characters of the shortest length and more

    @classmethod
    def build(cls, seed: int = SEED, each: int = EACH, alpha: float = ALPHA) -> Grammar:
        known = labelled(seed, each)
        formats = {k: learn(x, head, alpha) for k, (head, x) in known.items()}
        heads: dict[str, list[tuple[str, int, float]]] = {}
        for k, a in formats.items():
            for h, (at, total) in a.begins().items():
                heads.setdefault(h, []).append((k, at, total))
        shortest, longest = min(min(a.lengths) for a in formats.values()), max(a.longest for a in formats.values())
        plain = [learn(x, head, alpha) for head, x in ordinary(seed, each).values()]
        return cls(formats, plain, heads, re.compile(f"(?=({'|'.join(map(re.escape, sorted(heads)))}))"), shortest, longest, re.compile(f"[A-Za-z0-9+/_.=-]{{{shortest},}}"))

    def ordinary(self, classes: str) -> list[float]:
        """Log-likelihood of each prefix as an ordinary string; at least FLOOR a character."""
        out = [FLOOR * i for i in range(len(classes) + 1)]
        for a in self.plain:
            for i, x in enumerate(a.walk(classes)):
                if x > out[i]:
                    out[i] = x
        return out

    def find(self, s: str, margin: float = MARGIN) -> list[tuple[int, int, str]]:
        """(start, end, format) of the credentials in a run of credential characters, apart from each other.

        They start after a delimiter or where a format's head begins; they end before a delimiter, at the run's end, or,
        for a format with a head, where the format cannot go on. Of a start's lengths that the format was labelled with
        the one is taken that gains most over an ordinary string, if it gains the margin a character; of overlapping
        ones the leftmost is taken, of those that start together the one that gains most. A start is followed no
        further than the longest labelled credential, so the work is linear in the run.
        """
        classes, n, out, free = s.translate(_CLASSES), len(s), [], 0
        heads = {m.start(): m[1] for m in self.head.finditer(s)}
        starts = {0, *(m.end() for m in _DELIMITER.finditer(s))}
        for start in sorted(starts | heads.keys()):
            if start < free:
                continue
            if n - start < self.shortest:
                break
            part = classes[start : start + self.longest + 1]
            walks = [(kind, 0, a.walk(part[: a.longest])) for kind, a in self.formats.items() if not a.head] if start in starts else []
            for kind, at, total in self.heads.get(heads.get(start, ""), ()):
                a = self.formats[kind]
                walks.append((kind, a.head, a.walk(part[a.head : a.longest], at, total)))
            best, plain = (0.0, 0, ""), None
            for kind, head, upto in walks:
                stop, a = head + len(upto) - 1, self.formats[kind]  # the format cannot go on there, or it is as long as it gets
                if stop < min(a.lengths):
                    continue
                for size in sorted(x for x in a.lengths if x <= stop):
                    if size == len(part) or part[size] in _BORDERS or (head and size == stop):
                        plain = plain or self.ordinary(part)
                        gain = upto[size - head] - plain[size]
                        if gain >= margin * size:
                            best = max(best, (gain, start + size, kind))
            if best[2]:
                out.append((start, best[1], best[2]))
                free = best[1]
        return out


def base_spans(text: str) -> list[Span]:
    """The contract's matches, leftmost and non-overlapping by kind, without the failing ones; whole matches."""
    out = [Span(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [Span(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [Span(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def format_spans(text: str, grammar: Grammar) -> list[Span]:
    """Credentials inside the runs of credential characters that are as long as the shortest credential or longer; runs
    end before a sign of equality and lose their last stops."""
    out = []
    for m in grammar.candidate.finditer(text):
        for part in _PART.finditer(m[0].rstrip(".=")):
            if len(part[0]) >= grammar.shortest:
                at = m.start() + part.start()
                out += [Span(at + start, at + end, kind) for start, end, kind in grammar.find(part[0])]
    return out


_GRAMMAR: list[Grammar] = []


def grammar() -> Grammar:
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar.build())
    return _GRAMMAR[0]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span (for assignments only the value) replaced by [SECRET]; overlapping spans become one."""
    marks = []
    for s in spans:
        if s.kind == "assign":
            m = _ASSIGN.fullmatch(text, s.start, s.end)
            marks.append((m.start(2), s.end))
        else:
            marks.append((s.start, s.end))
    out, at = [], 0
    for a, b in sorted(marks):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op4(spark, docs: DataFrame) -> DataFrame:
    """The contract of op4_secret_scan. Kinds beyond the base three are the formats' names.

    Null and empty texts have no spans (empty string, hash of no bytes); repeated rows repeat; no rows, no result.
    One pass over the texts, no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])

    def make():
        g = grammar()

        def one(key, text):
            base = base_spans(text or "")
            n = Counter(s.kind for s in base)
            every = sorted({*base, *format_spans(text or "", g)}, key=lambda s: (s.start, KINDS.index(s.kind) if s.kind in KINDS else 3, s.kind, s.end))
            return key, *(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)

        return lambda keys, texts: tuple(zip(*map(one, keys, texts)))

    return map_rows(docs, ["doc_id", "text"], make, schema, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets redacted: a document is kept, a credential is not. n_chars follows the text.

    Null texts stay null, texts without secrets stay as they are; repeated rows repeat; no rows, no result.
    """
    columns, types = docs.columns, dict(docs.dtypes)
    at = columns.index("text")

    def run(batches):
        g = grammar()
        for batch in pieces(batches):
            texts = batch.column(at).to_pylist()
            new = [None if t is None else redact(t, base_spans(t) + format_spans(t, g)) for t in texts]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in columns:
                old = batch.column(columns.index("n_chars")).to_pylist()
                cols[columns.index("n_chars")] = pa.array([n if a == b else len(b) for n, a, b in zip(old, texts, new)], batch.column(columns.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)
        release()

    return in_arrow(docs, run, ", ".join(f"`{c}` {types[c]}" for c in columns))
