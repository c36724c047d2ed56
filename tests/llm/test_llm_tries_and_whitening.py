"""Whitening against numpy, the conversation trie against prefixes held in memory."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from leadloom.llm import conversation_trie, whitening

VECTORS = "vec_id long, embedding array<float>, size int, x binary, n long, cell int, value double"


def vectors(spark, rows, ddl=VECTORS):
    return spark.createDataFrame([(i, v, 1, b"x", 2, 3, 4.0) for i, v in rows], ddl)


def exact_whitening(rows):
    """{vec_id: (deviation, whitened)}, shares and n, from whole matrices and Python's integers."""
    usable = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    m = np.array([centred(x) for x in fit])
    v = m.T @ m / n
    values, found = np.linalg.eigh(v)
    values, found = values[::-1][:16], found[:, ::-1][:, :16]
    return [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), centred(x) @ found / np.sqrt(values)) for i, x in usable], values / np.trace(v), n


@pytest.mark.parametrize("dims", [5, 40])
def test_whitening(spark, dims):
    r = np.random.default_rng(dims)
    rows = [(i, [float(c) for c in r.standard_normal(dims) * np.linspace(2, 0.3, dims) + 50]) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(100)] + [(0, rows[0][1]), (None, rows[1][1])]
    rows += [(900, None), (901, []), (902, [None] * dims), (903, [math.nan] + [0.0] * (dims - 1)), (904, [math.inf] * dims), (905, [1.0] * (dims + 1))]
    out = whitening.op11(spark, vectors(spark, rows)).collect()
    expected, shares, n = exact_whitening([x for x in rows if x[0] != 905])
    k = min(16, dims)
    assert len(out) == k * len(expected) and {r["n"] for r in out} == {n} == {200}
    got = collections.defaultdict(list)
    for r in out:
        got[r["vec_id"], r["component"]].append(r)
    for c in range(k):
        one = [(got[i, c + 1][0], z) for i, _, z in expected]
        sign = math.copysign(1, sum(r["whitened"] * z[c] for r, z in one))
        assert max(abs(sign * r["whitened"] - z[c]) for r, z in one) < 1e-8
        assert all(abs(r["explained"] / shares[c] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r, _ in one)
    assert all({r["deviation"] for r in got[i, 1]} == {d} for i, d, _ in expected)


def test_whitening_of_little(spark):
    assert whitening.op11(spark, vectors(spark, [])).count() == 0
    assert whitening.op11(spark, vectors(spark, [(1, None), (2, [math.nan])])).count() == 0
    assert whitening.op11(spark, vectors(spark, [(1, [1.0, 2.0])] * 3)).count() == 0  # no variance, no component
    out = whitening.op11(spark, vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])])).collect()
    assert [(r["component"], abs(round(r["whitened"], 9)), round(r["explained"], 9), r["deviation"]) for r in out] == [(1, 1.0, 1.0, 2 * 64**2)] * 2
    far = whitening.op11(spark, vectors(spark, [(i, [3e38 * (i % 2), float(i)]) for i in range(9)])).collect()  # held at the limit
    assert {r["deviation"] is None for r in far} == {True}


def test_lanczos_restarts():
    times = lambda v: lambda q: v @ q
    same = np.diag([3.0] * 30 + [1.0] * 10 + [0.0] * 24)
    values, found = whitening.block_lanczos(times(same), 64)
    assert np.allclose(values, 3) and np.allclose(found.T @ found, np.eye(16))
    one = np.outer(np.arange(64.0), np.arange(64.0))
    values, found = whitening.block_lanczos(times(one), 64)
    assert np.isclose(values[0], (np.arange(64.0) ** 2).sum()) and abs(values[1:]).max() < 1e-6
    m = np.random.default_rng(1).standard_normal((900, 300)) * 0.97 ** np.arange(300)
    v, seen = m.T @ m, []
    values, found = whitening.block_lanczos(lambda q: seen.append(q.shape[1]) or v @ q, 300)
    assert sum(seen) < 300 and np.allclose(values, np.linalg.eigvalsh(v)[::-1][:16], rtol=1e-11) and abs(v @ found - found * values).max() < 1e-11 * values[0]


TURNS = "conv_id long, turn long, role string, text string, p int, ref long, depth long, key string, token string, h int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", "t", 4) for r in rows], TURNS)


def plain_trie(rows):
    """The nodes from every prefix of every rebuilt conversation, and how many there are."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    members, kids, done, out = collections.defaultdict(list), collections.defaultdict(set), {}, []
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
            if d:
                kids[tuple(ts[: d - 1])].add(tuple(ts[:d]))
    for n in sorted(members, key=len, reverse=True):
        saved = (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        done[n] = sum(done[k][0] for k in kids[n]) or 1, saved + sum(done[k][1] for k in kids[n])
        ends = ",".join(map(str, sorted(c for c in members[n] if len(built[c]) == len(n))))
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), *done[n], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def found_trie(spark, rows):
    return collections.Counter(tuple(r[c] for c in conversation_trie.NODE) for r in conversation_trie.op13(spark, turns(spark, rows)).collect())


@pytest.fixture(params=[1, 13])
def parts(spark, request):
    """Partitions that are left as many as they are, so that nodes span several."""
    conf = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_conversation_trie(spark, parts):
    r = random.Random(parts)
    rows = []
    for c in [*range(-20, 160), None]:
        for t in range(r.choice([1, 1, 2, 5, 14])):
            rows.append((c, r.choice([t, t, None]) if t == 0 else t, r.choice(["user", None, ""]), r.choice(["a", "é\U0001f600", "", None, "long " * 50])))
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]  # one conversation, many times
    rows += [(c, t, "user", "hi" if t < 2 else f"x{c}") for c in range(2000, 2200) for t in range(4)]  # one way to begin
    rows += [(5000, t, "user", "again") for t in range(300)] * 2
    assert found_trie(spark, rows) == plain_trie(rows)


def test_conversation_trie_with_very_many_children(spark, parts):
    many = conversation_trie.PENDING + 2000
    rows = [(c * 9, 0, "user", "begin") for c in range(many)] + [(c * 9, 1, "user", str(c)) for c in range(many)]
    rows += [(c * 9 + 1, 0, "user", w) for c, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)]
    assert found_trie(spark, rows) == plain_trie(rows)


def test_conversation_trie_of_little(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert found_trie(spark, []) == {} and found_trie(spark, [(None, 0, "user", "x")]) == {}
    h = zlib.crc32(b"7") % 9
    out = found_trie(spark, [(7, t, "user", "x") for t in range(h)])  # all its turns come from a conversation that isn't there
    assert out == {(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest()): 1}
    out = found_trie(spark, [(5, None, None, None)])
    assert out == {(5, 0, None, 1, 1, 1, 0, empty): 1, (5, 1, 5, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest()): 1}
