"""Suffix arrays against sorted suffixes, repeated strings against a set of all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import repeats
from leadloom.llm.suffix_array import suffix_array

DDL = "doc_id long, text string, doc long, sub long, at long, anchor long, run long, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "x") for i, t in rows], DDL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-2, 3), max_size=60), st.integers(1, 4))
def test_suffix_array(letters, times):
    letters = letters * times
    assert suffix_array(np.array(letters, np.int64)).tolist() == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_suffix_array_of_long_runs():
    for letters in ([0] * 5000, list(range(5000)), list(range(5000, 0, -1)), [0, 1] * 2500, [1, 0] * 2500):
        order = suffix_array(np.array(letters)).tolist()
        assert all(letters[a : a + 3000] <= letters[b : b + 3000] for a, b in zip(order, order[1:]))


def plain(rows):
    """What the contract says, string by string; rows of one id have one text here."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out[key] = len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(data, gone) if not x)).hexdigest()
    return sorted(((key, *out[key]) for key, _ in rows), key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in repeats.op12(spark, docs(spark, rows)).collect()), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line, ends = prose(60), prose(30)[:99], prose(22)
    rows = [(i, prose(r.choice([0, 1, 20, 80, 400]))) for i in range(60)]
    rows += [(100 + i, prose(30) + passage + prose(30)) for i in range(40)]
    rows += [(200 + i, f"{prose(12)}\n{line}\n{prose(12)}\n{line}") for i in range(60)]  # a line shorter than a string
    rows += [(300 + i, passage[i:] + passage[:-i] + ends) for i in range(1, 30)]
    rows += [(400 + i, rows[7][1] + prose(i)) for i in range(20)] + [(500 + i, rows[8][1]) for i in range(30)]
    for i in range(40):  # near copies
        t = list(passage * 3)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(len(t))] = r.choice("xyz")
        rows.append((600 + i, "".join(t)))
    rows += [(700, "a" * 3000), (701, "b" + "a" * 150), (702, "a" * 99), (703, "ab" * 300), (704, "x" * 100), (705, "x" * 100), (706, None), (707, "")]
    r.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 17])
def parts(spark, request):
    conf = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_repeats(spark, parts):
    rows = corpus(parts)
    assert found(spark, rows) == plain(rows)


def test_repeats_of_common_anchors(spark, monkeypatch):
    """Anchors beyond MOST runs are compared by their windows' fingerprints, with the same result."""
    rows = corpus(3)
    expected = plain(rows)
    for most in (2, 8):
        monkeypatch.setattr(repeats, "MOST", most)
        assert found(spark, rows) == expected


def test_repeats_over_pieces_of_a_long_text(spark):
    r = random.Random(5)
    half = "".join(r.choices("abcdefgh", k=repeats.PIECE - 50))
    rows = [(1, half + "é" * 300 + half[1000:5000] + "".join(r.choices("xyz", k=repeats.PIECE)) + half[-3000:]), (2, "q" + half[:200_000]), (3, half[100_000:] + "z" * 5000)]
    assert found(spark, rows) == plain(rows)


def test_repeats_of_ids_and_rows_that_repeat(spark):
    text, other = "".join(random.Random(6).choices("abcdefghij", k=300)), "".join(random.Random(7).choices("abcdefghij", k=300))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole, nothing = (300, 0, 0, sha(text)), (300, 300, 1, sha(""))
    assert found(spark, [(1, text), (1, text), (2, text)]) == [(1, *whole), (1, *whole), (2, *nothing)]
    assert found(spark, [(None, text), (None, text), (1, text)]) == [(1, *nothing), (None, *whole), (None, *whole)]
    # two texts of one id are documents of their own: what both have stays in one of them
    out = found(spark, [(1, text + other[:50]), (1, other[:50] + text), (0, other)])
    assert sorted(x[2] for x in out) == [0, 0, 300] and {x[1] for x in out} == {300, 350}
    assert found(spark, []) == [] and found(spark, [(1, None), (None, "")]) == [(1, 0, 0, 0, sha("")), (None, 0, 0, 0, sha(""))]
