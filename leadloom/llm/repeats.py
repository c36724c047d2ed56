"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier in the corpus.

Every string of LENGTH bytes (a window) is dealt to an anchor, the GRAM bytes in it whose hash is least, so equal windows
have equal anchors at equal places. Windows in a row that share an anchor form a run, a record of two hashes: of the
anchor and of all its bytes. Records are range-sorted over the cluster; of equal runs all but the first are repeats as a
whole. What is left to tell apart are different runs of one anchor: their bytes, as letters of WORD bytes aligned at the
anchor, are put in suffix arrays, in whose order windows with the same letters stand together.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, in_arrow, maybe_broadcast, pieces, release
from .suffix_array import suffix_array

LENGTH = 100  # bytes of a string that is looked for
GRAM = 32  # bytes of an anchor
SPREAD = LENGTH - GRAM + 1  # anchors to choose from in a window
PIECE = 1 << 18  # windows handled at once; longer texts are handled piece by piece
WORD = 8  # bytes of a letter
LETTERS = (LENGTH - WORD + 1) // WORD  # whole letters in a window, wherever they are aligned
EDGE = LENGTH - LETTERS * WORD  # the other bytes of a window
BLOCK = 1 << 16  # letters of a suffix array, about
MOST = 20_000  # runs of an anchor that one task compares; windows of commoner anchors are compared by their fingerprints
NO_ID = -(1 << 63)

DUPLICATE, FIRST, BOUNDARY = range(3)
_BITS = 20  # of a place in a piece
_PLACE = np.uint64((1 << _BITS) - 1)


@functools.cache
def _table() -> np.ndarray:
    """A random odd number for each byte."""
    return np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on: polynomials of 1, 2, 4, ... bytes (GRAM is a power of two), mixed."""
    h, size, power = _table()[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each gram, place of the anchor of each window): the least hash, the leftmost of equal ones."""
    h = gram_hashes(data)
    v, width = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= SPREAD:
        v, width = np.minimum(v[:-width], v[width:]), 2 * width
    if width < SPREAD:
        v = np.minimum(v[: len(v) - (SPREAD - width)], v[SPREAD - width :])
    return h, (v & _PLACE).astype(np.int64)


def _at(start, windows, lead):
    """A run in a long: its first byte, its number of windows and the bytes before its anchor."""
    return (start << 14) | (windows << 7) | lead


def runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, anchor hashes, run hashes, places as by _at) for each text of LENGTH bytes or more."""
    some, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            part = t[at : at + PIECE + LENGTH - 1] if at or len(t) > PIECE else t
            if some and size + len(part) > PIECE + LENGTH:
                yield from _runs(some)
                some, size = [], 0
            some.append((i, at, part))
            size += len(part)
    if some:
        yield from _runs(some)


def _runs(parts: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    data = b"".join(p for _, _, p in parts)
    h, place = anchors(np.frombuffer(data, np.uint8))
    begin = 0
    for i, at, part in parts:
        own = place[begin : begin + len(part) - LENGTH + 1]
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        windows = np.diff(np.append(starts, len(own)))
        anchor = own[starts]
        lead = anchor - begin - starts
        a, b = (starts + begin).tolist(), (starts + windows + (begin + LENGTH - 1)).tolist()
        digests = [xxhash.xxh3_64_intdigest(data[x:y], seed) for x, y, seed in zip(a, b, lead.tolist())]
        yield i, h[anchor].view(np.int64), np.array(digests, np.uint64).view(np.int64), _at(starts + at, windows, lead)
        begin += len(part)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key columns doc and sub: the id (the least long for null), and 0, or a hash of the text where rows with one
    id, or none, have different texts. Documents are in the order of (doc, sub)."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"))
    clash = cut(out.select("doc", digest.alias("digest")).groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc"))
    if clash.isEmpty():
        return out.withColumn("sub", F.lit(0).cast("long"))
    marked = out.join(maybe_broadcast(clash.withColumn("clashes", F.lit(True))), "doc", "left")
    return marked.select("doc_id", "text", "doc", F.when(F.col("clashes"), digest).otherwise(F.lit(0)).alias("sub"))


def records(docs: DataFrame) -> DataFrame:
    """(anchor, run, doc, sub, at) of every run of keyed docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            doc, sub, texts = part.column(0).to_numpy(), part.column(1).to_numpy(), [(t or "").encode() for t in part.column(2).to_pylist()]
            for i, anchor, digest, at in runs(texts):
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digest), pa.array(np.full(n, doc[i])), pa.array(np.full(n, sub[i])), pa.array(at)], names=["anchor", "run", "doc", "sub", "at"])
        release()

    return in_arrow(docs.select("doc", "sub", "text"), run, "anchor long, run long, doc long, sub long, at long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted records to (kind, anchor, run, doc, sub, at): repeats of a run; the first of each run of an anchor that has
    several; and the first of each run of the partition's first and last anchor, which other partitions may have too."""
    kept: list[np.ndarray] = []  # the first of each run of the last anchor so far, over batches
    last, begun = None, False  # the last record with the place where its run first occurs

    def batch_of(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(rows[:, c]) for c in range(5))], names=["kind", "anchor", "run", "doc", "sub", "at"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([batch.column(c).to_numpy() for c in range(5)])
        new = np.empty(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        new[0] = last is None or (rows[0, :2] != last[:2]).any()
        head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        first = rows[head] if head[0] == 0 else np.where((head >= 0)[:, None], rows[head], last)
        repeats = rows[(rows[:, 2:] != first[:, 2:]).any(axis=1)]
        if len(repeats):
            yield batch_of(repeats, DUPLICATE)
        last = first[-1]
        firsts = np.concatenate([*kept, rows[new]])
        if not len(firsts):
            continue
        cuts = np.flatnonzero(firsts[1:, 0] != firsts[:-1, 0]) + 1
        if not len(cuts):
            kept = [firsts]
            if not begun and len(firsts) > BLOCK:  # the partition's first anchor, and a common one
                yield batch_of(firsts[:-1], BOUNDARY)
                kept = [firsts[-1:]]
            continue
        done, kept = firsts[: cuts[-1]], [firsts[cuts[-1] :]]
        if not begun:
            begun = True
            yield batch_of(done[: cuts[0]], BOUNDARY)
            done, cuts = done[cuts[0] :], cuts[1:] - cuts[0]
        if len(done):
            sizes = np.diff(np.concatenate([[0], cuts[:-1], [len(done)]]))
            several = done[np.repeat(sizes, sizes) > 1]
            if len(several):
                yield batch_of(several, FIRST)
    if kept:
        yield batch_of(np.concatenate(kept), BOUNDARY)
    release()


def compared(records_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeats: doc, sub, at), (firsts: anchor, doc, sub, at of the runs of anchors with several)."""
    rows = records_.repartitionByRange("anchor", "run", "doc", "sub", "at").sortWithinPartitions("anchor", "run", "doc", "sub", "at")
    out = cut_table(in_arrow(rows, _compare, "kind int, anchor long, run long, doc long, sub long, at long"))
    edge = out.where(F.col("kind") == BOUNDARY).drop("kind")
    place = F.struct("doc", "sub", "at")
    least = cut(edge.groupBy("anchor", "run").agg(F.min(place).alias("least")))
    number = least.groupBy("anchor").agg(F.count("*").alias("n"))
    firsts = least.join(number.where("n > 1"), "anchor").select("anchor", "least.*")
    again = edge.join(maybe_broadcast(least), ["anchor", "run"]).where(place != F.col("least")).select("doc", "sub", "at")
    repeats = out.where(F.col("kind") == DUPLICATE).select("doc", "sub", "at").unionByName(again)
    return repeats, out.where(F.col("kind") == FIRST).select("anchor", "doc", "sub", "at").unionByName(firsts)


def segments(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """firsts with the bytes of their runs, read from the texts: a document's runs go to it as one list."""
    asked = cut_table(firsts.groupBy("doc", "sub").agg(F.collect_list(F.struct("anchor", "at")).alias("asked")))
    both = docs.select("doc", "sub", "text").join(asked, ["doc", "sub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 64):
            for doc, sub, text, wanted in zip(*(part.column(c).to_pylist() for c in range(4))):
                data = (text or "").encode()
                starts = [(x["anchor"], x["at"], x["at"] >> 14) for x in wanted]
                cuts = [data[s : s + (at >> 7 & 127) + LENGTH - 1] for _, at, s in starts]
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in starts], pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([sub] * n, pa.int64()), pa.array([x[1] for x in starts], pa.int64()), pa.array(cuts, pa.binary())], names=["anchor", "doc", "sub", "at", "bytes"])
        release()

    return in_arrow(both, run, "anchor long, doc long, sub long, at long, bytes binary")


Run = tuple[int, int, int, int, bytes]  # anchor, doc, sub, at, bytes


def partnered(group: list[Run]) -> list[Run]:
    """The runs of an anchor that may have a window in common with another: every window has half of what surrounds the
    anchor in it, to one side or the other, so a partner shares that half. Rows that repeat one place count once."""
    half, seen = (LENGTH - GRAM) // 2, {}
    for r in group:
        seen[r[1:4]] = r
    sides = []
    for r in seen.values():
        lead = r[3] & 127
        left = r[4][lead - half : lead + GRAM] if lead >= half else None
        right = r[4][lead : lead + GRAM + half] if len(r[4]) >= lead + GRAM + half else None
        sides.append((r, left, right))
    lefts, rights = Counter(s[1] for s in sides), Counter(s[2] for s in sides)
    return [r for r, left, right in sides if (left is not None and lefts[left] > 1) or (right is not None and rights[right] > 1)]


def repeated_windows(block: list[Run]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, sub, start, end) of the bytes that windows cover which also start earlier, in another run of the block.

    The runs' letters form one text, apart from each other by letters of their own. Neighbours in its suffix array that
    agree in LETTERS letters are of one class; windows are equal if their letters' class, the place of the letters in
    them, and the EDGE bytes around the letters are.
    """
    block.sort(key=lambda r: r[1:4])
    lengths = np.array([len(r[4]) for r in block])
    at = np.array([r[3] for r in block], np.int64)
    windows, lead = at >> 7 & 127, at & 127
    data = np.frombuffer(b"".join([r[4] for r in block] + [bytes(LENGTH)]), np.uint8)
    begin = np.cumsum(lengths) - lengths
    shift = lead % WORD  # bytes before a run's first letter
    count = (lengths - shift) // WORD
    first = np.cumsum(count + 1) - (count + 1)  # of a run's letters in the text; a letter apart follows them
    total = int((count + 1).sum())
    run = np.repeat(np.arange(len(block)), count + 1)
    nth = np.arange(total) - first[run]
    apart = nth == count[run]
    words = data[(begin + shift)[run[~apart], None] + (nth[~apart] * WORD)[:, None] + np.arange(WORD)].view("<u8").ravel()
    letters = np.empty(total, np.int64)
    kinds, letters[~apart] = np.unique(words, return_inverse=True)
    letters[apart] = len(kinds) + np.arange(apart.sum())
    sa = suffix_array(letters)
    longer = np.concatenate([letters, np.arange(-1, -1 - LETTERS, -1)])
    same = np.ones(total - 1, bool)
    for k in range(LETTERS):
        same &= longer[sa[1:] + k] == longer[sa[:-1] + k]
    rank = np.empty(total, np.int64)
    rank[sa] = np.cumsum(np.concatenate([[0], ~same]))
    common = np.bincount(rank)[rank] > 1
    # windows: one for each of a run's starts; its letters begin `before` bytes into it
    of = np.repeat(np.arange(len(block)), windows)
    start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = (shift[of] - start) % WORD
    letter = first[of] + (start + before - shift[of]) // WORD
    some = common[letter]
    of, start, before, letter = of[some], start[some], before[some], letter[some]
    if not len(of):
        return
    place = np.arange(EDGE)
    place = np.where(place < before[:, None], place, place + LETTERS * WORD) + (begin[of] + start)[:, None]
    edge = np.ascontiguousarray(np.pad(data[place], ((0, 0), (0, 16 - EDGE)))).view("<u8")
    key = rank[letter] * WORD + before
    order = np.lexsort((np.arange(len(of)), edge[:, 1], edge[:, 0], key))  # equal ones by place, as runs are sorted
    again = np.zeros(len(of), bool)
    x, y = order[1:], order[:-1]
    again[x] = (key[x] == key[y]) & (edge[x] == edge[y]).all(axis=1)
    of, start = of[again], start[again]
    if len(of):
        breaks = np.flatnonzero((of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)) + 1
        a, b = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(of)]]) - 1
        for i, s, e in zip(of[a].tolist(), start[a].tolist(), start[b].tolist()):
            _, doc, sub, where, _ = block[i]
            yield doc, sub, (where >> 14) + s, (where >> 14) + e + LENGTH


_SPANS = pa.schema([("doc", pa.int64()), ("sub", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _by_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by anchor to the spans of repeated windows: whole anchors are gathered into blocks."""
    block: list[Run] = []
    group: list[Run] = []
    size = 0

    def spans() -> pa.RecordBatch:
        found = list(repeated_windows(block)) if block else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], schema=_SPANS)

    for batch in batches:
        for part in pieces(iter([batch])):
            for r in zip(*(part.column(c).to_pylist() for c in range(5))):
                if group and r[0] != group[0][0]:
                    block += (more := partnered(group))
                    size += sum(len(x[4]) for x in more) // WORD
                    group = []
                    if size >= BLOCK:
                        yield spans()
                        block, size = [], 0
                group.append(r)
    block += partnered(group)
    yield spans()
    release()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, doc, sub, start) of each window of runs: two hashes of its bytes, and where it is."""
    for part in pieces(batches):
        for _, doc, sub, at, data in zip(*(part.column(c).to_pylist() for c in range(5))):
            n = at >> 7 & 127
            both = [xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(n)]
            pair = np.frombuffer(b"".join(both), np.int64).reshape(n, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.full(n, doc)), pa.array(np.full(n, sub)), pa.array((at >> 14) + np.arange(n))], names=["a", "b", "doc", "sub", "start"])
    release()


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, sub, start, end) of spans of keyed docs that strings cover which also start earlier; spans may overlap."""
    repeats, firsts = compared(records(docs))
    firsts = cut_table(firsts)
    common = cut(firsts.groupBy("anchor").count().where(F.col("count") > MOST).select("anchor"))
    runs_ = segments(docs, firsts)
    start = F.shiftright("at", 14)
    spans = repeats.select("doc", "sub", start.alias("start"), (start + F.shiftright("at", 7).bitwiseAND(127) + (LENGTH - 1)).alias("end"))
    if not common.isEmpty():
        runs_ = cut_table(runs_)
        windows = in_arrow(runs_.join(maybe_broadcast(common), "anchor").dropDuplicates(["anchor", "doc", "sub", "at"]), _fingerprints, "a long, b long, doc long, sub long, start long")
        windows = cut_table(windows)
        place = F.struct("doc", "sub", "start")
        least = windows.groupBy("a", "b").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(windows.join(least, ["a", "b"]).where(place != F.col("least")).select("doc", "sub", "start", (F.col("start") + LENGTH).alias("end")))
        runs_ = runs_.join(maybe_broadcast(common), "anchor", "left_anti")
    found = in_arrow(runs_.repartition("anchor").sortWithinPartitions("anchor"), _by_suffixes, "doc long, sub long, start long, end long")
    return spans.unionByName(found)


def by_document(spans: DataFrame) -> DataFrame:
    """(doc, sub, starts, ends): a document's spans in order, those that overlap or touch as one."""
    rows = spans.groupBy("doc", "sub").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).select("doc", "sub", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            starts, ends = [], []
            for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                a, b = np.array(a), np.maximum.accumulate(b)
                new = np.concatenate([[True], a[1:] > b[:-1]])
                starts.append(a[new].tolist())
                ends.append(b[np.append(new[1:], True)].tolist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(starts, lists), pa.array(ends, lists)], names=["doc", "sub", "starts", "ends"])
        release()

    return cut_table(in_arrow(rows, run, "doc long, sub long, starts array<long>, ends array<long>"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept are the bytes that no string covers which also starts earlier."""
    rows = keyed(docs)
    spans = by_document(repeated(rows))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            out = []
            for key, text, starts, ends in zip(*(part.column(c).to_pylist() for c in range(4))):
                data, starts, ends = (text or "").encode(), starts or [], ends or []
                left = b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))
                out.append((key, len(data), len(data) - len(left), len(starts), left))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(schema.types)], schema=schema)
        release()

    both = rows.join(spans, ["doc", "sub"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "starts", "ends")
    return in_arrow(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12(spark, docs: DataFrame) -> DataFrame:
    """The contract of op12_suffix_dedup.

    Null texts are empty. Rows that share an id (null ids are one id, before all others) and a text are one document, so
    neither is earlier than the other; rows that share an id but no text are documents in the order of their texts' hash.
    Texts below LENGTH bytes lose nothing; no rows, no result.
    """
    kept = dedup(docs)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
