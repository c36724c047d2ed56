"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a parity sketch: every shingle toggles one place of a very wide
bit string, so the Hamming distance of two sketches is never above the size of the sets' symmetric difference. A
sketch is kept in parts, each as the XOR of its toggled places' hashes. For a size band, the symmetric difference of
linked sets is at most d, so of p > d parts at least p - d agree: documents that share a part's value are candidates.
Candidates whose sketches are near enough are verified on their whole sets.

Equal sets are one class. Links between classes are found in rounds, each of which emits rows in proportion to what it
reads: first every set against one set of each part value it shares; then, where sets that share a value are still in
different components, each one against the nearest set of another component, for as long as that joins many; last, so
that no link is lost, all that is left. Its pairs may be many, as sets that are just below the threshold to one another
stay apart, so none is a row: sets of different components that are near enough by their sketches only name a cluster
they have in common, every set comes to its cluster once, and its pairs are counted out on the whole sets there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, cut_table, in_arrow, map_rows, maybe_broadcast, narrow, pieces, release

CHUNK = 200_000  # shingles of the sets that one task group verifies against their hub
GROUP_BYTES = 8 << 20  # of sketches (a set counts as SMALLEST bytes at least) on either side of a compared group
WHOLE_BYTES = 4 << 20  # of whole sets (likewise)
SMALLEST = 2048
WIDE = 1  # places of a compared sketch for each shingle of a set
WORD_CACHE = 100_000  # words whose hashes a task keeps
SEEN = 100_000  # sets and texts that a task knows again
_M1, _M2, _K = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33, _S32 = np.uint64(33), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class Shingles:
    """Whole texts to sorted arrays of their distinct shingles' 64-bit hashes. A-Z are lower-cased; words are runs of
    other than \\x20 and \\x09-\\x0D; with fewer than k words the whole row of words is one shingle; none without words."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= WORD_CACHE:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, get = self.known, self._hash
        w = np.array([known.get(x) or get(x) for x in words], np.uint64)
        n = max(1, len(w) - self.k + 1)
        width = min(self.k, len(w))
        h = np.full(n, width, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                h = mix(h * _K + w[i : i + n])
        return np.unique(h)


class Bands:
    """Size bands for links of at least `percent` per cent: band b holds sizes start[b] to start[b + 1] - 1, and a
    document's partner that isn't smaller is in the same or the next band. A band is a quarter wide at least."""

    def __init__(self, percent: int):
        self.percent, start = percent, [1]
        while start[-1] <= 1 << 40:  # beyond any text that fits a row
            start.append(max(start[-1] + 1, start[-1] * 100 // percent + 1, start[-1] * 5 // 4))
        self.start = np.array(start, np.int64)

    def of(self, n: int) -> list[int]:
        """Bands whose parts a document of n shingles takes: its own, and the one before if a partner there is possible."""
        b = int(np.searchsorted(self.start, n, side="right")) - 1
        return [b] + [b - 1] * (b > 0 and (int(self.start[b]) - 1) * 100 >= self.percent * n)

    def parts(self, b: int) -> tuple[int, int]:
        """(largest symmetric difference d of a link whose smaller set is in band b, parts). Parts beyond d + 1 make up
        for those that may be empty."""
        d = (int(self.start[b + 1]) - 1) * (100 - self.percent) // self.percent
        return d, d + 1 + int(np.ceil(2 * (d + 1) * np.exp(-int(self.start[b]) / (d + 1))))


def part_keys(hashes: np.ndarray, bands: Bands) -> list[int]:
    """Keys of a set's sketch parts; the lowest bit is that of the band. Parts without a toggled place are left out, unless so many are that no other part
    need agree with a partner's."""
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        places = mix(hashes ^ _M2)
        for b in bands.of(len(hashes)):
            d, p = bands.parts(b)
            if d == 0:
                continue  # only equal sets link
            part = ((hashes >> _S32) * np.uint64(p)) >> _S32  # ascending, as the hashes are
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            which, value = part[first], np.bitwise_xor.reduceat(places, first)
            which, value = which[value != 0], value[value != 0]
            if p - len(which) >= p - d:
                empty = np.setdiff1d(np.arange(p, dtype=np.uint64), which)
                which, value = np.concatenate((which, empty)), np.concatenate((value, np.zeros(len(empty), np.uint64)))
            out.append((mix(value ^ mix(np.uint64(b) * _K + which)) & ~np.uint64(1)) | np.uint64(b & 1))
    return np.concatenate(out).view(np.int64).tolist() if out else []


def bit_sketches(hashes: np.ndarray, bands: Bands) -> tuple[bytes | None, bytes | None]:
    """Parity sketches of WIDE places for each shingle in the set's even and odd band: what candidates are compared by."""
    out: list[bytes | None] = [None, None]
    with np.errstate(over="ignore"):
        places = mix(hashes ^ _M2) >> _S32
        for b in bands.of(len(hashes)):
            m = -(-WIDE * int(bands.start[b + 1]) // 64) * 64
            out[b & 1] = np.packbits((np.bincount(((places * np.uint64(m)) >> _S32).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()
    return out[0], out[1]


def sketch(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row_id, n, fp, fp2, keys, even, odd): a row for each document; equal sets have equal (fp, fp2, n).

    A task gives the keys and sketches of a set once, as a partial aggregate would: rows whose set it has just seen
    have none. So copies cost keys by task, not by row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64())), ("even", pa.binary()), ("odd", pa.binary())])

    def make():
        shingles, bands = Shingles(k), Bands(percent)
        texts: dict[bytes, tuple[int, int, int]] = {}
        sets: set[tuple[int, int]] = set()

        def one(doc_id, row_id, text):
            name = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
            if name in texts:
                return doc_id, row_id, *texts[name], [], None, None
            h = shingles(text)
            n, fp = len(h), (0, 0)
            if n:
                with np.errstate(over="ignore"):
                    two = np.array([mix(h ^ _K).sum(dtype=np.uint64) + np.uint64(n), np.bitwise_xor.reduce(mix(h ^ _M1)) + np.uint64(n)])
                fp = tuple(mix(two).view(np.int64).tolist())
            if len(texts) >= SEEN:
                texts.clear()
                sets.clear()
            texts[name] = (n, *fp)
            if not n or fp in sets:
                return doc_id, row_id, n, *fp, [], None, None
            sets.add(fp)
            return doc_id, row_id, n, *fp, part_keys(h, bands), *bit_sketches(h, bands)

        return lambda *columns: tuple(zip(*map(one, *columns)))

    rows = docs.select("doc_id", row_id().alias("row_id"), "text")
    return map_rows(rows, ["doc_id", "row_id", "text"], make, schema, "doc_id long, row_id long, n long, fp long, fp2 long, keys array<long>, even binary, odd binary")


def sharing(rows: DataFrame) -> DataFrame:
    """(key, u, v): for each key that different sets share, links from a first set u to each other one v.

    One shuffle sorts (key, fingerprint) over range partitions, so a key that many sets share, even a set that many rows
    repeat (`salt`), is spread over as many partitions as it fills. Within a partition a key's sets link to its first
    one; where a key goes on in the next partition, its first sets there and here are linked through a table of one row
    for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "fp", "salt"]
    keys = rows.select(F.explode("keys").alias("key"), "fp", F.pmod("row_id", F.lit(64)).cast("byte").alias("salt"))
    keys = keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def out(part, first, k, u, v):
        n = len(k)
        part, first = (pa.array([part] * n, pa.int64()), pa.array([first] * n, pa.int64()))
        return pa.RecordBatch.from_arrays([part, first, pa.array(k, pa.int64()), pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["part", "first", "key", "u", "v"])

    def link(batches):
        part = TaskContext.get().partitionId()
        first = key = center = last = None
        for b in batches:
            if not b.num_rows:
                continue
            k, f = np.asarray(b.column(0)), np.asarray(b.column(1))
            if key is None:
                key, center = int(k[0]), int(f[0])
                first = (key, center)
            new = np.concatenate(([k[0] != key], k[1:] != k[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            start = np.where(at >= 0, f[at], center)
            before = np.concatenate(([center if last is None else last], f[:-1]))
            take = (f != start) & ((f != before) | new)
            yield out(-1, None, k[take], start[take], f[take])
            key, center, last = int(k[-1]), int(start[-1]), int(f[-1])
        if key is not None:
            yield out(part, first[0], [key], [first[1]], [center])
        release()

    found = cut(in_arrow(keys, link, "part long, first long, key long, u long, v long"))
    before = Window.orderBy("part")  # one row for each partition
    ends = found.where("part >= 0").withColumn("left_key", F.lag("key").over(before)).withColumn("left", F.lag("v").over(before))
    return found.where("part < 0").select("key", "u", "v").unionByName(ends.where("left_key = first AND left <> u").select(F.col("first").alias("key"), F.col("left").alias("u"), F.col("u").alias("v")))


def row_id():
    """A row's identity for joins: rows of one id with different texts stay apart, and null ids are no trouble."""
    return F.xxhash64("doc_id", "text")


def _near(x: np.ndarray, y: np.ndarray, nx, ny, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances of the sketches, whether sets of these sizes may link at such a distance)."""
    apart = np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    return apart, apart * (100 + percent) <= (nx + ny) * (100 - percent)


def _band_bits():
    return F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.col("even")).otherwise(F.col("odd"))


def starred(found: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(u, v): for each set v the nearest of the sets u that it is linked to by a shared key, if near enough."""
    pairs = found.select("u", "v", F.col("key").bitwiseAND(F.lit(1)).alias("key")).distinct()
    for side in ("u", "v"):
        pairs = pairs.join(bits.select(F.col("fp").alias(side), F.col("n").alias(f"n{side}"), "even", "odd"), side)
        pairs = pairs.withColumn(f"b{side}", _band_bits()).drop("even", "odd")

    def run(batches):
        for b in pieces(batches, 4096):
            u, v, nu, nv, x, y = (b.column(i).to_pylist() for i in range(6))
            out = []
            for i in range(len(u)):
                apart, near = _near(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), nu[i], nv[i], percent)
                if near:
                    out.append((u[i], v[i], int(apart)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v", "apart"])
        release()

    near = in_arrow(pairs.select("u", "v", "nu", "nv", "bu", "bv"), run, "u long, v long, apart long")
    return near.groupBy("v").agg(F.min(F.struct("apart", "u")).alias("best")).select("best.u", "v")


def grouped(members: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(key, a, b, rest, block, fp, comp): the members (key, fp, size in bytes) of a key that has several components, in groups
    (key, a, b) that bring together all those of different components.

    Members of a key are its main component and the rest. Both are dealt into blocks of `limit` bytes by hash, and the
    blocks of the rest meet all others. So a key that very many sets share is many groups, and while nearly all of its sets
    are of one component their work is linear.
    """
    m = members.join(maybe_broadcast(labels), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    parts = m.groupBy("key", "comp").agg(F.min("fp").alias("first"), F.sum(F.greatest("size", F.lit(SMALLEST))).alias("bytes"))
    keys = parts.groupBy("key").agg(F.count("*").alias("comps"), F.min_by("comp", "first").alias("main"), F.min_by("bytes", "first").alias("main_bytes"), F.sum("bytes").alias("bytes"))
    keys = cut(narrow(keys.where("comps > 1").select("key", "main", "main_bytes", (F.col("bytes") - F.col("main_bytes")).alias("rest_bytes"))))
    m = m.join(maybe_broadcast(keys), "key").withColumn("rest", F.col("comp") != F.col("main"))
    blocks = lambda c: F.ceil(c / limit).cast("int")
    m = m.withColumn("rests", blocks(F.col("rest_bytes"))).withColumn("mains", blocks(F.col("main_bytes")))
    m = m.withColumn("block", F.pmod(F.xxhash64("fp"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # A group is (a block of the rest, another block): numbers from 0 are main blocks, from -1 down blocks of the rest.
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    to_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.when(F.col("rest"), pair(F.least(x, F.col("block")), -1 - F.greatest(x, F.col("block")))).otherwise(pair(x, F.col("block"))))
    to_main = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda x: pair(F.col("block"), x))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    return m.withColumn("pair", F.explode(F.concat(to_rest, to_main))).select("key", "pair.a", "pair.b", F.col("rest").cast("int").alias("rest"), "block", "fp", "comp")


def first_block(held: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The rows of a group's first block, and those to compare them with: within one block, the same."""
    _, a, b = held[0][:3]
    first = [r for r in held if r[3] and r[4] == a]
    return first, first if b == -1 - a else [r for r in held if not (r[3] and r[4] == a)]


class Union:
    """Components of what has been joined in one group."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        root = x
        while root in self.up:
            root = self.up[root]
        while x != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.of(x), self.of(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def in_groups(work: DataFrame, links, names: list[str]) -> DataFrame:
    """Rows (long columns) of links(), which yields arrays of them for the rows of each group (the first three columns)."""
    work = work.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    def run(batches):
        held: list[tuple] = []
        out, size = [], 0

        def ready():
            nonlocal out, size
            for found in links(held):
                out.append(found)
                size += len(found[0])
                if size >= 50_000:
                    yield batch_of(out)
                    out, size = [], 0

        for batch in pieces(batches, 4096):
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and row[:3] != held[0][:3]:
                    yield from ready()
                    held = []
                held.append(row)
        if held:
            yield from ready()
        if out:
            yield batch_of(out)
        held = []
        release()

    return in_arrow(work, run, ", ".join(f"{c} long" for c in names))


def across(members: DataFrame, bits: DataFrame, labels: DataFrame, percent: int, every: bool) -> DataFrame:
    """(u, v) of sets that share a key (members: key, fp, size of the sketch) but no component, and are near enough: of each
    u the nearest v; or (every) such links that whoever is near to another one is joined with it, a tree for each group."""
    work = grouped(members, labels, GROUP_BYTES).join(bits, "fp").withColumn("bits", _band_bits()).select("key", "a", "b", "rest", "block", "fp", "comp", "n", "bits")

    def links(held):
        first, other = first_block(held)
        if not first or not other:
            return
        y = np.frombuffer(b"".join(r[8] for r in other), np.uint64).reshape(len(other), -1)
        n, comp, fp = (np.array([r[c] for r in other], np.int64) for c in (7, 6, 5))
        known = Union()
        for r in first:
            apart, near = _near(y, np.frombuffer(r[8], np.uint64), n, r[7], percent)
            at = np.flatnonzero(near & (comp != r[6]))
            if every:
                at = at[[known.join(r[5], v) for v in fp[at].tolist()]] if len(at) else at
            elif len(at):
                at = at[[np.lexsort((fp[at], apart[at]))[0]]]
            if len(at):
                yield np.full(len(at), r[5]), fp[at], apart[at]

    near = in_groups(work, links, ["u", "v", "apart"])
    if not every:
        near = near.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("best")).select("u", "best.v")
    return near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def clustered(texts: DataFrame, sets: DataFrame, near: DataFrame, labels: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v): links between sets of different components that near (u, v) joins to one cluster, on their whole sets: a tree
    of them in each group of a cluster, so no more rows than sets."""
    clusters = components(near).select(F.col("label").alias("key"), F.col("node").alias("fp"))
    members = cut(narrow(clusters.join(sets.select("fp", (F.col("n") * 8).alias("size")), "fp")))
    work = texts.join(maybe_broadcast(cut(narrow(grouped(members, labels, WHOLE_BYTES)))), "fp").select("key", "a", "b", "rest", "block", "fp", "comp", "text")

    def links(held):
        first, other = first_block(held)
        if not first or not other:
            return
        shingles, known = Shingles(k), Union()
        hashes = [shingles(r[7]) for r in other]
        mine = hashes if first is other else [shingles(r[7]) for r in first]
        n, comp = np.array([len(h) for h in hashes], np.int64), np.array([r[6] for r in other], np.int64)
        start = np.cumsum(n) - n
        names, place = np.unique(np.concatenate(hashes), return_inverse=True)
        has = np.zeros(len(names), bool)
        for r, h in zip(first, mine):
            at = np.searchsorted(names, h)
            at = at[names[np.minimum(at, len(names) - 1)] == h]
            has[at] = True
            common = np.add.reduceat(has[place], start, dtype=np.int64)
            has[at] = False
            for i in np.flatnonzero((comp != r[6]) & (100 * common >= percent * (n + len(h) - common))).tolist():
                if known.join(r[6], other[i][6]):
                    yield np.array([r[5]]), np.array([other[i][5]])

    return in_groups(work, links, ["u", "v"])


def texts_of(docs: DataFrame, sets: DataFrame, again: DataFrame | None) -> DataFrame:
    """(fp, text) of one row of each of the sets (fp, own), written once: no round reads the documents again. Rows that
    are repeated (`again` has their row_id) are made one first."""
    rows = docs.select(row_id().alias("row_id"), "text").join(maybe_broadcast(sets.select("fp", F.col("own.row_id").alias("row_id"))), "row_id")
    if again is not None:
        single = rows.join(maybe_broadcast(again), "row_id", "left_anti")
        rows = single.unionByName(rows.join(maybe_broadcast(again), "row_id", "left_semi").dropDuplicates(["row_id", "fp"]))
    return cut_table(rows.select("fp", "text"))


def verified(texts: DataFrame, sets: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) of sets that link, by the whole texts of one row of each set.

    v's text goes to its hub u, in chunks of CHUNK shingles that each get the hub's text too; a task walks through a chunk
    with two sets in memory.
    """
    row = sets.select("fp", "n")
    v = pairs.join(row.select(F.col("fp").alias("v"), F.col("n").alias("nv")), "v")
    hubs = v.groupBy("u").agg(F.ceil(F.sum("nv") / CHUNK).cast("int").alias("chunks"))
    v = v.join(hubs, "u").select(F.col("u").alias("hub"), F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("v").alias("fp"))
    u = hubs.select(F.col("u").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("u").alias("fp"))
    need = maybe_broadcast(cut(narrow(v.unionByName(u))))
    work = texts.join(need, "fp").select("hub", "chunk", "role", "fp", "text").repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "fp")

    def run(batches):
        shingles, at, base = Shingles(k), None, None
        for b in pieces(batches):
            out = []
            for hub, chunk, role, fp, text in zip(*[c.to_pylist() for c in b.columns]):
                mine = shingles(text)
                if role == 0:
                    at, base = (hub, chunk), mine
                    continue
                if at != (hub, chunk):
                    raise ValueError("a set to verify came without its hub")
                common = len(np.intersect1d(base, mine, assume_unique=True))
                if 100 * common >= percent * (len(base) + len(mine) - common):
                    out.append((hub, fp))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["u", "v"])
        shingles.known.clear()
        release()

    return in_arrow(work, run, "u long, v long")


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(fp, comp) of the sets with links, after further links (u, v) of sets."""
    if labels is None:
        return cut(narrow(components(links).select(F.col("node").alias("fp"), F.col("label").alias("comp"))))
    known = maybe_broadcast(labels)
    for side in ("u", "v"):
        links = links.join(known.select(F.col("fp").alias(side), F.col("comp").alias(f"c{side}")), side, "left")
    new = cut(narrow(components(links.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))))
    both = labels.join(maybe_broadcast(new.withColumnRenamed("node", "comp")), "comp", "left").select("fp", F.coalesce("label", "comp").alias("comp"))
    fresh = new.join(known.select("fp"), new["node"] == F.col("fp"), "left_anti").select(F.col("node").alias("fp"), F.col("label").alias("comp"))
    return cut(narrow(both.unionByName(fresh)))


def classes_of(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, row_id, n, fp, fp2) of all documents; classes (fp, fp2, n, component_id, keeper)
    of the sets with shingles: component_id is the smallest doc_id reachable by links, keeper that row's row_id."""
    every = cut(sketch(docs, k, percent))
    rows = every.select("doc_id", "row_id", "n", "fp", "fp2")
    own = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("low"), F.col("row_id"))
    classes = cut(rows.where("n > 0").groupBy("fp", "fp2", "n").agg(F.min(own).alias("own")))
    again = cut(narrow(rows.groupBy("row_id").count().where("count > 1").select("row_id")))
    again = None if again.isEmpty() else again
    found = sharing(every)
    sharers = cut(narrow(found.select("key", F.col("v").alias("fp")).union(found.select("key", F.col("u").alias("fp"))).distinct()))
    asked = maybe_broadcast(cut(narrow(sharers.select("fp").distinct())))
    bits = cut(narrow(every.where("even IS NOT NULL OR odd IS NOT NULL").join(asked, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("even", True).alias("even"), F.first("odd", True).alias("odd"))))
    sets = cut(narrow(classes.join(asked, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.min("own").alias("own"))))

    texts = texts_of(docs, sets, again)
    tested = cut(narrow(starred(found, bits, percent).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()))
    labels = joined(None, cut(narrow(verified(texts, sets, tested, k, percent))))
    members = cut(narrow(sharers.join(bits, "fp").select("key", "fp", F.length(_band_bits()).alias("size"))))
    while True:
        pairs = cut(narrow(across(members, bits, labels, percent, False).join(maybe_broadcast(tested), ["u", "v"], "left_anti")))
        links = None if pairs.isEmpty() else cut(narrow(verified(texts, sets, pairs, k, percent)))
        some = 0 if links is None else links.count()
        if some:
            labels = joined(labels, links)
        tested = tested.unionByName(pairs)
        if some <= labels.count() // 2:  # few are left that anything joins
            break
    near = cut(narrow(across(members, bits, labels, percent, True)))
    links = None if near.isEmpty() else cut(narrow(clustered(texts, sets, near, labels, k, percent)))
    if links is not None and not links.isEmpty():
        labels = joined(labels, links)

    mine = classes.join(maybe_broadcast(labels), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    best = mine.groupBy("comp").agg(F.min("own").alias("best"))
    low = F.nullif(F.col("best.low"), F.lit((1 << 63) - 1))
    return rows, cut(mine.join(best, "comp").select("fp", "fp2", "n", low.alias("component_id"), F.col("best.row_id").alias("keeper")))


def join(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, row_id, n_shingles, component_id, keeper), one row for each document."""
    rows, classes = classes_of(docs, k, percent)
    out = rows.join(classes, ["fp", "fp2", "n"], "left")
    return out.select("doc_id", "row_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "keeper")


def op5(spark, docs: DataFrame) -> DataFrame:
    """The contract of op5_ngram_join: three words, links from 90 per cent.

    Texts without words have 0 shingles and are their own component. Null ids never give a component its id: a
    component of nothing but null ids has a null one. Rows that repeat an id stay rows. No rows, no result.
    """
    return join(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without all but one of each group linked at five words and 80 per cent.

    The document with the smallest id stays; of equal rows one. Documents without words are all kept. Columns come
    out as they went in, whatever their names.
    """
    found = cut(join(docs, 5, 80).where("keeper IS NOT NULL").select(F.col("row_id").alias("near_row"), "keeper"))
    gone = found.where("near_row <> keeper").select("near_row").distinct()
    twice = cut(found.where("near_row = keeper").groupBy("near_row").count().where("count > 1").select("near_row"))
    rows = docs.select(row_id().alias("near_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    rows = rows.join(maybe_broadcast(cut(gone)), "near_row", "left_anti")
    if not twice.isEmpty():
        again = rows.join(maybe_broadcast(twice), "near_row", "left_semi").dropDuplicates(["near_row"])
        rows = rows.join(maybe_broadcast(twice), "near_row", "left_anti").unionByName(again)
    return rows.select("document.*")
