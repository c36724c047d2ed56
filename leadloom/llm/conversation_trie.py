"""Conversation prefix trie: sorted turn arrays, LCP intervals by a stack sweep, open stacks stitched across partitions.

A turn is a 128-bit digest of role and text, a conversation the array of its turns' digests. Arrays are range-sorted over
the cluster (equal ones by conversation, so a common conversation is split like any other rows); each task sweeps its
sorted rows with one stack: rows that share d turns with the row before stay below the open node of depth d, the rest of
the stack is closed. Nodes on the path of a task's first or last row may go on in the tasks beside it. Only these, a few
paths a partition, are swept once more, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, maybe_broadcast, release

EVERY, HEADS = 5, 9  # a conversation takes up to HEADS - 1 turns of the last one whose id EVERY divides
WIDTH = 22  # characters of a turn's digest
PENDING = 10_000  # children that wait in memory for what their parent's smallest member is; more are joined with it later
CHUNK = 8192  # ids in a row of a node's ends

CLOSED, WAITING, KNOWN, OPEN, ENDS = range(5)
_ROW = pa.schema([
    ("kind", pa.int32()), ("p", pa.int32()), ("ref", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("side", pa.int32()), ("token", pa.string()), ("bytes", pa.int64()), ("chunk", pa.int32()), ("ids", pa.string()),
])
_DDL = "kind int, p int, ref long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, side int, token string, bytes long, chunk int, ids string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of struct(token, bytes)) of each conversation, in the order of turn, null first, equal ones
    by token. Texts go no further than their digest and size."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.substring(F.base64(F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))), 1, WIDTH)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", token.alias("token"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["token"].alias("token"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """The conversations with their first h turns from the conversation conv_id - conv_id % EVERY, h by the id's checksum."""
    donors = convs.where(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = convs.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % EVERY).alias("donor"), h.alias("h"))
    none = F.slice("turns", 1, 0)
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(donors, "donor", "left").select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


class _Node:
    """An open node: what of its subtree is closed, the ids of its own ends, and where it belongs."""

    __slots__ = ("bytes", "children", "count", "ends", "flushed", "least", "leaves", "left", "parent", "pending", "ref", "saved", "token")

    def __init__(self, token: str, size: int, ref: int, left: bool = False, parent: int | None = None):
        self.token, self.bytes, self.ref, self.left, self.parent = token, size, ref, left, parent
        self.count, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends, self.pending, self.flushed = [], [], False

    def add(self, count: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.count += count
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.children, self.leaves, self.saved = self.children + children, self.leaves + leaves, self.saved + saved

    def close(self) -> None:
        """All members are in: a childless node is a leaf, and all but one member save the node's text."""
        self.leaves = self.leaves or 1
        self.saved += (self.count - 1) * self.bytes


class _Out:
    """Rows of the sweep's output, handed on in batches."""

    def __init__(self, schema: pa.Schema = _ROW):
        self.schema, self.rows = schema, []

    def put(self, **row) -> None:
        self.rows.append(row)

    def full(self, most: int = 4096) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= most:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv_id, sizes) to closed nodes, open nodes' parts, and the ends of open nodes."""
    p, out, stack, refs, first = TaskContext.get().partitionId(), _Out(), [], 0, True

    def flush(node: _Node) -> None:
        for row in node.pending:
            out.put(kind=WAITING, p=p, ref=node.ref, **row)
        node.pending = []

    def leave_open(node: _Node, depth: int) -> None:
        flush(node)
        out.put(kind=OPEN, p=p, ref=node.ref, side=0 if node.left else 1, depth=depth, token=node.token, bytes=node.bytes, n_convs=node.count, conv_id=node.least, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved)
        for i in range(0, len(node.ends), CHUNK):
            out.put(kind=ENDS, p=p, ref=node.ref, chunk=i // CHUNK, ids=",".join(map(str, node.ends[i : i + CHUNK])))

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        if node.left:
            return leave_open(node, depth)
        node.close()
        parent = stack[-1]
        parent.add(node.count, node.least, 1, node.leaves, node.saved)
        for row in node.pending:
            out.put(kind=CLOSED, p=p, **row | {"parent_conv_id": node.least})
        if node.flushed:
            out.put(kind=KNOWN, p=p, ref=node.ref, conv_id=node.least)
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        parent.pending.append({"conv_id": node.least, "depth": depth, "n_convs": node.count, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": ends})
        if parent.left or len(parent.pending) >= PENDING:
            parent.flushed = True
            flush(parent)

    for batch in batches:
        keys, ids, sizes = (batch.column(i) for i in range(3))
        for at in range(0, batch.num_rows, 256):
            for key, conv, size in zip(keys.slice(at, 256).to_pylist(), ids.slice(at, 256).to_pylist(), sizes.slice(at, 256).to_pylist()):
                if not stack:
                    stack.append(_Node("", 0, 0, True))
                depth, shared = len(size), 0
                while shared < depth and shared + 1 < len(stack) and key.startswith(stack[shared + 1].token, shared * WIDTH):
                    shared += 1
                while len(stack) - 1 > shared:
                    pop()
                for d in range(shared, depth):
                    refs += 1
                    stack.append(_Node(key[d * WIDTH : (d + 1) * WIDTH], size[d], refs, first))
                first = False
                stack[-1].add(1, conv, 0, 0, 0)
                stack[-1].ends.append(conv)
                yield from out.full()
    while stack:
        leave_open(stack.pop(), len(stack))
    yield from out.full(1)
    release()


_STITCHED = pa.schema([("p", pa.int32()), ("ref", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), *((c, pa.int64()) for c in NODE[:2] + NODE[3:7])])
_STITCHED_DDL = "p int, ref long, node long, parent long, " + ", ".join(f"{c} long" for c in NODE[:2] + NODE[3:7])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes' parts, in order of partition, side and depth, to whole nodes (p is null), and to which node each part
    belongs. A part belongs to the open node of its depth if their turns agree, as those above them do."""
    out, stack, nodes = _Out(_STITCHED), [], 0

    def pop() -> None:
        node, depth = stack.pop(), len(stack)
        node.close()
        if stack:
            stack[-1].add(node.count, node.least, 1, node.leaves, node.saved)
        out.put(node=node.ref, parent=node.parent, conv_id=node.least, depth=depth, n_convs=node.count, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved)

    for batch in batches:
        for row in batch.to_pylist():
            depth = row["depth"]
            if depth < len(stack) and stack[depth].token != row["token"]:
                while len(stack) > depth:
                    pop()
            if depth == len(stack):
                stack.append(_Node(row["token"], row["bytes"], nodes, parent=stack[-1].ref if stack else None))
                nodes += 1
            stack[depth].add(row["n_convs"], row["conv_id"], row["n_children"], row["n_leaves"], row["saved_tokens"])
            out.put(p=row["p"], ref=row["ref"], node=stack[depth].ref)
            yield from out.full()
    while stack:
        pop()
    yield from out.full(1)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) in order of node and place to (node, ends_sha256): a node's text is hashed as it comes, never held."""
    now, digest, schema = None, None, pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])
    done: list[tuple[int, str]] = []
    for batch in batches:
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node == now:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                done.append((now, digest.hexdigest()))
            now, digest = node, hashlib.sha256(ids.encode())
    if digest is not None:
        done.append((now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(schema.types)], schema=schema)


def trie(convs: DataFrame) -> DataFrame:
    """The nodes (NODE) of the trie of (conv_id, turns), one row for each distinct sequence of first turns."""
    rows = convs.select(F.array_join(F.transform("turns", lambda t: t["token"]), "").alias("key"), "conv_id", F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    swept = cut(in_arrow(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"), _sweep, _DDL))
    parts = swept.where(F.col("kind") == OPEN).select("p", "ref", "side", "depth", "token", "bytes", "n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens")
    stitched = cut(in_arrow(parts.repartition(1).sortWithinPartitions("p", "side", "depth"), _stitch, _STITCHED_DDL))
    nodes = stitched.where("p IS NULL").drop("p", "ref")
    known = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    belongs = stitched.where("p IS NOT NULL").select("p", "ref", F.col("node").alias("parent"))
    parents = belongs.join(maybe_broadcast(known), "parent").select("p", "ref", "parent_conv_id").union(swept.where(F.col("kind") == KNOWN).select("p", "ref", "conv_id"))
    waiting = swept.where(F.col("kind") == WAITING).drop("parent_conv_id").join(maybe_broadcast(parents), ["p", "ref"])
    ends = swept.where(F.col("kind") == ENDS).select("p", "ref", "chunk", "ids").join(maybe_broadcast(belongs), ["p", "ref"]).select(F.col("parent").alias("node"), "p", "chunk", "ids")
    ends = in_arrow(ends.repartition("node").sortWithinPartitions("node", "p", "chunk").select("node", "ids"), _digests, "node long, ends_sha256 string")
    whole = nodes.join(ends, "node", "left").join(maybe_broadcast(known), "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return swept.where(F.col("kind") == CLOSED).select(*NODE).unionByName(waiting.select(*NODE)).unionByName(whole.select(*NODE))


def op13(spark, conversations: DataFrame) -> DataFrame:
    """The contract of op13_conversation_trie.

    Null roles and texts are empty; rows without a conv_id belong to no conversation; equal turns of a conversation are
    ordered by their digest, repeated rows are turns of their own; no rows, no nodes. A conversation's turns, 30 bytes
    each, are one array: that is the largest row, whatever the texts. The ends of one node are one text by the contract,
    so the ids of a conversation that very many share are hashed one after another, streamed.
    """
    return trie(rebuilt(cut(turn_arrays(conversations))))


#: The same nodes in SQL: every prefix a row, checksums bit by bit; subtrees by joining each node with those above it.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, turn, md5(len(role)::VARCHAR || ':' || role || text) AS token, octet_length(encode(text))::BIGINT AS bytes FROM t),
v AS (SELECT conv_id, token, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) AS pos FROM u),
ids AS (SELECT conv_id, list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))) AS crc FROM (SELECT DISTINCT conv_id FROM v)),
h AS (SELECT conv_id, conv_id - conv_id % 5 AS donor, xor(crc, 4294967295) % 9 AS h FROM ids),
head AS (SELECT h.conv_id, v.pos, v.token, v.bytes FROM h JOIN v ON v.conv_id = h.donor AND v.pos <= h.h),
nh AS (SELECT conv_id, count(*) AS n FROM head GROUP BY conv_id),
r AS (SELECT * FROM head UNION ALL SELECT h.conv_id, coalesce(nh.n, 0) + v.pos - h.h, v.token, v.bytes FROM h JOIN v ON v.conv_id = h.conv_id AND v.pos > h.h LEFT JOIN nh ON nh.conv_id = h.conv_id),
path AS (SELECT conv_id, pos AS depth, bytes, md5(string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS node, max(pos) OVER (PARTITION BY conv_id) AS longest FROM r),
every AS (SELECT p.conv_id, p.depth, p.bytes, p.node, p.depth = p.longest AS ends FROM path p
    UNION ALL SELECT ids.conv_id, 0, 0, '', NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = ids.conv_id) FROM ids),
node AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM every GROUP BY node, depth),
up AS (SELECT n.node, n.depth, e.node AS above, e.depth AS level FROM node n JOIN every e ON e.conv_id = n.conv_id AND e.depth <= n.depth),
kids AS (SELECT above, count(*) AS n_children FROM up WHERE level = depth - 1 GROUP BY above),
leaf AS (SELECT up.above, sum(CASE WHEN k.above IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens FROM up JOIN node n ON n.node = up.node LEFT JOIN kids k ON k.above = up.node GROUP BY up.above)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, l.n_leaves::BIGINT AS n_leaves, l.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM node n JOIN leaf l ON l.above = n.node LEFT JOIN kids k ON k.above = n.node LEFT JOIN up ON up.node = n.node AND up.level = n.depth - 1 LEFT JOIN node m ON m.node = up.above
"""
