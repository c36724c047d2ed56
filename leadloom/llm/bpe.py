"""Byte-level BPE by prefix dynamic programming.

The BPE encoding of a byte string is the only sequence of tokens in which every neighbouring pair is stable: no merge
across the pair's border comes before the merges inside its two tokens. So each prefix has one valid last token, and
storing it per prefix gives exact appends (only new prefixes are computed) and exact re-encoding near an edit.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import map_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 200_000  # pieces whose ids a task keeps, and pairs whose stability it keeps; cleared when full, and at a task's end
SHORT = 64  # bytes of a piece that is kept, and whose prefixes are looked at only where the last token depends on them


class Vocabulary:
    """Ranks of a byte-level BPE, with each token's last merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, ranks))
        self.merges: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * len(self.bytes)
        for rank, token in enumerate(self.bytes):
            if len(token) > 1:
                self.halves[rank] = self._last_merge(token, rank)
                self.merges[self.halves[rank]] = rank
        self._stable: dict[int, bool] = {}

    @classmethod
    def load(cls, name: str = VOCABULARY) -> Vocabulary:
        with open(public_tokenizers.path(name), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens left when the merges below `rank` are applied to the token's bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best[0] >= rank:
                raise ValueError(f"token {rank} is not made by two tokens")
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives exactly these two tokens.

        Their merges are undone from the last to the first. At every moment of that history the two parts that touch
        at the border must not merge before the next merge (in the true order) takes place there.
        """
        key = left << 32 | right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) >= CACHE:
                self._stable.clear()
            known = self._stable[key] = self._undo(left, right)
        return known

    def last(self, data: bytes, end: int, found: dict[int, int]) -> int:
        """The valid last token of data[:end]. `found` has the last tokens of the prefixes looked at so far."""
        token = found.get(end)
        if token is None:
            for start in range(max(0, end - self.longest), end):
                token = self.ranks.get(data[start:end])
                if token is not None and (start == 0 or self.stable(self.last(data, start, found), token)):
                    found[end] = token
                    break
        return token

    def _undo(self, a: int, b: int) -> bool:
        until = len(self.bytes)  # the touching parts live until the merge of this rank
        while True:
            across = self.merges.get((a, b))
            if across is not None and across < until:
                return False
            ha, hb = self.halves[a], self.halves[b]
            if ha is None and hb is None:
                return True
            # A merge of the same rank on the left side comes first, as BPE goes from left to right.
            if hb is None or (ha is not None and a > b):
                until, a = a, ha[1]
            else:
                until, b = b + 1, hb[0]


class Prefixes:
    """Bytes with the valid last token of each of their prefixes: append() and edit() keep the encoding exact."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), array("i")
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        ranks, last, stable, data, longest = self.v.ranks, self.last, self.v.stable, bytes(self.data), self.v.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(data[start:end])
                if token is not None and (start == 0 or stable(last[start - 1], token)):
                    last.append(token)
                    break

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replaces bytes start:end. Prefixes before the edit stay; those after it are computed only until the rest
        can be copied: once a window of twice the longest token has the same last tokens as before, so has the rest."""
        tail, old = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(new)
        same, step = 0, 2 * self.v.longest
        for at in range(0, len(tail), step):
            self.append(tail[at : at + step])
            if self.last[-len(tail[at : at + step]) :] == old[at : at + step] and len(old[at : at + step]) == step:
                same = at + step
                break
        if same:
            self.data += tail[same:]
            self.last.extend(old[same:])

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes[out[-1]])
        return out[::-1]


class Codec:
    """Whole texts to ids and back; each match of the pattern is encoded by itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str = public_tokenizers.PATTERN):
        self.v, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        whole = self.v.ranks.get(data)
        if whole is not None:
            ids = [whole]
        elif len(data) > SHORT:
            return array("I", Prefixes(self.v, data).ids()).tobytes()
        else:
            ids, end, found = [], len(data), {}
            while end:
                ids.append(self.v.last(data, end, found))
                end -= len(self.v.bytes[ids[-1]])
            ids.reverse()
        if len(self.known) >= CACHE:
            self.known.clear()
        packed = self.known[piece] = array("I", ids).tobytes()
        return packed

    def forget(self) -> None:
        """Empties what is only kept for speed: a worker process outlives its task."""
        self.known.clear()
        self.v._stable.clear()

    def encode(self, text: str) -> array:
        known, piece = self.known, self.piece
        out = array("I")
        out.frombytes(b"".join([known.get(p) or piece(p) for p in self.split(text)]))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(name: str = VOCABULARY) -> Codec:
    """One codec for each worker process and vocabulary."""
    if name not in _CODECS:
        _CODECS[name] = Codec(Vocabulary.load(name))
    return _CODECS[name]


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null and empty texts have no ids."""

    def make():
        c = codec(name)
        return lambda keys, texts: (keys, [pa.array(c.encode(t or ""), pa.int32()).to_pylist() for t in texts])

    return map_rows(docs, ["doc_id", "text"], make, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), "doc_id long, ids array<int>", lambda: codec(name).forget())


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """(doc_id, data binary) of (doc_id, ids)."""

    def make():
        c = codec(name)
        return lambda keys, ids: (keys, [c.decode(x or []) for x in ids])

    return map_rows(encoded, ["doc_id", "ids"], make, pa.schema([("doc_id", pa.int64()), ("data", pa.binary())]), "doc_id long, data binary")


def op6(spark, docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The contract of op6_byte_bpe: encodes, then decodes the ids, row by row and without a shuffle.

    Null and empty texts have 0 tokens and the hash of no bytes; repeated rows repeat; no rows, no result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make():
        c = codec(name)

        def one(key: int | None, text: str | None) -> tuple:
            ids = c.encode(text or "")
            return key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return lambda keys, texts: tuple(zip(*map(one, keys, texts)))

    return map_rows(docs, ["doc_id", "text"], make, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: codec(name).forget())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the corpus with the hashes of op6, for the last stage of a pipeline."""
    return op6(spark, docs)
