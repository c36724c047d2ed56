"""Media columns: payloads in Ogg containers, and their verified reading.

write() stores a payload as unsigned 8-bit mono samples in one logical stream, whose packets span pages, interleaved with
a second stream that says after every sample page how many samples were complete by then and their checksum; its last
packet has the payload's length. read() verifies every page's checksum, reassembles packets from lacing values,
demultiplexes the logical streams, derives the time of each page from its granule position, and holds the two streams
against each other. Format: RFC 3533.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

RATE = 8000  # samples a second
PACKET = 4096  # samples in a packet
LACES = 40  # lacing values of a page at most, so that most packets span two pages
HEAD = b"8BITPCM\x00"
SIDE = b"LENGTH\x00\x00"
_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def page_crc(page: bytes) -> int:
    """Ogg's checksum: polynomial 0x04C11DB7, most significant bit first, start 0, no final xor.

    It is zlib's CRC of the bit-reversed bytes, with its start and final xor undone and the result bit-reversed.
    """
    c = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_FLIP), "big")


def _page(kind: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, kind, granule, serial, seq, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def write(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """The Ogg file of a payload: two begin pages, then sample pages, each with the side stream's page behind it."""
    out = [_page(2, 0, 1, 0, _lacing(len(HEAD) + 8), HEAD + struct.pack("<II", rate, 1)), _page(2, 0, 2, 0, _lacing(len(SIDE)), SIDE)]
    packets = [payload[at : at + PACKET] for at in range(0, len(payload), PACKET)]
    laces = b"".join(map(_lacing, map(len, packets)))
    start = done = crc = 0  # bytes in pages so far; of these in complete packets, and their checksum
    for seq, at in enumerate(range(0, len(laces), LACES), 1):
        lacing, last = laces[at : at + LACES], at + LACES >= len(laces)
        body = payload[start : start + sum(lacing)]
        begins_inside = at > 0 and laces[at - 1] == 255
        start += len(body)
        whole = start if last or lacing[-1] < 255 else start // PACKET * PACKET
        granule = whole if any(x < 255 for x in lacing) else -1
        crc, done = zlib.crc32(payload[done:whole], crc), whole
        out.append(_page(4 * last + begins_inside, granule, 1, seq, lacing, body))
        note = struct.pack("<QI", done, crc) + (struct.pack("<QQ", n_bytes, len(payload)) if last else b"")
        out.append(_page(4 * last, done, 2, seq, _lacing(len(note)), note))
    return b"".join(out)


@dataclass
class Stream:
    """Packets of a logical stream, the granule position each page ends at, and whether its end page was seen."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: bytes | None = None
    next_page: int = 0
    ended: bool = False


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; OggError for a wrong checksum, gap, or broken packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS" or data[at + 4] != 0:
            raise OggError(f"no page at byte {at}")
        _, _, kind, granule, serial, seq, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        start, end = at + 27 + n, at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"page at byte {at} is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"page at byte {at} fails its checksum")
        if bool(kind & 2) != (serial not in streams):
            raise OggError(f"stream {serial} begins at the wrong page")
        s = streams.setdefault(serial, Stream())
        if s.ended or seq != s.next_page or bool(kind & 1) != (s.open is not None):
            raise OggError(f"stream {serial} has a gap at page {seq}")
        s.next_page, s.ended = seq + 1, bool(kind & 4)
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append((s.open or b"") + data[start : start + size])
                s.open, start, size = None, start + size, 0
        if size:
            s.open = (s.open or b"") + data[start : start + size]
        if granule >= 0:
            s.granules.append(granule)
        at = end
    if any(not s.ended or s.open is not None for s in streams.values()):
        raise OggError("a stream has no end page")
    return streams


class Sound(NamedTuple):
    payload: bytes
    n_bytes: int  # without padding
    times: list[float]  # seconds at which the pages end that complete a packet
    packets: int


def read(data: bytes) -> Sound:
    """What a file that write() made holds; OggError where its streams don't agree."""
    streams = demux(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0][:8] == HEAD), None)
    side = next((s for s in streams.values() if s.packets and s.packets[0] == SIDE), None)
    if sound is None or side is None or len(side.packets) < 2 or len(side.packets[-1]) != 28:
        raise OggError("a stream is missing")
    payload = b"".join(sound.packets[1:])
    n_bytes, size = struct.unpack_from("<QQ", side.packets[-1], 12)
    if size != len(payload) or sound.granules[-1] != size:
        raise OggError("samples are missing")
    at = crc = 0
    for note, granule in zip(side.packets[1:], side.granules[1:], strict=True):
        upto, want = struct.unpack_from("<QI", note)
        crc, at = zlib.crc32(payload[at:upto], crc), upto
        if crc != want or granule != upto:
            raise OggError(f"the streams disagree at sample {upto}")
    rate = struct.unpack_from("<I", sound.packets[0], 8)[0]
    return Sound(payload, n_bytes, [g / rate for g in sound.granules[1:]], len(sound.packets) - 1)


def features(sound: Sound) -> str:
    """Packets, the pages' times, and mean, deviation, peak and sign changes around 128 of the samples, as text."""
    x = np.frombuffer(sound.payload, np.uint8).astype(np.int64) - 128
    n, total, squares = len(x), int(x.sum()), int((x * x).sum())
    changes = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={sound.packets};times={'|'.join(f'{t:.6f}' for t in sound.times)};mean={total / n:.4f};std={max(0.0, squares / n - (total / n) ** 2) ** 0.5:.4f};peak={int(np.abs(x).max())};changes={changes}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each whole text's payload as an Ogg file. A null text is empty; every row gives a row."""

    def make():
        return lambda ids, texts: (ids, [write(*padded(t)) for t in texts])

    return map_rows(docs, ["doc_id", "text"], make, pa.schema([("doc_id", pa.int64()), ("media", pa.binary())]), "doc_id long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """Reads (doc_id, media) back, one row each; a file that fails a check fails the job."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(doc_id: int | None, data: bytes) -> tuple:
        sound = read(data)
        payload = sound.payload
        return doc_id, sound.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(sound)

    def make():
        return lambda ids, media: tuple(zip(*map(one, ids, media)))

    return map_rows(media, ["doc_id", "media"], make, schema, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9(spark, docs: DataFrame) -> DataFrame:
    """The contract of op9_ogg_media. Null and empty texts are 64 zero bytes; repeated rows repeat; no rows, no result."""
    return inspect(store(docs))
