"""Ogg media columns: texts kept as 8-bit samples in a container of two logical streams.

Method: pages are found by their capture pattern and held only if their checksum agrees; packets are put together from the
lacing values, over page ends too; pages are dealt to logical streams by serial number; and the time of a packet follows
from the granule position of its page (samples so far, by the stream's rate).

The store has a stream of samples (one packet for each second) and an index stream (one packet for each second, with its
number and the sum of its samples).  Serial numbers come from the payload, so equal texts give equal bytes.

Defined results: a null or empty text is stored as 192 bytes of value 32; a damaged page is dropped and counted, as is a
packet that lost a part; a null media value gives no streams; repeated rows and equal texts give equal media; a text of any
length is stored whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map

BLOCK = 192
PAD = b" "
RATE = 8000
CONTINUED, FIRST, LAST = 1, 2, 4
PER_PAGE = 6
SAMPLES, INDEX = b"TsrPCM8\0", b"TsrIndex"
HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, most significant bit first, from 0), by way of the reflected CRC of zlib."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    raw = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + checksum(raw).to_bytes(4, "little") + raw[26:]


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


class Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], flags: int = 0) -> list[bytes]:
        """Pages for packets with the granule position at the end of each; ``flags`` go on the first and last page."""
        segments, body, ends = b"".join(lace(len(p)) for p, _ in packets), b"".join(p for p, _ in packets), {}
        at = 0
        for p, granule in packets:
            at += len(p) // 255 + 1
            ends[at] = granule
        out, taken = [], 0
        for i in range(0, len(segments), 255):
            part = segments[i : i + 255]
            done = [ends[k] for k in range(i + 1, i + len(part) + 1) if k in ends]
            size = sum(part)
            f = (CONTINUED if i and i not in ends else 0) | (flags & FIRST if not i else 0) | (flags & LAST if i + 255 >= len(segments) else 0)
            out.append(page(self.serial, self.number, done[-1] if done else -1, f, part, body[taken : taken + size]))
            self.number += 1
            taken += size
        return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), PAD)


def mux(payload: bytes) -> bytes:
    """The container for a payload of 8-bit samples."""
    a, b = struct.unpack("<II", hashlib.blake2b(payload, digest_size=8).digest())
    samples, index = Writer(a), Writer(b if b != a else b ^ 1)
    head = struct.pack("<IQ", RATE, len(payload))
    out = [*samples.pages([(SAMPLES + head, 0)], FIRST), *index.pages([(INDEX + head, 0)], FIRST)]
    seconds = range(0, len(payload), RATE)
    packets = [(payload[i : i + RATE], min(i + RATE, len(payload))) for i in seconds]
    total = np.add.reduceat(np.frombuffer(payload, np.uint8), list(seconds), dtype=np.int64).tolist()
    marks = [(struct.pack("<IQ", k, total[k]), packets[k][1]) for k in range(len(packets))]
    for i in range(0, len(packets), PER_PAGE):
        flags = LAST if i + PER_PAGE >= len(packets) else 0
        out += samples.pages(packets[i : i + PER_PAGE], flags) + index.pages(marks[i : i + PER_PAGE], flags)
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets with the time at the end of the page each ended on, in samples (-1: unknown)."""

    serial: int
    pages: int = 0
    lost: int = 0
    ended: bool = False
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    _open: list[bytes] | None = None
    _next: int | None = None

    def take(self, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> None:
        if self._next is not None and number != self._next or not flags & CONTINUED:
            self.lost += self._open is not None
            self._open = None
        skip = flags & CONTINUED and self._open is None  # the packet's beginning is lost
        self.lost += bool(skip)
        self.pages, self._next, self.ended = self.pages + 1, number + 1, self.ended or bool(flags & LAST)
        at = size = 0
        for n in lacing:
            size += n
            if n < 255:
                if not skip:
                    self.packets.append(b"".join(self._open or []) + body[at : at + size])
                    self.granules.append(granule)
                self._open, skip = None, False
                at, size = at + size, 0
        if lacing and lacing[-1] == 255 and not skip:
            self._open = [*(self._open or []), body[at:]]


def demux(media: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged places that were passed over."""
    streams: dict[int, Stream] = {}
    damaged = at = 0
    while (i := media.find(b"OggS", at)) >= 0:
        damaged += i > at
        at = i + 4
        if len(media) < i + HEAD.size:
            damaged += 1
            continue
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, i)
        start = i + HEAD.size + n
        lacing = media[i + HEAD.size : start]
        end = start + sum(lacing)
        raw = media[i:end]
        if version or len(lacing) < n or len(raw) < end - i or checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            damaged += 1
            continue
        streams.setdefault(serial, Stream(serial)).take(number, granule, flags, lacing, media[start:end])
        at = end
    return streams, damaged + (at < len(media))


def timestamps(stream: Stream, rate: int) -> list[float]:
    """Seconds at the end of each packet's page."""
    return [g / rate for g in stream.granules]


def read_back(media: bytes) -> tuple[bytes, str]:
    """The payload, and features of what was read: pages, packets, seconds, mean and peak, and whether the index agrees."""
    streams, damaged = demux(media)
    samples = next((s for s in streams.values() if s.packets and s.packets[0].startswith(SAMPLES)), None)
    index = next((s for s in streams.values() if s.packets and s.packets[0].startswith(INDEX)), None)
    if samples is None:
        return b"", f"streams={len(streams)};damaged={damaged}"
    rate, size = struct.unpack_from("<IQ", samples.packets[0], len(SAMPLES))
    payload = b"".join(samples.packets[1:])
    x = np.frombuffer(payload, np.uint8)
    sums = [struct.unpack("<IQ", p)[1] for p in index.packets[1:]] if index else []
    whole = len(payload) == size and sums == [int(np.frombuffer(p, np.uint8).sum(dtype=np.int64)) for p in samples.packets[1:]]
    times = timestamps(samples, rate)
    return payload, (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};damaged={damaged}"
        f";seconds={times[-1]:.6f};mean={x.sum(dtype=np.int64) / max(1, len(x)):.6f};peak={x.max(initial=0)};whole={str(whole).lower()}"
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: the container of each text."""

    def run(cols):
        made = [payload_of(t) for t in cols[text_col]]
        return {id_col: cols[id_col], "n_bytes": [n for n, _ in made], "media": [mux(p) for _, p in made]}

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_bytes long, media binary")


def features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes, digests and features of media, from the bytes alone."""

    def run(cols):
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in cols["media"]:
            payload, feature = read_back(media or b"")
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-16:]))
            out["media_bytes"].append(len(media or b""))
            out["media_sha256"].append(hashlib.sha256(media or b"").hexdigest())
            out["feature"].append(feature)
        return {id_col: cols[id_col], "n_bytes": cols["n_bytes"], **out}

    kind = dict(stored.dtypes)[id_col]
    return arrow_map(stored.select(id_col, "n_bytes", "media"), run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
