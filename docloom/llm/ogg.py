"""Ogg media columns: pages with checksums, packets, logical streams and times (the RFC 3533 container).

``write_ogg`` stores bytes losslessly as unsigned 8-bit samples.  Blocks of samples are dealt in turn to ``LANES``
logical streams, whose pages are interleaved by time; a stream's first packet is a header, its last page says so.
``read_ogg`` reads any Ogg file: it verifies each page's checksum, follows the lacing values over page ends, keeps
streams apart by serial number, and derives each packet's times from the granule positions.  Damaged pages are
counted and skipped, packets with a missing part are dropped, and bytes between pages are passed over.

Defined results: null and empty texts are stored as 64 zero bytes; equal texts give equal files (serial numbers come
from the content); bytes that are no Ogg file give no streams and a null payload; repeated rows are each returned; an
empty table gives an empty table; a text is held whole in its task, a few times over; extra columns are kept, and one
that already has the media column's name with ``_in`` behind it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ._names import quoted, with_result

MAGIC = b"\x01lanes8\x00"
LANES = 2
BLOCK = 2048
#: Samples in a second.
RATE = 8000
_HEADER = struct.Struct("<4sBBqIIIB")
_OWN = struct.Struct("<8sBBHIQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_CONTINUED, _FIRST, _LAST = 1, 2, 4


def page_crc(page: bytes) -> int:
    """The container's CRC (polynomial 04C11DB7, most significant bit first, no inversion) by way of zlib's."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED), "little")


# ---- writing ---------------------------------------------------------------------------------------------------


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = bytearray(_HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body)
    page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
    return bytes(page)


def stream_pages(packets: list[tuple[bytes, int]], serial: int) -> list[tuple[int, bytes]]:
    """(time, page) of one stream from its packets and the granule at the end of each; the first has its own page."""
    pages: list[tuple[int, bytes]] = []
    lacing, body, granule, flags, time = bytearray(), [], -1, _FIRST, 0

    def flush(last: bool, goes_on: bool) -> None:
        nonlocal granule, flags
        pages.append((time, _page(flags | (_LAST if last else 0), granule, serial, len(pages), bytes(lacing), b"".join(body))))
        lacing.clear()
        body.clear()
        granule, flags = -1, _CONTINUED if goes_on else 0

    for i, (data, end) in enumerate(packets):
        at, values = 0, b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        while values:
            part, values = values[: 255 - len(lacing)], values[255 - len(lacing) :]
            size = min(255 * len(part), len(data) - at)
            lacing += part
            body.append(data[at : at + size])
            at += size
            if not values:
                granule = time = end
            if len(lacing) == 255 and values:
                flush(False, True)
        if i == 0 or len(lacing) == 255 or i == len(packets) - 1:
            flush(i == len(packets) - 1, False)
    return pages


def write_ogg(payload: bytes) -> bytes:
    """The bytes as 8-bit samples, dealt in blocks over the streams."""
    base = zlib.crc32(payload) & ~(LANES - 1)
    pages = []
    for lane in range(LANES):
        packets, done = [(_OWN.pack(MAGIC, lane, LANES, BLOCK, RATE, len(payload)), 0)], 0
        for at in range(lane * BLOCK, len(payload), LANES * BLOCK):
            block = payload[at : at + BLOCK]
            done += len(block)
            packets.append((block, done))
        pages += [(number > 0, time, lane, number, page) for number, (time, page) in enumerate(stream_pages(packets, base + lane))]
    return b"".join(p[-1] for p in sorted(pages, key=lambda p: p[:4]))


# ---- reading ---------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """A logical stream: packets, and the granule at the end of those that end a page (else -1)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    continued: int = 0
    lost: int = 0
    ended: bool = False
    partial: list[bytes] | None = None
    next_number: int = 0

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != self.next_number:
            self.lost += 1
            self.partial = None
        self.next_number, self.pages = number + 1, self.pages + 1
        skip = False
        if flags & _CONTINUED:
            self.continued += 1
            skip = self.partial is None  # its beginning is missing
        else:
            self.partial = None
        at, size, last = 0, 0, -1
        for value in lacing:
            size += value
            if value < 255:
                if skip:
                    skip = False
                else:
                    self.packets.append(b"".join([*(self.partial or ()), body[at : at + size]]))
                    self.granules.append(-1)
                    last = len(self.granules) - 1
                self.partial, at, size = None, at + size, 0
        if size or lacing[-1:] == b"\xff":
            if not skip:
                self.partial = [*(self.partial or ()), body[at : at + size]]
        if last >= 0 and granule >= 0:
            self.granules[last] = granule
        self.ended |= bool(flags & _LAST)

    def times(self, rate: int, samples=len) -> list[tuple[float, float]]:
        """Start and end of each packet in seconds; between page ends they follow from the packets' samples."""
        ends: list[int] = []
        known = -1
        for packet, granule in zip(reversed(self.packets), reversed(self.granules), strict=True):
            known = granule if granule >= 0 else known
            ends.append(known)
            known = known - samples(packet) if known >= 0 else -1
        ends.reverse()
        for i in range(1, len(ends)):  # behind the last granule, forwards
            if ends[i] < 0 <= ends[i - 1]:
                ends[i] = ends[i - 1] + samples(self.packets[i])
        return [((e - samples(p)) / rate, e / rate) for p, e in zip(self.packets, ends, strict=True)]


@dataclass
class Ogg:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad: int = 0
    skipped: int = 0

    def payload(self) -> bytes | None:
        """What ``write_ogg`` stored, or None if it is not whole."""
        lanes: dict[int, list[bytes]] = {}
        facts = set()
        for s in self.streams.values():
            if not s.packets or len(s.packets[0]) != _OWN.size or s.lost or not s.ended:
                return None
            magic, lane, n, block, rate, total = _OWN.unpack(s.packets[0])
            facts.add((magic, n, block, rate, total))
            lanes[lane] = s.packets[1:]
        if len(facts) != 1 or (fact := facts.pop())[0] != MAGIC or sorted(lanes) != list(range(fact[1])):
            return None
        blocks = [b for i in range(max(map(len, lanes.values()))) for lane in sorted(lanes) for b in lanes[lane][i : i + 1]]
        out = b"".join(blocks)
        return out if len(out) == fact[4] else None


def read_ogg(media: bytes) -> Ogg:
    """All pages of a file, by logical stream."""
    out, at = Ogg(), 0
    while (found := media.find(b"OggS", at)) >= 0:
        out.skipped += found - at
        if found + 27 > len(media):
            out.bad += 1
            return out
        _, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(media, found)
        start = found + 27 + n
        lacing = media[found + 27 : start]
        end = start + sum(lacing)
        page = media[found:end]
        if version or len(lacing) < n or len(page) < end - found or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad += 1
            at = found + 4
            continue
        out.pages += 1
        out.streams.setdefault(serial, Stream(serial)).take(flags, granule, number, lacing, media[start:end])
        at = end
    out.skipped += len(media) - at
    return out


# ---- columns ---------------------------------------------------------------------------------------------------


def padded(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 if data else 64)


@F.arrow_udf(T.BinaryType())
def encode_text(texts: pa.Array) -> pa.Array:
    """Each text's padded bytes as an Ogg file."""
    return pa.array((write_ogg(padded(t.as_py())) for t in texts), pa.binary())


def _facts(media: bytes) -> dict:
    file = read_ogg(media)
    payload = file.payload()
    streams = sorted(file.streams.values(), key=lambda s: s.serial)
    ends = [t[-1][1] for s in streams if (t := s.times(RATE, lambda p: 0 if p[:8] == MAGIC else len(p)))]
    samples = np.frombuffer(payload or b"", np.uint8)
    feature = [
        f"streams={len(streams)}",
        f"pages={file.pages}",
        f"bad={file.bad}",
        f"packets={sum(len(s.packets) for s in streams)}",
        f"continued={sum(s.continued for s in streams)}",
        f"seconds={max(ends, default=0.0):.6f}",
        f"mean={samples.mean():.6f}" if len(samples) else "mean=",
        f"peak={samples.max()}" if len(samples) else "peak=",
    ]
    return {
        "payload_bytes": None if payload is None else len(payload),
        "payload_sha256": None if payload is None else hashlib.sha256(payload).hexdigest(),
        "tail_crc32": None if payload is None else zlib.crc32(payload[-64:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": ";".join(feature),
        "pages": file.pages,
        "bad_pages": file.bad,
    }


_FACTS = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int64()), ("bad_pages", pa.int64())])
_PACKETS = pa.list_(pa.struct([("serial", pa.int64()), ("packet", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("data", pa.binary())]))


@F.arrow_udf(from_arrow_type(_FACTS))
def media_facts(media: pa.Array) -> pa.Array:
    """Digests and features of what a stored file holds; null for null."""
    return pa.array((None if (m := x.as_py()) is None else _facts(m) for x in media), _FACTS)


@F.arrow_udf(from_arrow_type(_PACKETS))
def media_packets(media: pa.Array) -> pa.Array:
    """Every logical stream's packets with their times; null for null."""

    def packets(m: bytes) -> list[dict]:
        out = []
        for s in read_ogg(m).streams.values():
            times = s.times(RATE, lambda p: 0 if p[:8] == MAGIC else len(p))
            out += [{"serial": s.serial, "packet": i, "start_s": a, "end_s": b, "data": p} for i, (p, (a, b)) in enumerate(zip(s.packets, times, strict=True))]
        return out

    return pa.array((None if (m := x.as_py()) is None else packets(m) for x in media), _PACKETS)


def with_media(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``docs`` with the text's Ogg file in ``media_col``."""
    return with_result(docs, media_col, encode_text(quoted(text_col).cast("string")))


def op1_media_ogg(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length(text).cast("long").alias("n_bytes"))
    facts: Column = media_facts(F.col("media"))
    return with_media(docs).select("doc_id", "n_bytes", facts.alias("f")).select("doc_id", "n_bytes", "f.*")
