import hashlib
import os
import zlib

import pytest

from docloom.llm import ogg


def slow_crc(data):
    c = 0
    for x in data:
        c ^= x << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("n", [64, 2048, 2112, 4096, 65536, 400_000 // 64 * 64])
def test_round_trip(n):
    data = os.urandom(n)
    file = ogg.read_ogg(media := ogg.write_ogg(data))
    assert file.payload() == data and not file.bad and not file.skipped
    assert slow_crc(b"OggS" + data[:60]) == ogg.page_crc(b"OggS" + data[:60])
    ends = [s.times(ogg.RATE, lambda p: 0 if p[:8] == ogg.MAGIC else len(p))[-1][1] for s in file.streams.values()]
    assert sum(round(e * ogg.RATE) for e in ends) == n and len(file.streams) == ogg.LANES
    assert ogg.write_ogg(data) == media


def test_packets_over_page_ends_and_times():
    packets = [(b"h" * 10, 0), (os.urandom(70_000), 70_000), (b"", 70_000), (os.urandom(255), 70_255), (os.urandom(130_050), 200_305)]
    pages = [p for _, p in ogg.stream_pages(packets, 7)]
    stream = ogg.read_ogg(b"junk" + b"".join(pages)).streams[7]
    assert [p for p, _ in packets] == stream.packets and stream.continued >= 2 and stream.ended
    times = stream.times(1000, lambda p: 0 if p[:1] == b"h" and len(p) == 10 else len(p))
    assert times[1] == (0.0, 70.0) and times[-1] == (70.255, 200.305)


def test_damage_is_found():
    media = bytearray(ogg.write_ogg(os.urandom(64_000)))
    media[40_000] ^= 1
    file = ogg.read_ogg(bytes(media))
    assert file.bad == 1 and file.payload() is None
    assert ogg.read_ogg(b"").pages == 0 and ogg.read_ogg(b"OggS").bad == 1 and ogg.read_ogg(b"no media").payload() is None


def test_columns(frame, spark):
    rows = [(1, None), (2, ""), (3, "Žluťoučký kůň 😀" * 300), (4, "Žluťoučký kůň 😀" * 300), (4, "x")]
    from pyspark.sql import functions as F

    got = ogg.with_media(frame(rows)).select("doc_id", "text", ogg.media_facts(F.col("media")).alias("f"), F.size(ogg.media_packets(F.col("media"))).alias("n")).collect()
    for r in got:
        data = ogg.padded(r["text"])
        assert len(data) % 64 == 0 and len(data) >= 64
        assert (r["f"]["payload_bytes"], r["f"]["payload_sha256"], r["f"]["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert r["n"] >= 3
    same = [r["f"] for r in got if len(r["text"] or "") > 10]
    assert same[0] == same[1]
    assert ogg.with_media(frame([])).count() == 0
    assert spark.createDataFrame([(None,), (b"xx",)], "media binary").select(ogg.media_facts(F.col("media")).alias("f")).collect()[0]["f"] is None
