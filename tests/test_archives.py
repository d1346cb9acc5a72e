"""Archives in files: what many tasks read is what one reader of the whole bytes finds."""

import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from docloom.sources import archive


def rows(members):
    return sorted((r["archive"].rsplit("/", 1)[1], r["name"] or "", r["status"], bytes(r["content"]) if r["content"] is not None else b"none") for r in members.collect())


def zipped(*members, close=True):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content, method in members:
            z.writestr(name, content, method)
    data = buffer.getvalue()
    return data if close else data[: data.index(b"PK\x01\x02")]


def damaged():
    inner = zipped(("in.txt", b"inner text " * 9, zipfile.ZIP_DEFLATED), ("in.md", b"x", zipfile.ZIP_STORED))
    flagged = lambda name, body: b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 8, 0, 0, 0, 0, 0, 0, len(name), 0) + name + body
    told = lambda body: b"PK\x07\x08" + struct.pack("<III", zlib.crc32(body), len(body), len(body))
    plain = zipped(("a.txt", b"hello " * 5000, zipfile.ZIP_DEFLATED), ("dir/", b"", zipfile.ZIP_STORED), ("b.xlsx", inner, zipfile.ZIP_STORED), ("c.exe", b"no", zipfile.ZIP_STORED), ("d.md", b"", zipfile.ZIP_STORED))
    broken = bytearray(plain)
    broken[plain.index(b"inner") if b"inner" in plain else 60] ^= 1
    return {
        "plain.zip": plain,
        "front.zip": b"junk PK\x03" + plain,
        "cut.zip": plain[: plain.index(b"b.xlsx") + 20],
        "broken.zip": bytes(broken),
        "told.zip": flagged(b"e.txt", inner) + told(inner) + flagged(b"f.txt", b"after"),
        "last.zip": flagged(b"g.docx", inner + b"PK\x07\x08") + b"tail",
        "empty.zip": b"",
        "short.zip": b"PK\x03\x04",
        "none.zip": b"nothing here",
    }


def test_carving_files_is_carving_their_bytes(spark, tmp_path):
    for name, data in damaged().items():
        (tmp_path / name).write_bytes(data)
    expected = sorted((name, n, status, c if c is not None else b"none") for name, data in damaged().items() for n, c, status in archive.carve(data))
    assert len(expected) > 9 and {s.split()[0] for _, _, s, _ in expected} == {"OK", "FAIL"}
    for block in (archive.BLOCK, 7):  # a mark may lie across blocks
        assert rows(archive.recover_files(spark, str(tmp_path), block=block)) == expected


def test_members_at_hits_end_at_the_next_hit(spark, tmp_path):
    head = lambda name: b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 8, 0, 0, 0, 0, 0, 0, len(name), 0) + name
    data = head(b"a.txt") + b"first" + head(b"b.txt") + b"second" + b"PK\x05\x06" + bytes(18) + b"rest"
    (tmp_path / "x.zip").write_bytes(data)
    at = [0, data.index(b"PK\x03\x04", 4)]
    path = archive.header_offsets(spark, str(tmp_path)).first()["archive"]
    hits = spark.createDataFrame([(path, x) for x in [*at, *at, at[1] + 3, len(data) + 9]], "archive string, at long")
    got = rows(archive.recover_files(spark, str(tmp_path), hits))
    assert got == sorted(("x.zip", n, s, c if c is not None else b"none") for n, c, s in archive.carve(data, [*at, at[1] + 3, len(data) + 9]))
    assert ("x.zip", "a.txt", "OK without checksum", b"first") in got and ("x.zip", "b.txt", "FAIL next hit inside the header", b"none") in got
    got = rows(archive.recover_files(spark, str(tmp_path), hits.filter(F.col("at").isin(at))))
    assert ("x.zip", "b.txt", "OK without checksum", b"second" + b"PK\x05\x06" + bytes(18)) in got


def test_members_of_good_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"front" + zipped(("T.TXT", b"t" * 70, zipfile.ZIP_DEFLATED), ("long.md", b"z" * 101, zipfile.ZIP_DEFLATED), ("e.md", b"", zipfile.ZIP_STORED), ("l.md", b"q", zipfile.ZIP_LZMA), ("s.md", b"q", zipfile.ZIP_BZIP2)))
    (tmp_path / "bad.zip").write_bytes(b"PK")
    (tmp_path / "none.zip").write_bytes(zipped())  # an archive without members gives no row
    found = archive.read_members(spark, str(tmp_path), most=100).collect()
    got = {r["name"]: (r["status"], r["size"]) for r in found}
    assert len(found) == len(got)
    bad = got.pop(None)
    assert bad[0].startswith("FAIL")
    assert got == {"T.TXT": ("OK", 70), "long.md": ("SKIP too large", 101), "e.md": ("OK", 0), "l.md": ("FAIL method 14", 1), "s.md": ("FAIL method 12", 1)}


def test_a_member_that_lies_about_its_size_is_not_unpacked_whole():
    data = zipped(("bomb.txt", bytes(50_000_000), zipfile.ZIP_DEFLATED))
    name, content, size, status, end = archive.member_at(io.BytesIO(data), 0, most=1000)
    assert (name, content, size, status) == ("bomb.txt", None, 50_000_000, "SKIP too large") and data[end : end + 4] == b"PK\x01\x02"


def test_archives_come_back(spark, tmp_path):
    files = spark.createDataFrame([(f"{i}.txt", bytearray(b"text %d " % i * (i * 400))) for i in range(40)] + [("none.txt", None)], "name string, content binary").repartition(3)
    assert archive.write_archives(files, str(tmp_path / "z")) == 41
    expected = sorted((f"{i}.txt", b"text %d " % i * (i * 400)) for i in range(40)) + [("none.txt", b"")]
    for read in (archive.read_members, archive.recover_files):
        assert sorted((n, c) for _, n, s, c in rows(read(spark, str(tmp_path / "z"))) if s == "OK") == expected
    assert archive.write_archives(files.limit(0), str(tmp_path / "none")) == 0
