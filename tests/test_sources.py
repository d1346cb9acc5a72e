import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from docloom.sources import archive, front_matter, records

DOC = """---
zdroj: 'https://register.example/2304'
nazev: "Schůzka: úvod"
typ: schuzka
viditelnost: verejne
stazeno: '2026-01-05'
datum: '2019-03-04'
cislo: '1001'
zkratka: null
ucastnici: []
nasi:
- Jana Nová
- 'O''Neil'
role:
- jmeno: A B
  role: vedoucí
tally:
  pro: 5
  proti: 1
tagy: [jedna, 'dva, tri']
---

# Titulek

# Druhý nadpis
- Tisk: Z-1
"""


def test_documents_keep_their_values(spark, tmp_path):
    (tmp_path / "data/evidence/2019").mkdir(parents=True)
    (tmp_path / "data/evidence/2019/a.md").write_text(DOC)
    (tmp_path / "data/evidence/2019/b.md").write_text("no front matter")
    docs = front_matter.read_documents(spark, str(tmp_path / "data"))
    good = docs.filter("error is null").first()
    assert good["attrs"]["cislo"] == "1001" and good["attrs"]["nazev"] == "Schůzka: úvod" and good["attrs"]["zkratka"] is None and "zkratka" in good["attrs"]
    assert good["lists"] == {"ucastnici": [], "nasi": ["Jana Nová", "O'Neil"], "tagy": ["jedna", "dva, tri"]}
    assert json.loads(good["records"]["role"]) == [{"jmeno": "A B", "role": "vedoucí"}] and json.loads(good["records"]["tally"])["pro"] == "5"
    assert good["title"] == "Titulek" and good["body"].startswith("# Druhý") and good["source"] == "evidence" and good["year"] == 2019
    assert docs.filter("error is not null").count() == 1
    typed = front_matter.typed(docs.filter("error is null")).first()
    assert str(typed["datum"]) == "2019-03-04" and typed["ts"] is None


def test_written_documents_come_back(spark):
    keys = {"zdroj": "u", "nazev": "It's: #1", "prazdne": None, "seznam": ["a", "b: c", "- d"], "nic": []}
    text = front_matter.write_document(keys, "T", "body\nline")
    row = front_matter.parse_documents(spark.createDataFrame([("p", text)], "path string, value string")).first()
    assert row["attrs"] == {"zdroj": "u", "nazev": "It's: #1", "prazdne": None} and row["lists"] == {"seznam": ["a", "b: c", "- d"], "nic": []}
    assert (row["title"], row["body"]) == ("T", "body\nline")


def test_instant_and_missing_dates(spark):
    texts = [("a", "---\ndatum: 2022-03-05T10:00:00Z\n---\n"), ("b", "---\nnazev: x\n---\n"), ("c", None)]
    got = {r["path"]: (r["datum"], r["ts"]) for r in front_matter.typed(front_matter.parse_documents(spark.createDataFrame(texts, "path string, value string"))).collect()}
    assert got["a"][0] is None and got["a"][1] is not None and got["b"] == (None, None) and got["c"] == (None, None)


def make_zip():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("dir/", b"")
        z.writestr("dir/a.txt", b"hello " * 100, zipfile.ZIP_DEFLATED)
        z.writestr("b.exe", b"no document")
        z.writestr("c.md", b"stored")
    return buffer.getvalue()


def test_archive_members_and_rejects(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(make_zip())
    (tmp_path / "broken.zip").write_bytes(b"PK nothing")
    rows = archive.read_members(spark, str(tmp_path), most=100).collect()
    status = {r["name"]: r["status"].split()[0] for r in rows}
    assert status == {"dir/a.txt": "SKIP", "c.md": "OK", None: "FAIL"}
    files = archive.list_files(spark, str(tmp_path)).groupBy("ext").count().collect()
    assert [tuple(r) for r in files] == [(".zip", 2)]


def test_damaged_archives_are_carved(spark):
    data = make_zip()
    cut = data[: data.rfind(b"PK\x05\x06")]  # the end record is lost
    damaged = b"junk" + cut
    descriptor = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 8, 0, 0, 0, 0, 0, 0, 5, 0) + b"d.txt" + b"payload" + b"PK\x07\x08" + struct.pack("<III", zlib.crc32(b"payload"), 7, 7)
    rows = archive.recover_members(spark.createDataFrame([("x", bytearray(damaged)), ("y", bytearray(descriptor))], "path string, content binary")).collect()
    found = {r["name"]: bytes(r["content"]) for r in rows if r["content"] is not None}
    assert found["dir/a.txt"] == b"hello " * 100 and found["c.md"] == b"stored" and found["d.txt"] == b"payload"
    hits = archive.hit_offsets(spark.createDataFrame([("y", "[[0, 1, 8, 0]]")], "path string, value string"))
    again = archive.recover_members(spark.createDataFrame([("y", bytearray(descriptor))], "path string, content binary"), hits).collect()
    assert [r["name"] for r in again] == ["d.txt"]


def test_nested_archives_come_back_whole():
    inner = make_zip()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", b"first")
        z.writestr("sub.vtt", b"no document of a recovery")
        z.writestr("sheet.xlsx", inner)  # stored, with headers and an end record of its own
    data = buffer.getvalue()
    cut = data[: data.rfind(b"PK\x01\x02", 0, data.rfind(b"PK\x05\x06"))]
    for damaged in (data, cut):
        assert list(archive.carve(damaged)) == [("a.txt", b"first", "OK"), ("sheet.xlsx", inner, "OK")]
    flagged = b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 20, 8, 0, 0, 0, 0, 0, 0, 6, 0) + b"s.xlsx" + inner
    assert list(archive.carve(flagged)) == [("s.xlsx", inner, "OK without checksum")]  # ends with the last end record
    assert list(archive.carve(flagged + b"PK\x07\x08" + struct.pack("<III", zlib.crc32(inner), len(inner), len(inner)) + b"tail")) == [("s.xlsx", inner, "OK")]
    broken = bytearray(data)
    broken[data.index(b"first")] ^= 1
    assert list(archive.carve(bytes(broken)))[0] == ("a.txt", None, "FAIL checksum")
    assert {".vtt", ".srt", ".tsv", ".odg"} <= set(archive.EXTENSIONS)


def test_records(spark, tmp_path):
    vote = {"id_hlasovani": 3180100017, "datum": "2020-01-02", "vysledek": "A", "pirati": {"X Y": "ano", "Z": "ne"}, "pirati_souhrn": {"ano": 1}}
    (tmp_path / "v.jsonl").write_text(json.dumps(vote) + "\n")
    got = records.read_votes(spark, str(tmp_path / "v.jsonl")).first()
    assert got["id_hlasovani"] == 3180100017 and got["pirati"] == {"X Y": "ano", "Z": "ne"}
    (tmp_path / "l.tsv").write_text(".doc\ta b.doc\tc.docx\n\n.xls\tx\ty\n")
    assert records.read_pairs(spark, str(tmp_path / "l.tsv")).count() == 2
    records.append_json(spark.range(2).select(F.col("id")), str(tmp_path / "log"))
    records.append_json(spark.range(1).select(F.col("id")), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3
    mixed = spark.createDataFrame([("[3180100017]",), ('{"pro": 5, "proti": 1}',), (None,), ("bad{",)], "v string")
    rows = [(r["ids"], r["tally"] and r["tally"]["pro"]) for r in records.heterogeneous_tally(mixed, "v").collect()]
    assert rows == [([3180100017], None), (None, 5), (None, None), (None, None)]
