"""The corpus source: pruned listing, partitions, new files only."""

import os

from pyspark.sql import functions as F

from docloom.sources import corpus
from docloom.sources.front_matter import read_documents, write_document


def put(root, path, title="T", **keys):
    at = os.path.join(root, path)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w", encoding="utf-8") as f:
        f.write(write_document({"zdroj": "https://x.example/1", **keys}, title, f"Body of {path}"))
    return at


def some(root):
    for source in ("praha", "social", "psp"):
        for kind in ("a", "b"):
            for year in (2018, 2019):
                for i in range(3):
                    put(root, f"{source}/{kind}/{year}/{i}.md", stitky=["x", "y"], rok=str(year))
    put(root, "praha/a/other.md")
    with open(os.path.join(root, "praha/a/2018/bad.md"), "wb") as f:
        f.write(b"---\nzdroj: x\n---\n\xff\xfe")
    with open(os.path.join(root, "top.md"), "w") as f:
        f.write("no front matter")
    with open(os.path.join(root, "praha/a/2018/skip.txt"), "w") as f:
        f.write("x")


def read(spark, root, **options):
    return corpus.register(spark).read.format(corpus.NAME).options(path=str(root), **options).load()


def test_reads_what_the_file_reader_reads(spark, tmp_path):
    some(tmp_path)
    got = {r["path"]: r for r in read(spark, tmp_path).collect()}
    want = {r["path"].removeprefix("file:").replace("///", "/"): r for r in read_documents(spark, str(tmp_path)).collect()}
    assert len(got) == 39 and set(want) == set(got)
    for p, w in want.items():
        assert (got[p]["title"], got[p]["attrs"], got[p]["lists"], got[p]["body"], got[p]["error"], got[p]["year"]) == (w["title"], w["attrs"], w["lists"], w["body"], w["error"], w["year"])
    bad = next(r for p, r in got.items() if p.endswith("bad.md"))
    assert "UnicodeDecodeError" in bad["error"] and bad["body"] is None
    assert next(r for p, r in got.items() if p.endswith("top.md"))["source"] is None


def test_filters_cut_the_listing(spark, tmp_path, monkeypatch):
    some(tmp_path)
    os.chmod(tmp_path / "social", 0o755)
    df = read(spark, tmp_path).filter((F.col("source") == "praha") & F.col("year").isin(2019, 2020) & F.col("title").startswith("T"))
    assert {tuple(r["path"].split("/")[-4:-1]) for r in df.collect()} == {("praha", "a", "2019"), ("praha", "b", "2019")} and df.count() == 6
    opened = []

    class Seen(corpus.fs.LocalFileSystem):
        def get_file_info(self, what):
            opened.append(what.base_dir)
            return super().get_file_info(what)

    monkeypatch.setattr(corpus, "_opened", lambda root: (Seen(), root))
    files = corpus.listed(str(tmp_path), "*.md", {"source": {"praha"}, "year": {2019}})
    assert len(files) == 6 and all("/praha" in o and "2018" not in o for o in opened[1:])
    reader = corpus.CorpusReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([corpus.EqualTo(("source",), "praha"), corpus.In(("kind",), ("a", "z")), corpus.EqualTo(("kind",), "a"), corpus.EqualTo(("title",), "T")]))
    assert [f.attribute for f in rest] == [("title",)] and reader.wanted == {"source": {"praha"}, "kind": {"a"}}


def test_partitions_are_bounded(spark, tmp_path):
    files = [corpus.Found(f"f{i:03d}", 10 if i != 50 else 1000, i) for i in range(100)]
    parts = corpus.dealt(files, 16, 100)
    assert all(len(p.files) == 1 or sum(f.size for f in p.files) <= 100 for p in parts) and sorted(f.path for p in parts for f in p.files) == [f.path for f in files]
    some(tmp_path)
    assert read(spark, tmp_path, filesPerPartition=5).rdd.getNumPartitions() == 8
    assert read(spark, tmp_path).filter("source = 'nothing'").count() == 0


def test_a_stream_reads_only_what_is_new(spark, tmp_path):
    root, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for i in range(5):
        os.utime(put(root, f"praha/a/2018/{i}.md"), (1000 + i, 1000 + i))

    def run():
        stream = corpus.register(spark).readStream.format(corpus.NAME).options(path=root, settleSeconds="600").load().select("path", "title")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return [(os.path.basename(r["path"]), r["title"]) for r in spark.read.parquet(out).orderBy("path", "title").collect()]

    first = run()
    assert len(first) == 5 and run() == first  # nothing new, nothing read
    os.utime(put(root, "psp/b/2020/new.md", "New"), (2000, 2000))
    os.utime(put(root, "praha/a/2018/1.md", "Revised"), (2001, 2001))
    last = put(root, "praha/a/2018/9.md", "Still being written")  # changed just now: for a later run
    assert sorted(set(run()) - set(first)) == [("1.md", "Revised"), ("new.md", "New")]
    assert len(run()) == 7
    os.utime(last, (2002, 2002))
    assert len(run()) == 8
