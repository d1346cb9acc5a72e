import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from docloom.operators import digest, documents, hierarchy, intervals, mentions, search, votes
from docloom.registry import PLUGINS, Tools
from docloom.streaming import append_log, monthly_counts, read_current, upsert, weekly_counts

SF = "/root/testdata/sf0.001"


def test_members_only_documents_never_come_out(spark):
    docs = spark.createDataFrame([("a", "verejne"), ("b", "clenske"), ("c", None)], "path string, viditelnost string")
    assert [r["path"] for r in documents.public_only(docs).collect()] == ["a"]


def test_votes(spark):
    rows = [(1, "a", "ano"), (1, "b", "ano"), (1, "c", "ne"), (1, "d", "nepritomen"), (2, "a", "ne"), (2, "b", "ne"), (2, "c", "ano"), (3, "a", "ano"), (3, "b", "ne")]
    v = spark.createDataFrame(rows, "vote int, member string, value string")
    assert dict(map(tuple, votes.faction_tally(v).collect())) == {1: "ano 2, ne 1, nepritomen 1", 2: "ne 2, ano 1", 3: "ano 1, ne 1"}
    assert sorted(map(tuple, votes.dissenters(v).collect())) == [(1, "c", "ne"), (1, "d", "nepritomen"), (3, "b", "ne")]
    t = {r["vote"]: (r["pro"], r["present"], r["passed"]) for r in votes.totals(v, {"pro": "ano", "proti": "ne"}).collect()}
    assert t == {1: (2, 3, True), 2: (1, 3, False), 3: (1, 2, False)}
    assert {r["ties"] for r in votes.plurality(v).filter("vote = 3").collect()} == {2}
    pairs = spark.createDataFrame([("k tisku Z?8983 x", n) for n in ("Z-8983", "Z-898", "Z-983", "Z-89831", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(votes.number_match(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True]


def test_holders_and_versions(spark):
    spells = spark.sql("SELECT 'mayor' title, timestamp_ntz '2018-11-01' since, timestamp_ntz '2023-02-01' until, 'A' holder UNION ALL SELECT 'mayor', timestamp_ntz '2024-01-01', null, 'B'")
    facts = spark.createDataFrame([(1, "mayor", "2018-11-01"), (2, "mayor", "2023-02-01"), (3, "mayor", "2030-01-01"), (4, "clerk", "2020-01-01")], "id int, title string, d string").withColumn("at", F.col("d").cast("timestamp_ntz"))
    joined = intervals.holder_join(facts, spells, "title", F.col("at"))
    assert {r["id"]: r["holder"] for r in joined.collect()} == {1: "A", 2: None, 3: "B", 4: None}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    versions = spark.createDataFrame([("r", "2019-01-01", "v1"), ("r", "2020-01-01", "v2")], "key string, since string, version string")
    asked = spark.createDataFrame([(1, "r", "2018-12-31"), (2, "r", "2019-01-01"), (3, "r", "2021-01-01"), (4, "s", "2021-01-01")], "id int, key string, at string")
    assert {r["id"]: r["version"] for r in intervals.as_of(asked, versions, "key", "at", "since", "version").collect()} == {1: None, 2: "v1", 3: "v2", 4: None}
    titles = spark.sql("SELECT 'ministr A a ministr B' t").select(intervals.titles(F.col("t")).alias("t")).first()["t"]
    assert titles == ["ministr A", "ministr B"]


def test_hierarchy(spark):
    e = spark.createDataFrame([("top", None), ("a", "top"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "gone")], "child string, parent string")
    assert {r["unit"]: r["depth"] for r in hierarchy.depths(e).collect()} == {"top": 0, "a": 1, "b": 2}
    assert [r["unit"] for r in hierarchy.missing_parents(e.withColumnRenamed("child", "unit")).collect()] == ["z"]
    listed = spark.createDataFrame([("a", "top"), ("b", "top")], "unit string, parent string")
    found = {(r["unit"], r["parent"]): r["rule"][:6] for r in hierarchy.inconsistencies(e.withColumnRenamed("child", "unit").filter("unit in ('a', 'b')"), listed).collect()}
    assert found == {("b", "a"): "not li", ("b", "top"): "listed"}


def test_hierarchy_has_no_limit_of_depth_or_rows(spark):
    chain = [("u0", None), *((f"u{i}", f"u{i - 1}") for i in range(1, 151)), ("u3", "u1")]  # u3 has two parents
    got = [tuple(r) for r in hierarchy.depths(spark.createDataFrame(chain, "child string, parent string")).collect()]
    want = [(f"u{i}", "u0", i, "/".join(f"u{j}" for j in range(i + 1))) for i in range(151)]
    want += [(f"u{i}", "u0", i - 1, "/".join(f"u{j}" for j in range(i + 1) if j != 2)) for i in range(3, 151)]
    assert sorted(got) == sorted(want)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        wide = spark.createDataFrame([("top", None), *((f"a{i}", "top") for i in range(40))], "child string, parent string")
        assert hierarchy.depths(wide).count() == 41
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_mentions_and_search(spark):
    docs = spark.createDataFrame([(1, "Jana Nová a Petr."), (2, "jana nova, JANA NOVÁ!"), (3, "Janan ova"), (4, None)], "doc_id long, text string")
    names = spark.createDataFrame([("jn", "Jana Nová"), ("p", "Petr"), ("empty", "")], "entity string, name string")
    assert sorted(map(tuple, mentions.mention_join(docs, names).collect())) == [(1, "jn", 1), (1, "p", 1), (2, "jn", 2)]
    assert [r["doc_id"] for r in search.search(docs, "nová JANA", match_all=True).collect()] == [2, 1]
    assert search.search(docs, "!!").count() == 0
    assert [tuple(r) for r in search.phrase(docs, "jana nova").orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


def test_names_of_any_length_and_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(40)}" for _ in range(3000)]
    names = [(f"e{n}-{i}", " ".join(words[i * 7 : i * 7 + n])) for n in range(1, 13) for i in range(9)] + [("twin", words[0])]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:9])), (2, "W0, w1!"), (3, "")], "doc_id long, text string")
    table = spark.createDataFrame(names, "entity string, name string")
    want = {}
    for d, text in ((1, words), (2, words[:9]), (2, ["w0", "w1"])):
        for e, name in names:
            parts = name.split()
            if n := sum(text[i : i + len(parts)] == parts for i in range(len(text))):
                want[d, e] = want.get((d, e), 0) + n
    for most in (1 << 24, 2000):  # in one part and in several
        assert {(r.doc_id, r.entity): r.n for r in mentions.mention_join(docs, table, most_bytes=most).collect()} == want
    plan = mentions.mention_join(docs, table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("split(") == 1  # each text is cut once
    began = time.time()
    long = spark.createDataFrame([(1, " ".join(words * 1500))], "doc_id long, text string")  # 15 MB
    assert mentions.mention_join(long, table).filter("entity = 'twin'").first()["n"] == words.count(words[0]) * 1500
    assert time.time() - began < 60


def test_document_rules(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "path string, body string")
    assert {r["path"]: r["n"] for r in documents.one_per_content(files, F.col("body")).collect()} == {"a": 2, "c": 1}
    assert [tuple(r) for r in documents.other_places(files, F.col("body")).collect()] == [("a", "b")]
    paths = spark.createDataFrame([("d/d/x/1.pdf",), ("d/y/2.txt",), ("e/3",)], "path string")
    assert dict(map(tuple, documents.prefix_counts(paths, 2).collect())) == {"d/x": 1, "d/y": 1, "e/3": 1}
    bad = spark.createDataFrame([("p", {"typ": "brand", "zdroj": "u", "nazev": "n", "viditelnost": "verejne", "stazeno": "d", "autorita": "a"})], "path string, attrs map<string,string>")
    assert [r["rule"] for r in documents.violations(bad).collect()] == ["reviewed_at"]
    within, rejected = documents.split_by_size(spark.range(5).withColumnRenamed("id", "size"), "size", 2)
    assert within.count() == 3 and rejected.count() == 2


def test_null_contents_are_nobodys_copies(spark):
    files = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "path string, body string")
    assert [tuple(r)[1:] for r in documents.one_per_content(files, F.col("body")).collect()] == [("c", 1)]
    assert documents.other_places(files, F.col("body")).count() == 0


def test_stated_votes_and_provisions(spark):
    rows = spark.createDataFrame([(35, 2, 1, 0, 38), (35, 2, 1, 5, 38), (19, 1, 0, 0, 38), (None, 1, 0, 0, 38)], "pro int, proti int, zdrzel int, nehlasoval int, pritomno int")
    got = votes.stated_totals(rows, "pro", "pritomno", ("pro", "proti", "zdrzel", "nehlasoval")).select("passes", "consistent").collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, True), (None, None)]
    from docloom.functions import text as T

    found = spark.createDataFrame([("podle čl. 9 odst. 5 písm. b) a § 12a odst. 1, § 3",), (None,), ("nic",)], "x string").select(T.provisions(F.col("x")).alias("p")).collect()
    assert [tuple(p) for p in found[0]["p"]] == [("article", "9", 5, "b"), ("section", "12a", 1, None), ("section", "3", None, None)] and found[2]["p"] == []


def test_digest(spark, tmp_path):
    items = spark.createDataFrame([("votes", "V & 1", "http://a", "x", datetime(2026, 11, 9)), ("votes", "V2", "http://b", "x", datetime(2026, 11, 10)), ("media", "M", "http://c", "x", datetime(2026, 11, 15)), ("media", "no source", "", "x", datetime(2026, 11, 15)), ("media", "later", "http://d", "x", datetime(2026, 11, 16))], "section string, title string, zdroj string, autorita string, ts timestamp")
    ranked = digest.week_items(items)
    texts = {r["name"]: r["text"] for r in digest.markdown(ranked).collect()}
    assert set(texts) == {"2026-T46.md", "2026-T47.md"} and "## media (1)" in texts["2026-T46.md"] and texts["2026-T46.md"].index("V2") < texts["2026-T46.md"].index("V & 1")
    assert [r["week"] for r in digest.week_index(digest.markdown(ranked)).collect()] == ["2026-T47", "2026-T46"]
    digest.write_feed(ranked, str(tmp_path / "feed"), "News")
    feed = spark.read.text(str(tmp_path / "feed")).first()[0]
    assert feed.count("<item>") == 4 and "V &amp; 1" in feed and feed.index("later") < feed.index("V2")
    releases = spark.createDataFrame([("u", "Prosadili jsme zákon", "x"), ("w", "Nic", "y")], "zdroj string, nazev string, body string")
    v = spark.createDataFrame([("t", "n", "Prijato", 7, 13), ("q", "n", "prijato", 6, 13)], "zdroj string, nazev string, vysledek string, ano int, total int")
    assert sorted(r["zdroj"] for r in digest.result_proposals(releases, v, ("prosadil",)).collect()) == ["t", "u"]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.filter("event_id % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    events.filter("event_id % 2 = 1").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = weekly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("weekly").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r["week"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("weekly")) == key(weekly_counts(events))
    q = stream.writeStream.foreachBatch(upsert(str(tmp_path / "table"), ["user_id"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    q = monthly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("monthly").trigger(availableNow=True).start()
    q.awaitTermination()
    by_month = lambda df: sorted((str(r["month"]), r["event_type"], r["n"]) for r in df.collect())
    assert by_month(spark.table("monthly")) == by_month(monthly_counts(events))
    latest = documents.latest(events, ["user_id"], ["ts", "event_id"])
    assert sorted(r["event_id"] for r in read_current(spark, str(tmp_path / "table")).collect()) == sorted(r["event_id"] for r in latest.collect())
    append_log(stream.select("event_id"), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    append_log(stream.select("event_id"), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == events.count()


def test_subtitles_that_come_later_replace_what_was_missing(spark, tmp_path):
    keep = upsert(str(tmp_path / "videos"), ["video"], ["fetched"])
    schema = "video string, fetched int, subtitles string"
    keep(spark.createDataFrame([("a", 1, None), ("b", 1, "text")], schema), 0)
    keep(spark.createDataFrame([("a", 2, "late"), ("b", 0, "older")], schema), 1)
    assert {r.video: r.subtitles for r in read_current(spark, str(tmp_path / "videos")).collect()} == {"a": "late", "b": "text"}


def test_tools(spark, tmp_path):
    tools = Tools(spark, SF, str(tmp_path)).load([*PLUGINS, "docloom.no_such_plugin"])
    assert tools.missing == ["docloom.no_such_plugin"]
    assert tools.call("search", query="the that", k=3).count() == 3
    assert tools.call("overview", cap=2).count() == 2
    assert "no tool" in tools.guarded("nothing").first()["error"] and "takes" in tools.guarded("search", bad=1).first()["error"]
    tools.add("dies", lambda spark, d: spark.range(3).select(F.raise_error(F.lit("no such row"))))
    assert "no such row" in tools.guarded("dies").first()["error"]
    assert [r["doc_id"] for r in tools.guarded("query_anti_gap", cap=3).collect()] == sorted(r["doc_id"] for r in tools.tools["query_anti_gap"](spark, SF).collect())[:3]
    claim = tools.call("verify_claim", claim="the that", k=4).collect()
    assert len(claim) == 4 and [r["all_words"] for r in claim] == sorted((r["all_words"] for r in claim), reverse=True)
    tools.report_gap("What?")
    assert "search" in (tmp_path / "telemetry.jsonl").read_text() and "What?" in (tmp_path / "gaps.jsonl").read_text()


def test_lazy_names():
    import docloom
    import pytest

    assert callable(docloom.fold) and callable(docloom.Tools)
    with pytest.raises(AttributeError):
        docloom.nothing
