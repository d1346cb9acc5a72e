"""The written index against scans of the texts and plain Python."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import index as I
from docloom.operators import search

WORDS = ["ano", "ne", "poslanec", "poslanci", "schůze", "schůzka", "schody", "a", "the", "x1"]


def texts(n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(WORDS, range(1, len(WORDS) + 1), k=r.randrange(1, 40))), r.choice("ab")) for i in range(n)]


def brute(rows, parts, k, match_all=False):
    """BM25 where a part is a list of words, or a prefix that ends in a star; folded words, no stems."""
    docs = {i: [w.replace("ů", "u") for w in t.split()] for i, t, *_ in rows}
    mean = sum(map(len, docs.values())) / len(docs)

    def times(w, part):
        if isinstance(part, str):
            return sum(x.startswith(part[:-1]) for x in w)
        return sum(w[i : i + len(part)] == part for i in range(len(w)))

    tf = {p if isinstance(p, str) else tuple(p): {i: t for i, w in docs.items() if (t := times(w, p))} for p in parts}
    score = {}
    for found in tf.values():
        idf = math.log(1 + (len(docs) - len(found) + 0.5) / (len(found) + 0.5))
        for i, t in found.items():
            score[i] = score.get(i, 0) + idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    ids = [i for i in score if not match_all or all(i in f for f in tf.values())]
    return sorted(((round(score[i], 6), i) for i in ids), key=lambda x: (-x[0], x[1]))[:k]


def ranked(df):
    return [(round(r["score"], 6), r["doc_id"]) for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(300), "doc_id long, text string, kind string").cache()


@pytest.fixture(scope="module")
def path(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    I.write_index(docs, path, stemmed=False, keep=("kind",))
    return path


def test_words_phrases_and_prefixes(spark, path):
    rows = texts(300)
    ask = lambda q, **how: ranked(I.search_index(spark, path, q, 15, **how))
    assert ask("Poslanec SCHŮZE") == brute(rows, [["poslanec"], ["schuze"]], 15)
    assert ask("poslanec schůze", match_all=True) == brute(rows, [["poslanec"], ["schuze"]], 15, True)
    assert ask('"the the"') == brute(rows, [["the", "the"]], 15)
    assert ask('"a the a"') == brute(rows, [["a", "the", "a"]], 15)
    assert ask("sch*") == brute(rows, ["sch*"], 15)
    assert ask('ne "the x1" posl*', match_all=True) == brute(rows, [["ne"], ["the", "x1"], "posl*"], 15, True)
    assert ask("nothing*") == ask('"ano nothing"') == ask("") == ask('!! "" *') == []
    assert ask('"ano"') == ask("ano") == brute(rows, [["ano"]], 15)


def test_filters_by_kept_columns(spark, path):
    rows = texts(300)
    kind = {i: k for i, _, k in rows}
    assert ranked(I.search_index(spark, path, "ano", 500, where=F.col("kind") == "a")) == [x for x in brute(rows, [["ano"]], 500) if kind[x[1]] == "a"]


def test_parts_written_one_by_one_are_one_index(spark, docs, path, tmp_path):
    grown = str(tmp_path / "grown")
    I.write_index(docs.filter("doc_id < 100"), grown, stemmed=False, keep=("kind",))
    before = I.open_index(spark, grown)
    assert I.append_index(docs.filter("doc_id between 50 and 200"), grown) == 101  # those from 100 on are new
    assert I.append_index(docs.filter("doc_id > 200"), grown) == 99
    assert I.append_index(docs.limit(0), grown) == 0
    for q in ("poslanec schůze", "sch*", '"the the" a'):
        assert ranked(I.search_index(spark, grown, q, 20)) == ranked(I.search_index(spark, path, q, 20))
    one, many = I.open_index(spark, path), I.open_index(spark, grown)
    assert sorted(map(tuple, one.terms().collect())) == sorted(map(tuple, many.terms().collect()))
    assert before.n == 100 and ranked(before.search("ano", 5)) == brute(texts(300)[:100], [["ano"]], 5)  # as it was when opened


def test_the_options_are_the_indexs_own(spark, docs, tmp_path):
    path = str(tmp_path / "stems")
    I.write_index(docs, path)
    for asked in ("poslance", "POSLANCI", "schůzky"):
        stem = search.query_terms(asked, True)[0]
        want = {i for i, t, _ in texts(300) if any(search.query_terms(w, True)[0] == stem for w in t.split())}
        assert {r["doc_id"] for r in I.search_index(spark, path, asked, 1000).collect()} == want
    assert len(want) > 50


def test_windows_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "WINDOW", 20)
    monkeypatch.setattr(I, "FIRST_WINDOWS", 2)
    rows = [(i, "common " + " ".join(["filler"] * (50 + i % 30)), "a") for i in range(2000)] + [(5000 + i, "common " * 3, "a") for i in range(3)]
    path = str(tmp_path / "blocks")
    I.write_index(spark.createDataFrame(rows, "doc_id long, text string, kind string"), path, stemmed=False)
    opened = I.open_index(spark, path)
    kept = [r["kept"] for r in opened.blocks(["common"], 3).collect()]
    assert len(kept) >= 90 and 1 <= sum(kept) <= 3
    assert ranked(opened.search("common", 3)) == brute(rows, [["common"]], 3)
    rare = opened.blocks(["common", "filler"], 3)
    assert rare.select("segment", "window").distinct().count() >= 90
    for k in (1, 5, 40):
        assert ranked(opened.search("common filler", k)) == brute(rows, [["common"], ["filler"]], k)


def test_a_search_opens_only_its_words_folders(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "FOLDER_WORDS", 300)
    path = str(tmp_path / "folders")
    I.write_index(docs, path, stemmed=False)
    opened = I.open_index(spark, path)
    assert opened.options["segments"][0]["folders"] > 10
    plan = opened.rows(["ano"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan
    assert ranked(opened.search("ano schůze", 9)) == brute(texts(300), [["ano"], ["schuze"]], 9)
    names = opened.with_prefix("sch")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,sch)" in names and sorted(r["term"] for r in opened.with_prefix("sch").collect()) == ["schody", "schuze", "schuzka"]


def test_empty_index_and_null_texts(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    path = str(tmp_path / "none")
    I.write_index(none, path)
    assert I.search_index(spark, path, "ano").count() == 0
    assert I.append_index(spark.createDataFrame([(1, None), (2, ""), (3, "ano")], "doc_id long, text string"), path) == 3
    assert [r["doc_id"] for r in I.search_index(spark, path, "ano").collect()] == [3]


def test_prefixes_are_ranges_of_the_postings(spark, path):
    """No list of words is met with all rows."""
    plan = I.open_index(spark, path).prefix("sch")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,sch)" in plan and "Join" not in plan


def test_windows_are_grouped_where_their_texts_lie(monkeypatch):
    """Words in order of word, document and place; many words give several rows, none loses a posting."""
    docs = [(0, i, t.split()) for i, t in enumerate(("b a b", "", "a", "c b"))] + [(5, 9, ["a"])]
    batches = lambda step: (pa.RecordBatch.from_pylist([dict(zip(("window", "id", "words"), d, strict=True)) for d in docs[i : i + step]], schema=pa.schema([("id", pa.int64()), ("window", pa.int32()), ("words", pa.list_(pa.string()))])) for i in range(0, len(docs), step))
    got = [r for b in I._inverted(pa.int64())(batches(2)) for r in b.to_pylist()]
    flat = lambda rows: sorted((r["window"], r["term"], p["id"], p["tf"], p["length"], tuple(p["places"])) for r in rows for p in r["postings"])
    assert flat(got) == [(0, "a", 0, 1, 3, (1,)), (0, "a", 2, 1, 1, (0,)), (0, "b", 0, 2, 3, (0, 2)), (0, "b", 3, 1, 2, (1,)), (0, "c", 3, 1, 2, (0,)), (5, "a", 9, 1, 1, (0,))]
    facts = {(r["window"], r["term"]): (r["n"], r["max_tf"], r["min_length"], r["cf"]) for r in got}
    assert facts == {(0, "a"): (2, 1, 1, 2), (0, "b"): (2, 2, 2, 3), (0, "c"): (1, 1, 2, 1), (5, "a"): (1, 1, 1, 1)} and len(got) == 4
    monkeypatch.setattr(I, "TOKENS", 0)
    monkeypatch.setattr(I, "SENT", 1)
    assert flat(r for b in I._inverted(pa.int64())(batches(1)) for r in b.to_pylist()) == flat(got)
