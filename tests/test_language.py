"""Languages by ranks of n-grams against plain Python."""

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import language as L

TEXTS = [
    ("cs", "Rada bere na vědomí zprávu o stavu veřejné dopravy ve městě a ukládá odboru připravit návrh opatření do konce roku."),
    ("cs", "Poslanci hlasovali o novele zákona, která upravuje přístup občanů k informacím a otevřeným datům."),
    ("en", "The committee discussed the proposal and asked for a report on public transport before the end of the year."),
    ("en", "Members voted on the amendment which would give citizens better access to information and open data."),
]


def test_texts_and_mixes(spark):
    known = L.profiles(spark.createDataFrame(TEXTS, "lang string, text string")).cache()
    counts = {lang: sum((L.ngrams(t) for k, t in TEXTS if k == lang), Counter()) for lang in ("cs", "en")}
    assert {(r["lang"], r["gram"], r["rank"]) for r in known.collect()} == {(k, g, i) for k, c in counts.items() for i, g in enumerate(L.ranked(c))}
    rows = [(1, "Odbor dopravy připravil zprávu o stavu města."), (2, "The report on open data was discussed."), (3, TEXTS[0][1] + "\n\n" + TEXTS[2][1] + " " + TEXTS[3][1]), (4, None), (5, "123 !?"), (6, "ano")]
    got = {r["doc_id"]: r for r in L.metadata_only(L.languages(spark.createDataFrame(rows, "doc_id long, text string"), known), "cs").collect()}
    assert [got[i]["language"] for i in range(1, 6)] == ["cs", "en", "en", None, None]
    assert [m["lang"] for m in got[3]["mix"]] == ["en", "cs"] and sum(m["letters"] for m in got[3]["mix"]) == got[3]["letters"]
    assert [got[i]["metadata_only"] for i in range(1, 6)] == [False, True, True, True, True] and got[6]["short"] and got[4]["mix"] == []
    none = L.languages(spark.createDataFrame(rows, "doc_id long, text string"), known.limit(0))
    assert {r["language"] for r in none.collect()} == {None}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_agreement_with_the_labels_of_other_documents(spark):
    """Profiles from half of the documents, judged on the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 200")
    found = L.languages(docs.filter("doc_id % 2 = 1"), L.profiles(docs.filter("doc_id % 2 = 0")))
    share = found.join(docs, "doc_id").agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.95


def plain(text, known):
    """(language, distance, letters) from the definition."""
    counts = L.ngrams(text)
    own = L.ranked(counts)
    letters = sum(n for g, n in counts.items() if len(g) == 1)
    far = [(sum(abs(i - p[g]) if g in p else L.MOST for i, g in enumerate(own)), lang) for lang, p in known.items()]
    return (min(far)[1], min(far)[0], letters) if own else (None, None, letters)


def test_many_texts_at_once_equal_plain_counts(spark, monkeypatch):
    """Words in tokens with other signs, ties, letters beyond the first plane, texts far longer than their neighbours."""
    monkeypatch.setattr(L, "CHARS", 500)
    r = random.Random(3)
    letters = "aábc ,d.1²½_\n😀𝒜İΣß'-́ ⅷ"
    texts = ["".join(r.choices(letters, [8] * 4 + [9] + [1] * (len(letters) - 5), k=r.choice((1, 5, 60, 900)))) for _ in range(120)] + [None, "", "b b\n\nb a"]
    rows = [(i, t, r.choice(("x", "y", None))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {lang: {g: i for i, g in enumerate(L.ranked(sum((L.ngrams(t) for _, t, k in rows if k == lang and t), Counter())))} for lang in ("x", "y")}
    found = L.profiles(docs)
    assert {(p["lang"], p["gram"], p["rank"]) for p in found.collect()} == {(k, g, i) for k, p in known.items() for g, i in p.items()}
    got = L.languages(docs, found, keep=["lang"]).collect()
    assert {(g["doc_id"], g["lang"]) for g in got} == {(i, k) for i, _, k in rows} and len(got) == len(rows)
    for g in got:
        assert (g["language"], g["distance"], g["letters"]) == plain(texts[g["doc_id"]] or "", known)


def test_each_different_word_is_cut_once(monkeypatch):
    """The work follows the different words of many texts, not their sum."""
    cut, whole = [], L._cut
    monkeypatch.setattr(L, "_cut", lambda words: cut.extend(words) or whole(words))
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 50, "text": ["one two, two"] * 50})
    assert sum(sum(b.column("n").to_pylist()) for b in L._counted(iter([batch]))) == 50 * (L.ngrams("one two two").total())
    assert sorted(cut) == ["one", "two"]
    assert L.judged([{"one": 1, "two": 2}] * 50, {"x": {"o": 0}})[49] == plain("one two two", {"x": {"o": 0}}) and len(cut) == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_agreement_joins_nothing(spark):
    """The label goes with the text; the documents are not met a second time."""
    from docloom.plans import QUERIES

    plan = QUERIES["language_agreement"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
