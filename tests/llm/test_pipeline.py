"""The pipeline's stages against plain Python on one corpus with planted cases."""

import random

import corpus_pipeline as cp

from docloom.llm import pii
from test_ngram_join import brute as near_brute
from test_quality import brute as metrics
from test_substring import brute as passages_brute


def corpus(words):
    r = random.Random(9)
    rows = [(0, None), (1, ""), (2, "too short")]
    shared = words(70, 500)
    for i in range(3, 30):
        body = words(r.randrange(40, 120), i)
        if i % 5 == 0:
            body[10:10] = shared
        if i % 7 == 0:
            body[5:5] = ["ann.lee@site.org", "or", "+1", "(555)", "555-0123"]
        rows.append((i, " ".join(body[:20]) + "\n" + " ".join(body[20:])))
    rows.append((40, rows[8][1]))  # an exact copy
    near = rows[9][1].split(" ")
    near[3] = "changed"
    rows.append((41, " ".join(near)))
    rows.append((42, " ".join(words(8, 77) * 20)))  # fails the repeat rule
    rows.append((8, rows[8][1]))  # a repeated row
    return rows


def test_stages(spark, frame, words):
    rows = corpus(words)
    docs = frame(rows)
    kept = cp.quality_rules(spark, docs, "").select(*cp.COLUMNS)
    good = lambda t: (m := metrics(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]
    expected = [(i, t) for i, t in rows if good(t)]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(expected)

    one = cp.near_duplicates(spark, frame(expected), "")
    classes = near_brute(expected)
    left = sorted({i: t for i, t in expected if classes[i][0] == i}.items())
    assert sorted((r["doc_id"], r["text"]) for r in one.collect()) == left
    assert 40 not in dict(left) and 41 not in dict(left)

    cut = cp.shared_passages(spark, frame(left), "").collect()
    want = {i: k for i, n, gone, k in passages_brute(left) if gone < n}
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in cut} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    texts = [(r["doc_id"], r["text"]) for r in cut]
    clean = {r["doc_id"]: r["text"] for r in cp.personal_data(spark, frame(texts), "").collect()}
    assert set(clean) == set(want) and any("[EMAIL]" in t for t in clean.values())
    assert not any(pii.base_spans(t) for t in clean.values())
    assert all(clean[i] == t for i, t in texts if "@" not in t)

    packed = cp.packed(spark, frame(sorted(clean.items())), "").collect()
    together = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        together[r["doc_id"]] = together.get(r["doc_id"], "") + r["text"]
    assert together == clean
    bins = {}
    for r in packed:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["n_words"] for r in b) <= b[0]["capacity"] for b in bins.values())


def test_stages_take_null_ids_and_empty_tables(spark, frame, words):
    rows = [(None, " ".join(words(40, 1))), (None, " ".join(words(40, 1))), (5, " ".join(words(40, 2)))]
    for table, n in ((frame(rows), 3), (frame([]), 0)):
        docs = table
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, "")
            assert docs.count() == n


def test_stages_take_shared_ids_extra_columns_long_texts_and_ties(spark, frame, words):
    from pyspark.sql import functions as F

    a, b = words(80, 1), words(80, 2)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:79] + ["z"])), (3, " ".join(words(30_000, 3))), (3, " ".join(words(30_000, 3)))]
    docs = frame(rows).withColumns({"kept": F.lit("x"), "text_hash": F.lit(1), "host": F.lit("h"), "found": F.lit(2), "bin_id": F.lit(3)})
    counts = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == list(cp.COLUMNS)
            docs = docs.withColumns({"kept": F.lit("x"), "class_id": F.lit(0), "n_words": F.lit(1), "redacted": F.lit("r"), "piece": F.lit(9)})
    assert counts == [5, 3, 3, 3, 6]  # both texts of id 1 stay; one near and one exact copy go; the long text makes four pieces
