import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest

from docloom.llm import spm_sampling as S
from docloom.llm._text import mix

pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def v():
    return S.Vocabulary.load()


def brute(text, v):
    """All segmentations with their log-probabilities."""
    marked = S.MARK + text.replace(" ", S.MARK)
    weight = {v.pieces[i]: v.weights[i] for i in v.ids.tolist()}
    found = {}

    def go(at, ids, w):
        if at == len(marked):
            found[tuple(ids)] = w
            return
        if marked[at] not in weight:
            data = marked[at].encode()
            go(at + 1, ids + [v.byte_ids[b] for b in data], w + len(data) * v.byte_weight)
        for n in range(1, v.longest + 1):
            p = marked[at : at + n]
            if len(p) == n and p in weight:
                go(at + n, ids + [v.pieces.index(p)], w + weight[p])

    go(0, [], 0.0)
    z = math.log(sum(map(math.exp, found.values())))
    return {k: w - z for k, w in found.items()}


def test_samples_are_distinct_exact_and_drawn_by_probability(v):
    text, n = "the\nor😀", 6000
    every = brute(text, v)
    first, pairs = Counter(), Counter()
    for r in S.sample_texts([text] * n, mix(np.arange(n, dtype=np.uint64)), v, 3):
        ids = [tuple(s[0].tolist()) for s in r]
        assert len(set(ids)) == 3
        assert all(abs(every[i] - s[1]) < 1e-9 and 0 < s[3] <= 1 for i, s in zip(ids, r, strict=True))
        assert r[0][2] >= r[1][2] >= r[2][2]
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
    for i, w in every.items():
        p = math.exp(w)
        assert abs(first[i] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    (a, b), c = pairs.most_common(1)[0]
    p = math.exp(every[a]) * math.exp(every[b]) / (1 - math.exp(every[a]))  # without replacement
    assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_inclusion_scores_weigh_back_to_one(v):
    text, n, k = "the of", 4000, 4
    total = 0.0
    for r in S.sample_texts([text] * n, mix(np.arange(n, dtype=np.uint64) + np.uint64(7)), v, k):
        total += sum(math.exp(s[1]) / s[3] for s in r)
    assert abs(total / n - 1) < 0.05  # the threshold sampling estimator of the total probability


def test_few_segmentations_and_decoding(v):
    texts = ["", "a", " two  spaces\n\nlines\tand tabs é 中 😀 ", "x" * 3000]
    seeds = mix(np.arange(4, dtype=np.uint64))
    got = list(S.sample_texts(texts, seeds, v, 4))
    assert len(got[0]) == 1 and got[0][0][3] == 1.0 and len(got[1]) == len(brute("a", v))
    runs = next(iter(S.sample_texts(["a    b"], seeds[:1], v, 50)))
    every = brute("a    b", v)  # with pieces of several marks
    assert any(set(v.pieces[i]) == {S.MARK} and len(v.pieces[i]) > 1 for s in runs for i in s[0]) and all(abs(every[tuple(s[0].tolist())] - s[1]) < 1e-9 for s in runs)
    assert S.units(" " * 40) == [S.MARK * 16, S.MARK * 16, S.MARK * 9]
    for t, r in zip(texts, got, strict=True):
        assert all(S.decode(s[0].tolist(), v) == t for s in r)
        assert len({tuple(s[0].tolist()) for s in r}) == len(r)


def test_rows_do_not_depend_on_their_batch(v):
    texts = [f"some words number {i} and the rest" for i in range(40)]
    seeds = mix(np.arange(40, dtype=np.uint64))
    together = list(S.sample_texts(texts, seeds, v, 3))
    for i in (0, 17, 39):
        alone = next(iter(S.sample_texts([texts[i]], seeds[i : i + 1], v, 3)))
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in together[i]]


def test_table(frame):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, "the the"), (3, "the the"), (None, "the the")]
    out = S.with_samples(frame(rows), F.col("doc_id"), k=2).collect()
    assert len(out) == 5
    three = [[tuple(s["ids"]) for s in r["samples"]] for r in out if r["doc_id"] == 3]
    assert three[0] == three[1] and len(three[0]) == 2
    digest = S.with_samples(frame(rows), F.col("doc_id")).select("doc_id", "text", S.digest(S.Vocabulary.load())(F.col("samples")).alias("d")).collect()
    assert {r["d"]["n_samples"] for r in digest if r["doc_id"] in (1, 2)} == {1}
    for r in digest:
        assert r["d"]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert len(r["d"]["log_prob"]) == len(r["d"]["inclusion"]) == r["d"]["n_samples"] and all(0 < x <= 1 for x in r["d"]["inclusion"])
    assert S.with_samples(frame([]), F.col("doc_id")).count() == 0


def test_clashing_name(spark):
    from pyspark.sql import functions as F

    got = S.with_samples(spark.createDataFrame([(1, "some text", "old")], "doc_id long, text string, Samples string"), F.col("doc_id")).first()
    assert got["Samples_in"] == "old" and len(got["samples"]) == 2


def test_random_numbers_are_drawn_for_pieces_not_for_edges(v, monkeypatch):
    text, k, mixed = "some words of no other meaning in the end " * 200, 3, []
    monkeypatch.setattr(S, "mix", lambda h: (mixed.append(len(h)), mix(h))[1])
    found = next(iter(S.sample_texts([text], np.array([5], np.uint64), v, k)))
    assert len(found) == k
    assert sum(mixed) <= sum(len(s[0]) for s in found) + 4 * len(S.units(text)) + 100 * k


def test_all_segmentations_and_the_order_of_few_in_many(v):
    steep = S.Vocabulary.load(alpha=6.0)  # the likeliest has nearly all
    seeds = mix(np.array([3], np.uint64))
    for w in (v, steep):
        for text in ("the of", "a    b", "or\nan", "é 中"):
            every = brute(text, w)
            found = next(iter(S.sample_texts([text], seeds, w, len(every) + 1)))
            assert {tuple(s[0].tolist()) for s in found} == set(every) and len(found) == len(every)
            assert all(abs(every[tuple(s[0].tolist())] - s[1]) < 1e-8 and s[3] == 1.0 for s in found)
            few = next(iter(S.sample_texts([text], seeds, w, 2)))
            assert [s[0].tolist() for s in few] == [s[0].tolist() for s in found[:2]]
            kappa = found[2][2] if len(found) > 2 else -np.inf
            assert all(s[3] == pytest.approx(-math.expm1(-math.exp(s[1] - kappa)), abs=1e-12) for s in few)


def test_words_are_cut_by_place(v):
    import re

    rule = re.compile(f"{S.MARK}{{1,{S.MOST_MARKS}}}[^{S.MARK}\n]*|\n|[^{S.MARK}\n]+")
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice([" ", "  ", "\n", "a", "bc", S.MARK, " " * 15, " " * 17], rng.integers(12)).tolist()) for _ in range(500)]
    assert all(S.units(t) == rule.findall(S.MARK + t.replace(" ", S.MARK)) for t in texts)
    code, begins, at = S._codes(texts)
    which, number = S._distinct(code, at)
    words = [w for t in texts for w in S.units(t)]
    size = np.diff(np.append(at, len(code)))
    assert ["".join(map(chr, code[at[i] : at[i] + size[i]])) for i in which[number]] == words and len(which) == len(set(words))


def test_query_draws_more_than_its_first_two(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "some words of a text"), (2, None), (3, "the")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in S.op6_piece_sampling(spark, str(tmp_path)).collect()}
    assert {i: (r["n_samples"], r["n_drawn"]) for i, r in got.items()} == {1: (2, 8), 2: (1, 1), 3: (2, 8)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    two = S.with_samples(docs, F.col("doc_id")).select("doc_id", S.digest(S.Vocabulary.load())(F.col("samples")).alias("d")).select("doc_id", "d.*")
    for r in two.collect():
        q = got[r["doc_id"]]
        assert all(r[name] == q[name] for name in ("n_samples", "n_pieces", "ids_hash", "log_prob", "decoded_sha256")) and r["inclusion"] == pytest.approx(q["inclusion"])
        assert len(q["drawn_log_prob"]) == len(q["drawn_inclusion"]) == q["n_drawn"] and q["drawn_log_prob"][: q["n_samples"]] == q["log_prob"]
