"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from docloom.llm import variants

LETTERS = "abcdeé"


def cut(doc, text, divisor):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text):
        run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
        h = zlib.crc32(f"{doc}:{run}".encode())
        yield run[: h % len(run)] + run[h % len(run) + 1 :] if h % divisor == 0 else run


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows, divisor=199, least=6):
    n = Counter(w for doc, text in rows for w in cut("null" if doc is None else doc, text or "", divisor) if len(w) >= least)
    words = {w: c for w, c in n.items() if c >= 5}
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(close[w]), words[form[w]] if form[w] else None) for w in words}


def some(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choices(LETTERS, k=r.randrange(6, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(80)):
            w = base[min(r.randrange(60), r.randrange(60), r.randrange(60))]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(LETTERS) + w[at:], w[:at] + r.choice(LETTERS) + w[at + 1 :], w[::-1]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", ", ", "1", "ł", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("divisor", [199, 3])
def test_equals_plain_python(spark, divisor):
    rows = some(divisor, 150)
    rows += rows[:5] + [(None, "abcdef " * 7), (900, None), (901, ""), (902, "÷×÷×÷×÷ " * 6)]
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), divisor=divisor)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, got.collect()))
    want = brute(rows, divisor)
    assert len(got) == len(want) > 100 and set(got) == want
    assert sum(r[1] is not None for r in got) > 5


def test_all_single_changes_are_near_and_anagrams_are_not(spark):
    """Each place and kind of change, at odd and even lengths, repeated letters too."""
    words = set()
    for w in ("abcabd", "aaaaaaa", "éabcdé", "abcdefgh"):
        words |= {w, w[::-1], w[1:] + w[0]}
        for i in range(len(w) + 1):
            words |= {w[:i] + c + w[i:] for c in "aéz"}
            words |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :], w[:i] + "b" + w[i + 1 :]}
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = [(r.word, r.near) for r in variants.near_pairs(table).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_chains_of_forms(spark):
    """Counts that grow fivefold along a chain of six words, one letter apart."""
    chain = ["zaaaaaaaa", "zbaaaaaaa", "zbbaaaaaa", "zbbbaaaaa", "zbbbbaaaa", "zbbbbbaaa"]
    rows = [(i, " ".join([w] * 5 ** (i + 1))) for i, w in enumerate(chain)]
    got = {r.word: (r.form, r.root) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), divisor=10**12).collect()}
    assert got == {w: (chain[i + 1] if i < 5 else None, chain[-1]) for i, w in enumerate(chain)}


def test_empty_table_ties_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(empty).count() == 0
    rows = spark.createDataFrame([("x", "abcdef " * 5 + "abcdeg " * 30 + "abcdeh " * 30, "w", 1)], "doc_id string, text string, word string, n int")
    got = {r.word: (r.form, r.n_near) for r in variants.variants(rows, divisor=10**12).collect()}
    assert got == {"abcdef": ("abcdeg", 2), "abcdeg": (None, 2), "abcdeh": (None, 2)}


def test_very_long_runs_and_texts(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} {long} {long} {long} {long} {long}x {long}x {long}x {long}x {long}x"), (2, "tokens " * 300_000)]
    got = {r.word: (r.n, r.n_near) for r in variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), divisor=10**12).collect()}
    assert got == {long: (5, 1), long + "x": (5, 1), "tokens": (300_000, 0)}


def test_no_join_is_broadcast_by_the_size_of_a_small_file(spark, tmp_path):
    """A file of words is far smaller than its rows taken apart, and those would pass the driver."""
    words = [f"word{i}" for i in range(50)]
    spark.createDataFrame([(w, 5) for w in words], "word string, n long").write.parquet(f"{tmp_path}/words")
    pairs = variants.near_pairs(spark.read.parquet(f"{tmp_path}/words"))
    assert "SortMergeJoin" in (plan := pairs._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
    assert {(r.word, r.near) for r in pairs.collect()} == {(a, b) for a in words for b in words if near(a, b)}
