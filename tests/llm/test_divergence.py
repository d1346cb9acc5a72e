"""Divergence of sources against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest

from docloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs, top):
    fold = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = fold(text or "")
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs.keys() | {k for k, _ in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        groups = {s: c for (k, s), c in counts.items() if k == lang}
        whole = sum(groups.values(), Counter())

        def p(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, shares = p(whole), {s: p(c) for s, c in groups.items()}
        for s, c in groups.items():
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((q[t] - shares[s][t], t.encode()) for t in kept if c[t] and shares[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def sample(seed, n, sources):
    r = random.Random(seed)
    words = ["the", "The", "über", "été", "Zoë", "naïve", "日本", "x", "a1b", "don't", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(n):
        source = f"s{min(r.randrange(sources), r.randrange(sources))}"
        text = " ".join(r.choices(words, [1 + (hash((w, source)) % 5 if w < "m" else 3) for w in words], k=r.randrange(60)))
        rows.append((i, text, r.choice(["en", "en", "de", None]), r.choice([source] * 9 + [None])))
    return rows + rows[:20] + [(1000, None, "fr", "a"), (1001, "", "fr", "b"), (1002, "the", "it", "only"), (1003, "É" * 5000, "en", "s0")]


@pytest.mark.parametrize(("block", "seat_groups", "seats"), [(8192, 256, 8), (7, 2, 3), (16, 1, 1), (5, 3, 20)])
def test_equals_plain_python(spark, block, seat_groups, seats):
    rows = sample(block, 260, 11)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=8, top=6, block=block, seat_groups=seat_groups, seats=seats)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == brute(rows, 8, 6)


def test_every_pair_of_seats_meets_once():
    for seats in range(1, 12):
        met = Counter()
        for r in range(seats // 2 + 1):
            for seat in range(seats):
                if 2 * r <= seats and (r == 0 or 2 * r < seats or seat < r):
                    met[frozenset((seat, (seat - r) % seats))] += 1
        assert met == Counter({frozenset((a, b)): 1 for a in range(seats) for b in range(a, seats)})


def test_shares_are_exact_for_large_numbers():
    import numpy as np

    counts = np.array([0, 1, 7, 10**14, 9 * 10**14 - 5])
    got = divergence.share(counts, 9 * 10**14, 12345)
    assert got.tolist() == [1 + 10**9 * (int(c) + 5) // (9 * 10**14 + 5 * 12345) for c in counts]


def test_empty_table_and_clashing_columns(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a b", "en", "x", "n", 3, "t"), (2, "a c", "en", "y", "m", 4, "u")], "doc_id long, text string, lang string, source string, term string, n int, block string")
    assert {(r.source, r.item, r.value) for r in divergence.audit(rows, least_docs=2).filter("part = 'pair'").collect()} == {("x", "y", 0), ("y", "x", 0)}


def test_one_very_long_text(spark):
    rows = [(i, "aa bb", "en", "x") for i in range(30)] + [(99, "aa " * 400_000 + "cc", "en", "y")]
    got = {tuple(r)[1:] for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[1:] for r in brute(rows, 30, 50)}
