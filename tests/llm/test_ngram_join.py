import random
from collections import Counter

import numpy as np

from docloom.llm import ngram_join as nj


def shingles(text, k=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_rows(rows, threshold=0.8):
    """(class id, links) of each row, told apart by their texts."""
    sets = [shingles(t) for _, t in rows]
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None and s:
            least[s] = min(least.get(s, i), i)
    nodes = list(least)
    root = list(range(len(nodes)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, a in enumerate(nodes):
        for y in range(x + 1, len(nodes)):
            common = len(a & nodes[y])
            if common >= threshold * (len(a) + len(nodes[y]) - common) - 1e-9:
                links[x] += 1
                links[y] += 1
                root[find(y)] = find(x)
    head = {}
    for x, a in enumerate(nodes):
        head[find(x)] = min(head.get(find(x), least[a]), least[a])
    at = {s: x for x, s in enumerate(nodes)}
    return [(None, 0) if i is None else (i, 0) if not s else (head[find(at[s])], links[at[s]]) for (i, _), s in zip(rows, sets, strict=True)]


def brute(rows, threshold=0.8):
    return {i: found for (i, _), found in zip(rows, brute_rows(rows, threshold), strict=True) if i is not None}


def thue_morse(size, first="ab"):
    """A word and its complement, which every polynomial hash modulo a power of two takes for one another."""
    bits = [i.bit_count() % 2 for i in range(size)]
    return "".join(first[b] for b in bits), "".join(first[1 - b] for b in bits)


def family(words, rows, base, n, edits, seed):
    r = random.Random(seed)
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))


def check(frame, rows, **more):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in nj.near_duplicates(frame(rows), **more).collect() if r["doc_id"] is not None}
    assert got == brute(rows)


def test_against_all_pairs(frame, words):
    rows = [(0, None), (1, ""), (2, "   "), (3, "one two"), (4, "one  two"), (5, "one two three")]
    for f in range(5):
        family(words, rows, words(40 + 60 * f, f), 12, 4 + f, f)
    rows += [(len(rows), rows[10][1]), (len(rows) + 1, rows[10][1] + "\n"), (len(rows) + 5, " ".join(words(200, 99)))]
    check(frame, rows)


def test_large_buckets_split_and_fall_back_to_blocks(frame, words):
    rows = []
    passage = words(30, 1)
    for i in range(60):  # a passage that all share makes large buckets
        rows.append((i, " ".join(words(30, 100 + i) + passage)))
    family(words, rows, words(120, 2), 60, 5, 3)
    check(frame, rows, bucket=8, max_depth=1)


def test_edges(frame):
    got = nj.near_duplicates(frame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "a b c d e f")])).collect()
    by = sorted((str(r["doc_id"]), r["class_id"], r["n_links"], r["n_copies"]) for r in got)
    assert by == [("7", 7, 0, 2), ("7", 7, 0, 2), ("9", 7, 0, 2), ("None", None, 0, 0)]
    assert nj.near_duplicates(frame([])).count() == 0


def test_rows_that_share_an_id_keep_their_own_texts_classes(frame, words):
    a, b = words(60, 1), words(60, 2)
    near = lambda w: " ".join([*w[:58], "x", "y"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(words(60, 3))), (None, " ".join(a))]
    got = nj.near_duplicates(frame(rows), with_hash=True).collect()
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_rows(rows), strict=True))
    assert sorted(((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in got), key=str) == sorted(want, key=str)
    assert len({r["class_hash"] for r in got if r["class_id"] == 1}) == 2  # two classes whose least ids are equal


def test_words_of_one_polynomial_hash_are_told_apart(frame):
    rows = []
    for size in (1024, 2048, 4096):
        rows += [(len(rows) + i, f"a b c d {w}") for i, w in enumerate(thue_morse(size))]
    x, y = thue_morse(2048, ["left ", "right "])  # the same with words for letters
    rows += [(len(rows), x), (len(rows) + 1, y), (len(rows) + 2, "left right " * 1024)]
    check(frame, rows)


def test_columns_of_other_names_do_not_matter(spark):
    rows = [(1, "a b c d e f", 5, "x", 1), (2, "a b c d e f", 6, "y", 2)]
    got = nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id int, _text string, n_links int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 1), (2, 1, 0, 1)]


def test_common_counts_by_both_ways():
    r = random.Random(1)
    lists = [np.array(sorted(r.sample(range(60), r.randrange(0, 25))), np.int64) for _ in range(70)]
    got = nj.common(lists)
    assert all(got[i, j] == len(set(lists[i]) & set(lists[j])) for i in range(70) for j in range(70))


def test_runs_reach_the_recall():
    assert nj.runs_for(0.9999, 0.8, 4.0) == 3 and nj.runs_for(0.9, 0.8, 4.0) == 1


def kept_through(splits, runs, pairs, deeper=2.0):
    """Of pairs at 0.8, one set inside the other, how many share a path through so many splits in one of the runs."""
    kept = 0
    for i in range(pairs):
        w = [f"p{i}w{j}" for j in range(254)]
        both = [nj.describe(" ".join(x).encode(), 5, runs, 4.0) for x in (w, w[:204])]
        a, b = (set(np.concatenate(d[4]).tolist()) for d in both)
        paths = a & b
        for _ in range(splits):
            further = set()
            for p in paths:
                salt = nj.mix(np.array([p], np.uint64) ^ nj._RUN)[0]
                x, y = (nj._picks(np.frombuffer(d[3], np.uint32), salt, deeper / nj.SAMPLE) for d in both)
                further |= set(x.tolist()) & set(y.tolist())
            paths = further
        kept += bool(paths)
    return kept


def test_recall_holds_through_splits():
    runs = [nj.runs_through(s, 0.9999, 0.8, 4.0, 2.0) for s in range(7)]
    assert runs[0] == 3 and all(nj.lost(r, 0.8, 4.0, 2.0, s) < 1e-4 for s, r in enumerate(runs))
    assert kept_through(3, 3, 1500) < 1500  # the first runs alone part some
    assert kept_through(3, runs[3], 1500) == 1500 and kept_through(6, runs[6], 300) == 300


def test_sets_of_split_buckets_meet_in_further_runs(frame, words):
    rows = []
    for f in range(6):  # texts that hold most of a pair's passage, but are not near it
        base = words(120, f)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + words(27, 50 + f)))]
        rows += [(len(rows) + i, " ".join(base[:84] + words(36, 100 + 10 * f + i))) for i in range(6)]
    check(frame, rows, bucket=2, max_depth=3)
