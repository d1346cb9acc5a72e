import hashlib
import random

from docloom.llm import substring
from test_ngram_join import thue_morse


def brute(rows, least=50):
    """id -> (words, kept words), from all windows."""
    first = {}
    cut = {}
    for i, text in rows:
        w = (text or "").encode().split()
        cut.setdefault(i, []).append(w)
        if i is not None:
            for s in range(len(w) - least + 1):
                key = tuple(w[s : s + least])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in cut.items():
        for w in ws:
            gone = set()
            if i is not None:
                for s in range(len(w) - least + 1):
                    if first[tuple(w[s : s + least])] < i:
                        gone.update(range(s, s + least))
            out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def check(frame, rows):
    got = substring.remove_repeats(frame(rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_against_all_windows(frame, words):
    r = random.Random(3)
    a, b, c = words(60, 1), words(140, 2), words(49, 3)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "short text")]
    for i in range(4, 40):
        body = words(r.randrange(0, 80), i)
        for piece in r.sample([a, b, b[20:90], c, a[5:] + b[:30]], r.randrange(0, 4)):
            at = r.randrange(len(body) + 1)
            body[at:at] = piece
        rows.append((i, " \n".join(body)))
    rows += [(40, rows[10][1]), (41, rows[10][1]), (12, rows[12][1]), (13, rows[20][1]), (14, " ".join(b) + " same id"), (50, "x " * 300), (51, "x " * 120 + "y"), (52, " ".join(b + b)), (None, " ".join(b))]
    check(frame, rows)


def test_windows_that_differ_from_the_first_occurrence(frame, words):
    seed = words(12, 5)
    left, right = words(60, 6), words(60, 7)
    rows = [(1, " ".join(words(50, 8) + seed + words(50, 9))), (2, " ".join(left + seed + right)), (3, " ".join(left[10:] + seed + right[:40])), (4, " ".join(left[20:] + seed + words(50, 10)))]
    check(frame, rows)


def test_words_of_one_polynomial_hash_are_told_apart(frame, words):
    before, after = words(30, 1), words(30, 2)
    rows = []
    for size in (1024, 2048, 4096):
        rows += [(len(rows) + i, " ".join([*before, w, *after])) for i, w in enumerate(thue_morse(size))]
    rows += [(20, " ".join([*before, thue_morse(1024)[1], *after])), (21, " ".join(words(80, 3) + before[5:] + [thue_morse(1024)[0]] + after))]
    x, y = thue_morse(2048, ["left ", "right "])
    check(frame, [*rows, (30, x), (31, y)])


def test_rows_that_share_an_id(frame, words):
    p, q = words(70, 1), words(70, 2)
    rows = [(5, " ".join(p + words(9, 3))), (5, " ".join(q + words(9, 4))), (5, " ".join(p + q)), (5, " ".join(p + q)), (7, " ".join(words(4, 5) + q[3:] + p)), (7, " ".join(q)), (9, " ".join(p[:60])), (None, " ".join(p))]
    check(frame, rows)


def test_long_texts_ties_and_clashing_columns(spark, words):
    line = " ".join(words(12, 6))
    rows = [(1, (line + "\n") * 4000, "a", 1), (2, (line + " ") * 3000 + "end", "b", 2), (2, " ".join(words(30, 7)), "c", 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, kept string, N_Words int")
    got = substring.remove_repeats(table, carry=("kept", "N_Words")).collect()
    assert {r["kept_in"]: (r["n_words"], r["n_removed"], r["N_Words_in"]) for r in got} == {"a": (48000, 0, 1), "b": (36001, 36000, 2), "c": (30, 0, 3)}


def test_layout_and_other_columns(frame, words):
    p = words(55, 11)
    rows = [(1, "Head\n" + " ".join(p) + "\nTail"), (2, "  One\n\n" + "  ".join(p) + "\n Two \n")]
    got = {r["doc_id"]: r for r in substring.remove_repeats(frame(rows), carry=("lang", "n_chars"), keep_layout=True).collect()}
    assert got[1]["kept"] == rows[0][1] and got[2]["kept"] == "  One\n\nTwo \n" and got[2]["lang"] == "en"
    assert [(x["start"], x["end"]) for x in got[2]["removed"]] == [(1, 56)]


def test_empty_table(frame, spark):
    assert substring.remove_repeats(frame([])).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
