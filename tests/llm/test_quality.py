from pyspark.sql import functions as F

from docloom.llm import _join, quality


def brute(text):
    text = text or ""
    w = text.encode().split()
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {x: windows.count(x) for x in set(windows)}
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_metrics_against_plain_python(frame, words):
    eight = " ".join(words(8, 1))
    texts = [None, "", " \n \x0b", "a", "#*$ <é> |\nb\nb \nb\n", f"{eight} x {eight}", f"{eight} {eight} {eight}", "q " * 300, "x\x1cy z", " ".join(words(500, 2)) + "\n" + " ".join(words(500, 2)[:90]), "čě " * 12]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = quality.judge(frame(rows), F.col("source")).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got} == {i: brute(t) for i, t in rows}
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)


def test_bad_hosts_fall_and_small_hosts_stay(frame, words):
    good = lambda i: " ".join(words(40, i))
    rows = [(i, good(i), "fine") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(57)] + [(200 + i, good(200 + i), "bad") for i in range(3)]
    rows += [(300, "too short", "tiny"), (301, good(301), "tiny"), (302, good(302), None), (303, "short", None)]
    got = {r["doc_id"]: r for r in quality.judge(frame(rows), F.col("source")).collect()}
    assert not got[200]["kept"] and not got[200]["base_failed"]
    assert got[301]["kept"] and got[302]["kept"] and not got[303]["kept"] and got[0]["kept"]
    assert got[302]["host_rate"] is None


def test_empty_table_and_one_host(frame, words):
    assert quality.judge(frame([]), F.col("source")).count() == 0
    same = quality.judge(frame([(1, " ".join(words(30, 1))), (1, " ".join(words(30, 1)))]), F.col("source")).collect()
    assert [r["kept"] for r in same] == [True, True]


def test_clashing_names_and_long_texts(spark, words):
    text = " ".join(words(20_000, 4)) + "\n" + "again " * 9
    rows = [(1, text, "a", 5, "h"), (2, "", "b", 6, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, host string, n_words int, Kept string")
    got = {r["doc_id"]: r for r in quality.judge(table, F.col("host"), keep=("doc_id", "host", "n_words", "Kept", "text")).collect()}
    assert (got[1]["host"], got[1]["n_words_in"], got[1]["Kept_in"], got[1]["n_words"], got[1]["text"]) == ("a", 5, "h", 20_009, text)
    assert (got[2]["host"], got[2]["n_words_in"], got[2]["Kept_in"], got[2]["kept"]) == ("b", 6, None, False)


def test_facts_are_attached_alike_by_each_way(spark):
    rows = spark.range(6000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('k', id % 2000) end as key")
    facts = rows.filter("key is not null").groupBy("key").count().selectExpr("key", "count as n", "count * 7 as fact")
    small, large = (_join.attach(rows, facts, "key", "n", most_bytes=m) for m in (1 << 30, 0))
    look = lambda df: sorted((r["id"], r["key"], r["fact"]) for r in df.select("id", "key", "fact").collect())
    assert look(small) == look(large) == look(rows.join(facts, "key", "left"))
