from datetime import date, datetime

from pyspark.sql import functions as F

from docloom.operators import digest, mentions, month_pages

ITEMS = "id long, ts timestamp, title string, medium string, url string, people array<string>, authority string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def test_days_come_back_from_the_last_with_their_items(spark):
    rows = [
        (1, datetime(2014, 1, 21, 5), "Levné knihy", "Lupa", "u1", ["J. H."], "externi-media"),
        (2, datetime(2014, 1, 26, 7), "Děti", "Respekt", "u2", [], "externi-media"),
        (3, datetime(2014, 1, 21, 5), "Druhý", None, None, None, "externi-media"),
        (4, datetime(2014, 1, 21, 4), "První", "M", "u4", ["B", "A"], "externi-media"),
        (5, datetime(2014, 2, 1), "Jinde", "M", "u5", None, None),
        (6, None, "Bez času", "M", "u6", None, "externi-media"),
    ]
    got = [r["text"] for r in month_pages.lines(items(spark, rows)).filter("month = '2014-01-01'").orderBy("line").collect()]
    assert got == ["### 26. 1. 2014", "- **Děti** (Respekt) [odkaz](u2)", "### 21. 1. 2014", "- **První** (M) [odkaz](u4) · zmíněni: B, A", "- **Levné knihy** (Lupa) [odkaz](u1) · zmíněni: J. H.", "- **Druhý** () [odkaz]()"]
    heads = {r["month"]: (r["n"], r["latest"], r["days"], r["note"]) for r in month_pages.heads(items(spark, rows)).collect()}
    assert heads == {date(2014, 1, 1): (4, date(2014, 1, 26), 2, month_pages.NOTES["externi-media"]), date(2014, 2, 1): (1, date(2014, 2, 1), 1, None)}
    assert month_pages.lines(items(spark, [])).count() == 0 and month_pages.heads(items(spark, [])).count() == 0


def test_numbers_of_a_hot_group_equal_one_sort(spark):
    rows = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.col("id") * 37 % 11).alias("a"), (F.col("id") * 101 % 3001).alias("b"), "id")
    got = month_pages.numbered(rows, ["k"], [F.col("a")], [F.asc("b"), F.asc("id")], "n").collect()
    for k in (0, 1):
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["n"])
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda r: (r["a"], r["b"], r["id"]))


def test_pages_are_written_in_order(spark, tmp_path):
    rows = [(i, datetime(2014, 1 + i % 2, 1 + i % 28, i % 24), f"t{i}", "m", "u", None, "web") for i in range(200)]
    made = month_pages.lines(items(spark, rows))
    month_pages.write_pages(made, str(tmp_path / "p"))
    for month in ("2014-01", "2014-02"):
        files = sorted((tmp_path / "p" / f"page={month}" / "authority=web").glob("*.txt"))
        text = [line for f in files for line in f.read_text().splitlines()]
        assert text == [r["text"] for r in made.filter(F.date_format("month", "yyyy-MM") == month).orderBy("line").collect()] and len(text) > 100


def test_people_by_first_place(spark):
    docs = spark.createDataFrame([(1, "Eva a Jan Malý. Potom Adam, Eva."), (2, None), (3, "nikdo"), (4, "adam adam jan maly")], "doc_id long, text string")
    names = spark.createDataFrame([("Jan Malý", "Jan Malý"), ("Adam", "Adam"), ("Eva", "Eva"), ("Jan", "Jan"), (None, "a")], "entity string, name string")
    found = mentions.mention_join(docs, names, places=True)
    assert {tuple(r) for r in found.filter("doc_id = 1").collect()} == {(1, "Eva", 2, 1), (1, "Jan", 1, 3), (1, "Jan Malý", 1, 3), (1, "Adam", 1, 6)}
    assert {r["doc_id"]: r["people"] for r in mentions.in_order(found).collect()} == {1: ["Eva", "Jan", "Jan Malý", "Adam"], 4: ["Adam", "Jan", "Jan Malý"]}
    small = mentions.mention_join(docs, names, most_bytes=150, places=True)  # several parts
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, found.collect()))


def test_what_is_no_result(spark):
    verbs = ("prosadil", "schvalil")
    rows = [
        ("Prosadili jsme zákon.", "A", None),
        ("Slibujeme, že jsme to prosadili", "A", "promise"),
        ("Plánujeme změny. Prosadili jsme jinou.", None, None),
        ("Podpořili jsme návrh", "A", "support"),
        ("Prosadil to soused", "B", "other party"),
        ("Nic nového", "A", "none"),
        (None, "A", "none"),
        ("", None, "none"),
    ]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, o string, e string").select("i", digest.result_rule(F.col("t"), verbs, F.col("o"), ("A",)).alias("rule"), "e").orderBy("i").collect()
    assert [r["rule"] for r in got] == [r["e"] for r in got]
    releases = spark.createDataFrame([("u", "Prosadili", "x", "A"), ("v", "Prosadili", "x", "B"), ("w", "Prosadili", "x", None)], "zdroj string, nazev string, body string, strana string")
    votes = spark.createDataFrame([], "zdroj string, nazev string, vysledek string, ano int, total int")
    assert sorted(r["zdroj"] for r in digest.result_proposals(releases, votes, verbs, ("A",)).collect()) == ["u", "w"]
