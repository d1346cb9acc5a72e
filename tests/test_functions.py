import pytest
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions import text as T


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


CASES = [
    (lambda x: T.fold(x), "Dostupné BYDLENÍ", "dostupne bydleni"),
    (lambda x: F.array_join(T.tokens(x), "|"), "Žluť, kůň-2!", "zlut|kun|2"),
    (lambda x: F.array_join(T.tokens(x), "|"), None, ""),
    (lambda x: T.stem(x), "bydlenim", "bydlen"),
    (lambda x: T.slug(x), "Schůzka: k návrhu č. 5 / 2019", "schuzka-k-navrhu-c-5-2019"),
    (lambda x: T.slug(x, 10), "Ááá bbb ccc ddd", "aaa-bbb-cc"),
    (lambda x: T.web_slug(x), "a" * 101, "a" * 92 + "-" + __import__("hashlib").sha1(b"a" * 101).hexdigest()[:7]),
    (lambda x: T.sentinel_to_null(x), " neuvedeno ", None),
    (lambda x: T.blank_to_null(x), "  ", None),
    (lambda x: T.account_handle(x), "https://twitter.com/Some_One?s=20", "x.com/some_one"),
    (lambda x: T.fold(x), "Łódź Straße ŒUVRE", "lodz strasse oeuvre"),
    (lambda x: F.array_join(T.tokens(x), "|"), "ve\u030cc Ве\u0301ра 5", "vec|вера|5"),
    (lambda x: T.canonical_url(x), "http://www.Example.org/a//b/?q=1#f", "https://example.org/a/b?q=1"),
    (lambda x: T.canonical_url(x), "https://example.org/?b=2&utm_source=x&a=1&a=1&fbclid=9", "https://example.org?a=1&b=2"),
    (lambda x: T.canonical_url(x), "https://youtu.be/X5c_-Rp8?si=abc", "https://youtube.com/watch?v=X5c_-Rp8"),
    (lambda x: T.canonical_url(x), "https://m.youtube.com/watch?t=3&v=X5c_-Rp8", "https://youtube.com/watch?v=X5c_-Rp8"),
    (lambda x: T.canonical_url(x), "https://x.com/a/status/5?t=q&amp;s=20", "https://x.com/a/status/5"),
    (lambda x: T.canonical_url(x), "neuvedeno", None),
    (lambda x: T.canonical_url(x), "", None),
    (lambda x: T.account_handle(x), "https://x.com/", None),
    (lambda x: T.account_handle(x), "neuvedeno", None),
    (lambda x: T.account_handle(x), "https://x.com/i/status/5", None),
    (lambda x: T.account_handle(x), "https://bsky.app/profile/Ann.bsky.social", "bsky.app/ann.bsky.social"),
    (lambda x: T.account_handle(x), "https://www.facebook.com/profile.php?id=12", "facebook.com/profile.php?id=12"),
    (lambda x: dates.from_czech_date(x).cast("string"), "31. 2. 2020", None),
    (lambda x: dates.from_czech_date(x).cast("string"), "dne 5.6.2021", "2021-06-05"),
    (lambda x: T.money(x).cast("string"), "123456789012345678901 Kč", "123456789012345678901.00"),
    (lambda x: T.engagement(x)["likes"], "12345678901 lajků, 3 repostů, 0 odpovědí", 12345678901),
    (lambda x: T.url_param(x, "v"), "https://y.example/watch?t=1&v=abc_DEF-123", "abc_DEF-123"),
    (lambda x: F.array_join(T.markdown_links(x), " "), "[a](http://x) [](…) [b]() [c](/d)", "http://x … /d"),
    (lambda x: F.array_join(T.mentions(x), " "), "hi @ann and a@b.cz (@bob)", "ann bob"),
    (lambda x: F.array_join(T.hashtags(x), " "), "#one x#two #three_3", "one three_3"),
    (lambda x: T.engagement(x)["reposts"], "12 lajků, 3 repostů, 0 odpovědí", 3),
    (lambda x: T.tally(x)["proti"], "přijato (pro 35, proti 2, zdrželo se 1, nehlasovalo 0, přítomno 38)", 2),
    (lambda x: T.tally(x)["pro"], "nothing", None),
    (lambda x: T.block_quote(x), "a\n> b\n>c\nd", "b\nc"),
    (lambda x: F.array_join(T.statutes(x), " "), "zákon č. 111/1994 Sb. a 5/2000 Sb.", "111/1994 5/2000"),
    (lambda x: T.money(x).cast("string"), "1 234 567,50 Kč", "1234567.50"),
    (lambda x: T.money(x).cast("string"), "dohodou", None),
    (lambda x: T.extension(x), "a/b.tar.GZ", ".gz"),
    (lambda x: T.extension(x), "a/.hidden", ""),
    (lambda x: T.vote_value(x), "@", "nepritomen"),
    (lambda x: T.vote_value(x), "?", None),
    (lambda x: T.clean_html(x), "<p>a &amp;lt; b</p><script>x<y</script> c", "a &lt; b c"),
    (lambda x: T.clean_html(x), '<p title="x>y" data-a=\'<b>\'>one</p><br/>two', "one two"),
    (lambda x: T.clean_html(x), "a < b and 3<4 <!-- <p> --> c <unclosed", "a < b and 3<4 c <unclosed"),
    (lambda x: T.clean_html(x), '<a href="x>open quote</a> end', "open quote end"),
    (lambda x: T.clean_html(x), "&eacute;&#233;&#xE9;&#x1F600; &bogus; &amp;amp; &#0; &#xD800; &nbsp;&apos;R&D", "ééé😀 &bogus; &amp; \ufffd \ufffd 'R&D"),
    (lambda x: T.clean_html(x), "<p " + "a='1' " * 5000 + ">x", "x"),
    (lambda x: F.array_join(T.markdown_links(x), " "), "[![img](a.png)](b) [x](c_(d)) [y](<e f> \"t\") `[no](code)` [z](g 'h')", "b c_(d) e f g"),
    (lambda x: F.array_join(T.markdown_links(x), " "), "```\n[no](fence)\n```\n[yes](ok)", "ok"),
    (lambda x: T.shorten(x, 3), "abcd", "abc…"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_text(spark, i):
    function, given, expected = CASES[i]
    row = spark.createDataFrame([(given,)], "x string")
    assert row.select(function(F.col("x")).alias("v")).first()["v"] == expected


def test_sections_pairs_and_tables(spark):
    body = "intro\n\n## One\n- Key: a: b\n- no pair\n## Two\n| H1 | H2 |\n|---|---|\n| 1 | x |\n| 2 |"
    row = spark.createDataFrame([(body,)], "x string").select(T.sections(F.col("x")).alias("s"), T.key_values(F.col("x")).alias("k"), T.table_maps(F.col("x")).alias("t")).first()
    assert [(s["heading"], s["text"][:5]) for s in row["s"]] == [("", "intro"), ("One", "- Key"), ("Two", "| H1 ")]
    assert [tuple(p) for p in row["k"]] == [("Key", "a: b")]
    assert row["t"] == [{"H1": "1", "H2": "x"}, {"H1": "2", "H2": None}]


def test_dates(spark):
    row = spark.sql("SELECT date '2026-11-15' d, timestamp_ntz '2014-01-02 00:00:00' t, 36025 a, 259 b, '2019-02-03T10:00:00+01:00' o")
    got = row.select(dates.czech_date("d"), dates.iso_week(F.col("d")), dates.month_title("Články", F.col("t")), dates.duration(F.col("a")), dates.duration(F.col("b")), dates.to_utc(F.col("o")).cast("string"), dates.from_czech_date(F.lit("dne 9. 1. 2020 v")).cast("string"), dates.recent(F.col("d"), F.lit("2026-11-28").cast("date"))).first()
    assert tuple(got) == ("15. 11. 2026", "2026-T46", "Články, leden 2014", "10:00:25", "04:19", "2019-02-03 09:00:00", "2020-01-09", True)


def test_empty_list_becomes_the_sentinel(spark):
    row = spark.sql("SELECT array() a, array('x', 'y') b, cast(null as array<string>) c").select(T.listed(F.col("a").cast("array<string>")), T.listed(F.col("b")), T.listed(F.col("c"))).first()
    assert tuple(row) == ("neuvedeno", "x, y", "neuvedeno")


BAD = [None, "", " ", "neuvedeno", "slova bez čísel", "9" * 30, "9" * 30 + " lajků, 1 repostů, 2 odpovědí (pro " + "9" * 30 + ")", "31. 2. 2020", "99. 99. 9999", "2020-13-45T99:99", "| A | A |\n|---|---|\n| 1 | 2 |", "\u0000<p title=\"x>y\">", "https://", "[](", "🙂" * 3]


def test_no_function_fails_on_bad_values(spark):
    rows = spark.createDataFrame([(b,) for b in BAD], "x string")
    x = F.col("x")
    scalar = [f(x) for f in (T.fold, T.tokens, T.stem, T.slug, T.web_slug, T.blank_to_null, T.sentinel_to_null, T.status, T.url_host, T.url_path, T.url_segment, T.canonical_url, T.account_handle, T.markdown_links, T.autolinks, T.hashtags, T.mentions, T.engagement, T.tally, T.sections, T.key_values, T.block_quote, T.statutes, T.money, T.vote_value, T.extension, T.table_rows, T.table_maps, T.clean_html, dates.from_czech_date, dates.to_utc)]
    got = rows.select("x", *[c.alias(f"c{i}") for i, c in enumerate(scalar)]).collect()
    assert len(got) == len(BAD)
    table = rows.filter(x.startswith("|")).select(T.table_maps(x).alias("t")).first()["t"]
    assert table == [{"A": "1", "A (2)": "2"}]
