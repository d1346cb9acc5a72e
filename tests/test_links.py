"""Addresses, accounts, member counts and contacts, on rows that must and must not meet."""

from pyspark.sql import functions as F

from docloom.operators import links


def test_url_join_keeps_rows_without_a_partner(spark):
    left = spark.createDataFrame([(1, "http://www.a.cz/x/?q=1"), (2, "https://a.cz/y"), (3, None)], "id int, url string")
    right = spark.createDataFrame([("https://m.a.cz/x?q=1#top", "v1"), (None, "v2")], "link string, vote string")
    assert {r.id: r.vote for r in links.url_join(left, right, "url", "link").collect()} == {1: "v1", 2: None, 3: None}


def test_accounts_are_one_on_twitter_and_x(spark):
    posts = spark.createDataFrame([(1, "https://x.com/Anna/status/5"), (2, "https://x.com/annabel/status/6")], "id int, post string")
    people = spark.createDataFrame([("Anna", "http://twitter.com/ANNA/")], "name string, profile string")
    assert {r.id: r.name for r in links.account_join(posts, people, "post", "profile").collect()} == {1: "Anna", 2: None}


def test_member_counts_against_the_heading(spark):
    units = spark.createDataFrame([(1, "## Klub (2)"), (2, "## Klub (2)"), (3, "## Klub"), (4, None)], "unit int, heading string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "unit int, name string")
    rows = links.member_counts(units, members, "unit", "heading")
    assert "name" not in rows.columns
    assert {r.unit: (r.n_members, r.stated, r.agrees) for r in rows.collect()} == {1: (2, 2, True), 2: (1, 2, False), 3: (0, None, False), 4: (0, None, False)}


def test_official_contacts(spark):
    rows = spark.createDataFrame([("a@urad.cz",), ("a@X.urad.cz",), ("a@neurad.cz",), ("urad.cz",), (None,)], "a string")
    assert [r[0] for r in rows.select(links.official_contact(F.col("a"), ["urad.cz"])).collect()] == [True, True, False, False, False]


def test_addresses_that_differ_in_what_they_name_stay_apart(spark):
    """Forum posts and topics, videos and votes, in the forms in which documents write them."""
    posts = [(i, f"https://forum.party.example/viewtopic.php?p={900000 + i}#p{900000 + i}") for i in range(400)]
    topics = [(400 + i, f"https://forum.party.example/viewtopic.php?f={i % 7}&amp;t={i}") for i in range(158)]
    videos = [(1000 + i, f"https://www.youtube.com/watch?v=id{i:03d}&ab_channel=party") for i in range(222)]
    votes = [(2000 + i, f"https://www.psp.cz/sqw/hlasy.sqw?G={i}&o=8") for i in range(100)]
    left = spark.createDataFrame([*posts, *topics, *videos, *votes, (9000, "neuvedeno"), (9001, ""), (9002, None)], "id int, url string")
    right = spark.createDataFrame(
        [(i, u.replace("www.", "m.").replace("&amp;", "&").split("#")[0]) for i, u in [*posts, *topics, *votes]]
        + [(1000 + i, f"https://youtu.be/id{i:03d}?si=x") for i in range(222)]
        + [(9000, "neuvedeno"), (9001, ""), (9002, None)],
        "other int, link string",
    )
    rows = links.url_join(left, right, "url", "link").collect()
    assert len(rows) == 883 and all(r.other == (None if r.id >= 9000 else r.id) for r in rows)
    shared = links.shared_addresses(left.withColumnRenamed("url", "address").withColumn("source", F.when(F.col("id") < 400, "forum").otherwise("rest")).unionByName(right.selectExpr("other AS id", "link AS address", "'other' AS source")), "address", "source")
    assert shared.count() == 880 and {(r.n_sources, r.n) for r in shared.collect()} == {(2, 2)}


def test_accounts_without_a_handle_meet_nobody(spark):
    posts = spark.createDataFrame([(1, "https://x.com/"), (2, "neuvedeno"), (3, "https://x.com/i/web"), (4, None)], "id int, post string")
    people = spark.createDataFrame([("a", "https://x.com"), ("b", ""), ("c", "https://x.com/i/web"), ("d", None)], "name string, profile string")
    assert [r.name for r in links.account_join(posts, people, "post", "profile").collect()] == [None] * 4
