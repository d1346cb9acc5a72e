"""Queries on people, units, accounts and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import intervals, links
from ._base import Registry, table
from .texts import _CANONICAL, canonical_sql

q = Registry()


@q(
    """
WITH s AS (SELECT user_id, week, club, lead(week) OVER (PARTITION BY user_id ORDER BY week) AS until FROM (
  SELECT user_id, date_trunc('week', ts) AS week, min(event_type) AS club FROM events GROUP BY 1, 2))
SELECT e.event_id, e.user_id, s.club FROM events e LEFT JOIN s ON s.user_id = e.user_id AND e.ts >= s.week AND (s.until IS NULL OR e.ts < s.until)"""
)
def club_at_vote(spark, d):
    e = table(spark, d, "events")
    spells = e.groupBy("user_id", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("since")).agg(F.min("event_type").alias("club"))
    covered = intervals.holder_join(e, intervals.valid_until(spells, ["user_id"], "since"), "user_id", F.col("ts"))
    return covered.select("event_id", "user_id", "club")


_SPELLS = "SELECT user_id, event_type, min(ts) AS since, max(ts) AS until FROM events GROUP BY 1, 2"


def _spells(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))


@q(f"WITH s AS ({_SPELLS}) SELECT a.user_id, a.event_type, b.event_type AS other_event_type FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.since < b.until AND b.since < a.until AND a.since < a.until AND b.since < b.until")
def overlapping_spells(spark, d):
    s = _spells(spark, d)
    return intervals.overlap_join(s, s, "user_id").filter("event_type < other_event_type").select("user_id", "event_type", "other_event_type")


@q(f"WITH s AS ({_SPELLS}) SELECT e.event_id, s.event_type FROM (SELECT event_id, user_id % 3 AS hot, ts FROM events) e LEFT JOIN (SELECT *, user_id % 3 AS hot FROM s WHERE user_id < 6) s ON s.hot = e.hot AND e.ts >= s.since AND e.ts < s.until")
def holders_of_hot_offices(spark, d):
    """Three offices that have all facts and many holders at a time."""
    facts = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("hot"), "ts")
    spells = _spells(spark, d).filter("user_id < 6").select((F.col("user_id") % 3).alias("hot"), "event_type", "since", "until")
    return intervals.bucketed_holder_join(facts, spells, "hot", F.col("ts")).select("event_id", "event_type")


@q(f"SELECT p.page_id, v.vote FROM pages p LEFT JOIN (SELECT {_CANONICAL} AS c, min(page_id) AS vote FROM pages WHERE url LIKE 'https:%' GROUP BY 1) v ON v.c = {canonical_sql('p.url')}")
def supporting_votes(spark, d):
    pages = table(spark, d, "pages")
    votes = pages.filter("url like 'https:%'").groupBy(T.canonical_url(F.col("url")).alias("vote_url")).agg(F.min("page_id").alias("vote"))
    return links.url_join(pages.select("page_id", "url"), votes, "url", "vote_url").select("page_id", "vote")


@q(f"SELECT c AS address, CAST(count(DISTINCT scheme) AS BIGINT) AS n_sources, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_CANONICAL} AS c, split_part(url, ':', 1) AS scheme FROM pages) WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT scheme) > 1")
def shared_links(spark, d):
    return links.shared_addresses(table(spark, d, "pages").select("url", F.substring_index("url", ":", 1).alias("scheme")), "url", "scheme")


@q("SELECT o_orderkey, CASE WHEN o_custkey = c_custkey THEN c_custkey END AS person FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0")
def person_accounts(spark, d):
    handle = F.concat(F.lit("https://www.twitter.com/Customer"), F.col("c_custkey").cast("string"), F.lit("?lang=cs"))
    people = table(spark, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("person"), handle.alias("profile"))
    post = F.concat(F.lit("https://x.com/customer"), F.col("o_custkey").cast("string"), F.lit("/status/"), F.col("o_orderkey").cast("string"))
    return links.account_join(table(spark, d, "orders").select("o_orderkey", post.alias("post")), people, "post", "profile").select("o_orderkey", "person")


@q("SELECT s.source, CAST(s.n AS BIGINT) AS n, u.l AS unit FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) s LEFT JOIN (SELECT 'src' || n_nationkey AS l FROM nation) u ON u.l = s.source")
def site_units(spark, d):
    sites = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    units = table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("unit"))
    return sites.join(units, F.col("unit") == F.col("source"), "left")


@q(
    """
SELECT n_nationkey, CAST(count(c_custkey) AS BIGINT) AS n_members, CAST(any_value(n_regionkey) * 2 AS BIGINT) AS stated, any_value(n_regionkey) * 2 = count(c_custkey) AS agrees
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def member_counts(spark, d):
    heading = F.concat(F.lit("## "), F.col("n_name"), F.lit(" ("), (F.col("n_regionkey") * 2).cast("string"), F.lit(")"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    counted = links.member_counts(table(spark, d, "nation").select("n_nationkey", heading.alias("heading")), members, "n_nationkey", "heading")
    return counted.drop("heading")


_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@q(rf"""
SELECT doc_id, address FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_ADDRESS}')) AS address FROM documents)
WHERE regexp_matches(lower(address), '[@.](mail2\.example\.com|example\.org)$')""")
def official_contacts(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0))).alias("address")).distinct()
    return found.filter(links.official_contact(F.col("address"), ("mail2.example.com", "example.org")))


@q("SELECT l_orderkey, l_linenumber, CAST(o_orderdate AS DATE) AS issued, CAST(l_shipdate AS DATE) AS effective, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def effective_dates(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    issued, effective = F.col("o_orderdate"), F.col("l_shipdate")
    return lines.select("l_orderkey", "l_linenumber", issued.cast("date").alias("issued"), effective.cast("date").alias("effective"), dates.days_after(issued, effective).alias("days"))


QUERIES, SQL = q.queries, q.sql
