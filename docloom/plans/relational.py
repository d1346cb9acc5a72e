"""Queries on orders, events and the other relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import documents as D
from ..operators import hierarchy, intervals, tree, votes
from ._base import Registry, table

q = Registry()

# A vote for each order; the lines are the members' votes.
_VALUE = "CASE l_returnflag WHEN 'A' THEN 'ano' WHEN 'N' THEN 'ne' ELSE 'zdrzel' END"
_VOTES = f"SELECT l_orderkey AS vote, l_linenumber AS member, {_VALUE} AS value FROM lineitem"


def _votes(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("vote"), F.col("l_linenumber").alias("member"), F.expr(_VALUE).alias("value"))


@q(f"SELECT vote, string_agg(value || ' ' || n, ', ' ORDER BY n DESC, value) AS tally FROM (SELECT vote, value, count(*) AS n FROM ({_VOTES}) GROUP BY ALL) GROUP BY vote")
def faction_tally(spark, d):
    return votes.faction_tally(_votes(spark, d))


_PLURALITY = f"""
c AS (SELECT vote, value, count(*) AS n FROM ({_VOTES}) GROUP BY ALL),
p AS (SELECT vote, min(value) AS value, max(n) AS n, count(*) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY vote) AS top FROM c) WHERE n = top GROUP BY vote)"""


@q(f"WITH {_PLURALITY} SELECT vote, value, CAST(n AS BIGINT) AS n, CAST(ties AS BIGINT) AS ties FROM p")
def vote_plurality(spark, d):
    return votes.plurality(_votes(spark, d))


@q(f"WITH {_PLURALITY} SELECT v.vote, v.member, v.value FROM ({_VOTES}) v JOIN p ON p.vote = v.vote AND p.value = 'ano' WHERE v.value <> 'ano'")
def dissenters(spark, d):
    return votes.dissenters(_votes(spark, d))


@q(
    f"""
SELECT vote, CAST(count(*) FILTER (WHERE value = 'ano') AS BIGINT) AS pro, CAST(count(*) FILTER (WHERE value = 'ne') AS BIGINT) AS proti,
       CAST(count(*) FILTER (WHERE value = 'zdrzel') AS BIGINT) AS zdrzel, CAST(count(*) AS BIGINT) AS present,
       count(*) FILTER (WHERE value = 'ano') * 2 > count(*) AS passed, count(*) FILTER (WHERE value IN ('ano', 'ne', 'zdrzel')) <= count(*) AS consistent FROM ({_VOTES}) GROUP BY vote"""
)
def pass_rule(spark, d):
    return votes.totals(_votes(spark, d), {"pro": "ano", "proti": "ne", "zdrzel": "zdrzel"})


@q(
    f"""
SELECT o.o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE 2 * ano > total) AS BIGINT) AS mostly_for
FROM orders o JOIN (SELECT vote, count(*) AS total, count(*) FILTER (WHERE value = 'ano') AS ano FROM ({_VOTES}) GROUP BY vote) v ON v.vote = o.o_orderkey GROUP BY ALL"""
)
def mostly_for(spark, d):
    t = _votes(spark, d).groupBy(F.col("vote").alias("o_orderkey")).agg(F.count("*").alias("total"), F.count_if(F.col("value") == "ano").alias("ano"))
    joined = table(spark, d, "orders").join(t, "o_orderkey")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(2 * F.col("ano") > F.col("total")).alias("mostly_for"))


@q(f"SELECT o.o_orderkey, o.o_orderstatus, v.n FROM orders o LEFT JOIN (SELECT vote, CAST(count(*) AS BIGINT) AS n FROM ({_VOTES}) WHERE value = 'zdrzel' GROUP BY vote) v ON v.vote = o.o_orderkey")
def left_join_votes(spark, d):
    v = _votes(spark, d).filter("value = 'zdrzel'").groupBy(F.col("vote").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(v, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "n")


_PRINT = "concat(' ', array_to_string(regexp_extract_all(upper({}), '[A-Z]+|[0-9]+'), ' '), ' ')"


@q(
    f"""
SELECT p_partkey, asked, contains({_PRINT.format("concat('k tisku Z?', p_partkey, ' ', p_name)")}, {_PRINT.format("concat('Z-', asked)")}) AS same
FROM (SELECT p_partkey, p_name, unnest([p_partkey, p_partkey // 10, p_partkey * 10, p_partkey + 1]) AS asked FROM part)"""
)
def print_number_match(spark, d):
    key = F.col("p_partkey")
    asked = table(spark, d, "part").select("p_partkey", "p_name", F.explode(F.array(key, F.floor(key / 10).cast("long"), key * 10, key + 1)).alias("asked"))
    subject = F.concat(F.lit("k tisku Z?"), key.cast("string"), F.lit(" "), F.col("p_name"))
    return asked.select("p_partkey", "asked", votes.number_match(subject, F.concat(F.lit("Z-"), F.col("asked").cast("string"))).alias("same"))


_SPELLS = """
SELECT title, since, lead(since) OVER (PARTITION BY title ORDER BY since) AS until, holder FROM (
  SELECT o_orderpriority AS title, date_trunc('year', o_orderdate) AS since, min(o_custkey) AS holder FROM orders GROUP BY 1, 2)"""


def _spells(spark, d):
    spells = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("title"), F.date_trunc("year", "o_orderdate").cast("timestamp_ntz").alias("since")).agg(F.min("o_custkey").alias("holder"))
    return intervals.valid_until(spells, ["title"], "since")


@q(f"SELECT o.o_orderkey, o.o_orderpriority, s.holder FROM orders o LEFT JOIN ({_SPELLS}) s ON s.title = o.o_orderpriority AND o.o_orderdate >= s.since AND (s.until IS NULL OR o.o_orderdate < s.until)")
def office_holder_interval_join(spark, d):
    spells = _spells(spark, d).withColumnRenamed("title", "o_orderpriority")
    return intervals.holder_join(table(spark, d, "orders"), spells, "o_orderpriority", F.col("o_orderdate")).select("o_orderkey", "o_orderpriority", "holder")


@q(f"SELECT title, CAST(since AS DATE) AS since, CAST(until AS DATE) AS until, holder FROM ({_SPELLS})")
def lead_intervals(spark, d):
    return _spells(spark, d).select("title", F.col("since").cast("date").alias("since"), F.col("until").cast("date").alias("until"), "holder")


@q(
    """
WITH v AS (SELECT user_id, ts, max(value) AS version FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, v.version FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts"""
)
def version_as_of(spark, d):
    e = table(spark, d, "events")
    versions = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("version"))
    return intervals.as_of(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), versions, "user_id", "ts", "ts", "version").select("event_id", "version")


@q(
    """
WITH RECURSIVE e AS (
  SELECT 'r' || r_regionkey AS child, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
t AS (SELECT child AS unit, child AS root, 0 AS depth, child AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.child, t.root, t.depth + 1, t.path || '/' || e.child FROM t JOIN e ON e.parent = t.unit)
SELECT unit, root, CAST(depth AS INTEGER) AS depth, path FROM t"""
)
def hierarchy_depth(spark, d):
    return hierarchy.depths(_units(spark, d))


@q(
    """
WITH RECURSIVE e AS (
  SELECT 'r' || r_regionkey AS child, NULL AS parent, 0 AS w FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 0 FROM nation UNION ALL
  SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer),
t AS (SELECT child AS unit, child AS upper, 0 AS steps, w FROM e UNION ALL SELECT t.unit, e.parent, steps + 1, t.w FROM t JOIN e ON e.child = t.upper WHERE e.parent IS NOT NULL),
r AS (SELECT unit, max(steps) AS depth, arg_max(upper, steps) AS root FROM t GROUP BY 1)
SELECT upper AS unit, any_value(r.root) AS root, CAST(any_value(r.depth) AS INTEGER) AS depth, CAST(count(*) - 1 AS BIGINT) AS n_below, CAST(coalesce(sum(t.w) FILTER (WHERE t.steps > 0), 0) AS BIGINT) AS weight_below
FROM t JOIN r ON r.unit = t.upper GROUP BY upper"""
)
def subtree_sums(spark, d):
    weight = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.col("c_custkey").alias("w"))
    return tree.labels(_units(spark, d).join(weight, "child", "left"), weight="w").select("unit", "root", "depth", "n_below", "weight_below")


def _units(spark, d):
    edge = lambda t, kind, key, parent: table(spark, d, t).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("child"), parent.alias("parent"))
    up = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    top = edge("region", "r", "r_regionkey", F.lit(None).cast("string"))
    return top.unionByName(edge("nation", "n", "n_nationkey", up("r", "n_regionkey"))).unionByName(edge("customer", "c", "c_custkey", up("n", "c_nationkey")))


@q(
    """
WITH p AS (SELECT 'n' || n_nationkey AS unit, 'r' || n_regionkey AS parent FROM nation),
c AS (SELECT 'n' || n_nationkey AS unit, 'r' || (CASE WHEN n_nationkey % 5 = 0 THEN (n_regionkey + 1) % 5 ELSE n_regionkey END) AS parent FROM nation)
SELECT coalesce(p.unit, c.unit) AS unit, coalesce(p.parent, c.parent) AS parent, CASE WHEN p.unit IS NULL THEN 'listed but names another parent' ELSE 'not listed by its parent' END AS rule
FROM p FULL JOIN c ON p.unit = c.unit AND p.parent = c.parent WHERE p.unit IS NULL OR c.unit IS NULL"""
)
def hierarchy_check(spark, d):
    n = table(spark, d, "nation").withColumn("unit", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))
    listed = F.when(F.col("n_nationkey") % 5 == 0, (F.col("n_regionkey") + 1) % 5).otherwise(F.col("n_regionkey"))
    region = lambda x: F.concat(F.lit("r"), x.cast("string")).alias("parent")
    return hierarchy.inconsistencies(n.select("unit", region(F.col("n_regionkey"))), n.select("unit", region(listed)))


@q(
    """
SELECT p_brand AS root, p_type AS dir, CAST(count(*) AS BIGINT) AS n, CAST(grouping(p_type) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)"""
)
def rollup_root_dir(spark, d):
    parts = table(spark, d, "part").select(F.col("p_brand").alias("root"), F.col("p_type").alias("dir"))
    return parts.rollup("root", "dir").agg(F.count("*").alias("n"), F.grouping("dir").cast("long").alias("level"))


@q(
    r"""
WITH p AS (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', '') AS path FROM pages)
SELECT string_split(path, '/')[1] AS root, lower(regexp_extract(path, '[^/.](\.[^./]+)$', 1)) IN ('.com', '.pdf', '.html') AS is_document, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL"""
)
def ext_inventory_count(spark, d):
    return D.inventory(_paths(spark, d), (".com", ".pdf", ".html"))


def _paths(spark, d):
    return table(spark, d, "pages").select(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/+$", "").alias("path"))


@q(
    r"""
WITH p AS (SELECT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') AS a FROM pages)
SELECT array_to_string((CASE WHEN a[1] = a[2] THEN a[2:] ELSE a END)[1:2], '/') AS prefix, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1"""
)
def prefix_depth_rollup(spark, d):
    return D.prefix_counts(_paths(spark, d), 2)


@q(
    """
SELECT o_orderkey, strftime(o_orderdate, '%-d. %-m. %Y') AS written, CAST(o_orderdate AS DATE) AS parsed, strftime(o_orderdate, '%G-T%V') AS week,
       printf('%04d-%02d', year(o_orderdate), month(o_orderdate)) AS month FROM orders"""
)
def czech_date_format(spark, d):
    day = F.col("o_orderdate")
    written = dates.czech_date(day)
    return table(spark, d, "orders").select("o_orderkey", written.alias("written"), dates.from_czech_date(F.concat(F.lit("dne "), written)).alias("parsed"), dates.iso_week(F.to_date(day)).alias("week"), F.date_format(day, "yyyy-MM").alias("month"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"


@q(f"SELECT 'Příspěvky, ' || ({_MONTHS})[month(ts)] || ' ' || year(ts) AS title, CAST(count(*) AS BIGINT) AS n, max(ts) AS latest FROM events GROUP BY 1")
def month_titles(spark, d):
    return table(spark, d, "events").groupBy(dates.month_title("Příspěvky", F.col("ts")).alias("title")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@q(
    """
WITH s AS (SELECT event_id, CAST(event_id % 40000 AS INTEGER) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS shown FROM s"""
)
def duration_format(spark, d):
    return table(spark, d, "events").select("event_id", dates.duration(F.col("event_id") % 40000).alias("shown"))


@q("SELECT event_id, datediff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) < 14 AS retry FROM events")
def retry_window(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max(F.to_date("ts")).alias("today"))  # one row
    return e.crossJoin(F.broadcast(last)).select("event_id", dates.recent(F.to_date("ts"), F.col("today")).alias("retry"))


@q(
    """
SELECT event_type, user_id % 10 AS account, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(count(*) AS BIGINT) AS n, max(ts) AS latest,
       round(sum(value), 4) AS total FROM events GROUP BY ALL"""
)
def monthly_rollup(spark, d):
    month = F.trunc(F.to_date("ts"), "month").alias("month")
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("account"), month).agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.round(F.sum("value"), 4).alias("total"))


@q(
    """
SELECT strftime(date_trunc('week', ts), '%G-T%V') AS week, event_type AS section, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS people,
       CAST(min(event_id) AS BIGINT) AS first_id FROM events GROUP BY ALL"""
)
def weekly_digest(spark, d):
    return table(spark, d, "events").groupBy(dates.iso_week(F.to_date("ts")).alias("week"), F.col("event_type").alias("section")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("people"), F.min("event_id").alias("first_id"))


@q(
    """
SELECT week, rank, event_id, value FROM (
  SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_id, value, CAST(row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events) WHERE rank <= 3"""
)
def topk_per_week(spark, d):
    weekly = table(spark, d, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    return D.top_per_group(weekly, ["week"], [F.desc("value"), F.col("event_id")], 3).select("week", "rank", "event_id", "value")


@q("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_revision(spark, d):
    return D.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts")


@q(
    """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS done, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS kinds,
       string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS listed FROM orders GROUP BY o_custkey"""
)
def conditional_counts(spark, d):
    listed = F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("listed")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.countDistinct("o_orderpriority").alias("kinds"), listed)


@q("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


@q("SELECT event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def map_counts(spark, d):
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("votes"))
    return votes.map_counts(rows, "event_type", "votes")


@q(
    """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS pro, CASE WHEN event_id % 2 = 1 THEN CAST(event_id AS BIGINT) + 3180100000 END AS vote_id FROM events"""
)
def variant_hetero(spark, d):
    from ..sources.records import heterogeneous_tally

    raw = F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"pro"'))).otherwise(F.concat(F.lit("["), (F.col("event_id") + 3180100000).cast("string"), F.lit("]")))
    rows = heterogeneous_tally(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw")
    return rows.select("event_id", F.col("tally.pro").alias("pro"), F.get("ids", F.lit(0)).alias("vote_id"))


@q(
    """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN event_id // 2 END AS revokes FROM events)
SELECT event_id, user_id FROM e WHERE NOT EXISTS (SELECT 1 FROM e r WHERE r.revokes = e.event_id)"""
)
def supersession_in_force(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("K revokaci usnesení č. "), (F.col("event_id") / 2).cast("long").cast("string"), F.lit(" ze dne 1. 1. 2020"))).alias("title"))
    revoked = e.select(F.nullif(F.regexp_extract("title", r"revokaci usnesení č\. (\d+)", 1), F.lit("")).cast("long").alias("event_id")).filter("event_id is not null")
    return D.superseded(revoked, e, ["event_id"]).select("event_id", "user_id")


@q("SELECT event_id, event_type FROM events e WHERE ts >= (SELECT date_trunc('week', max(ts)) FROM events) AND NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.props = e.props AND o.ts < (SELECT date_trunc('week', max(ts)) FROM events))")
def new_this_week(spark, d):
    e = table(spark, d, "events")
    week = F.broadcast(e.agg(F.date_trunc("week", F.max("ts")).cast("timestamp_ntz").alias("week")))  # one row
    dated = e.crossJoin(week)
    return D.newly_seen(dated.filter("ts >= week"), dated.filter("ts < week"), ["user_id", "props"]).select("event_id", "event_type")


@q("SELECT 'N' || n_nationkey AS zkratka, n_name AS nazev, r_name AS nadrazeny, false AS verified FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'R' || r_regionkey, r_name, NULL, true FROM region")
def glossary_units(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("zkratka"), F.col("n_name").alias("nazev"), F.col("r_name").alias("nadrazeny"), F.lit(False).alias("verified")).distinct()
    curated = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("zkratka"), F.col("r_name").alias("nazev"), F.lit(True).alias("verified"))
    return D.unite(units, curated)


@q(
    """
SELECT c.c_custkey, c.c_name, n.n_name, CAST(count(o.o_orderkey) AS BIGINT) AS n_orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total, max(o.o_orderdate) AS latest
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL"""
)
def profile_360(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("latest"))
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(spent, "c_custkey", "left")
    return people.select("c_custkey", "c_name", "n_name", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "latest")


@q("SELECT c_mktsegment AS facet, n_name AS value, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS owing FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def overview_facets(spark, d):
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return people.groupBy(F.col("c_mktsegment").alias("facet"), F.col("n_name").alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("owing"))


@q(
    """
SELECT l.n_name AS person, r.s_name AS other FROM nation l JOIN supplier r ON l.n_nationkey = r.s_nationkey WHERE r.s_acctbal > 5000"""
)
def minister_titles(spark, d):
    named = table(spark, d, "nation").withColumn("title", F.concat(F.col("n_name"), F.lit(" a nikdo"))).select("n_nationkey", F.explode(intervals.titles(F.col("title"))).alias("person"))
    known = table(spark, d, "nation").select(F.col("n_name").alias("person"))
    return named.join(known, "person", "left_semi").join(table(spark, d, "supplier").filter("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey")).select("person", F.col("s_name").alias("other"))


@q("SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def weekly_window(spark, d):
    from ..streaming import weekly_counts

    return weekly_counts(table(spark, d, "events")).select("week", "event_type", "n", F.round("total", 4).alias("total"))


@q("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, round(sum(strlen(coalesce(text, ''))) / 1e9, 6) AS gb FROM documents GROUP BY source")
def byte_totals(spark, d):
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"), F.round(F.sum(size) / 1e9, 6).alias("gb"))


@q("SELECT lang, CASE WHEN n_chars > 20 THEN 'OK' ELSE 'FAIL' END AS status, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def status_tally(spark, d):
    status = F.when(F.col("n_chars") > 20, "OK").otherwise("FAIL").alias("status")
    return table(spark, d, "documents").groupBy("lang", status).agg(F.count("*").alias("n"))


@q("SELECT 1990 + (year(o_orderdate) - 1990) // 4 * 4 AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def votes_by_period(spark, d):
    period = (1990 + F.floor((F.year("o_orderdate") - 1990) / 4) * 4).cast("long")
    return table(spark, d, "orders").groupBy(period.alias("period")).agg(F.count("*").alias("n"))


@q("SELECT p_partkey, concat('Usnesení RHMP č. ', p_partkey, ': ', p_name) AS title FROM part")
def resolution_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("Usnesení RHMP č. "), F.col("p_partkey").cast("string"), F.lit(": "), "p_name").alias("title"))


@q("SELECT event_type, max(ts) AS latest, strftime(max(ts), '%Y-%m-%d %H:%M UTC') AS heading FROM events GROUP BY event_type")
def minute_headings(spark, d):
    latest = F.max("ts")
    return table(spark, d, "events").groupBy("event_type").agg(latest.alias("latest"), F.date_format(latest, "yyyy-MM-dd HH:mm 'UTC'").alias("heading"))


@q("SELECT CAST(date_trunc('month', ts) AS DATE) AS month, user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def monthly_window(spark, d):
    from ..streaming import monthly_counts

    return monthly_counts(table(spark, d, "events"), group="user_id").select("month", "user_id", "n", F.round("total", 4).alias("total"))


@q("SELECT p_partkey, concat('> Zdroj: ', coalesce(p_brand, 'neuvedeno'), ', staženo 1. 2. 2024.') AS note FROM part")
def provenance_notes(spark, d):
    note = T.provenance(F.col("p_brand"), dates.czech_date(F.lit("2024-02-01").cast("date")))
    return table(spark, d, "part").select("p_partkey", note.alias("note"))


@q("SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'schváleno' ELSE 'neschváleno' END AS status FROM orders) GROUP BY 1")
def status_variants(spark, d):
    written = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") > 500, " Schváleno").otherwise("schváleno")).otherwise("NESCHVÁLENO ")
    return table(spark, d, "orders").groupBy(T.status(written).alias("status")).agg(F.count("*").alias("n"))


QUERIES, SQL = q.queries, q.sql
