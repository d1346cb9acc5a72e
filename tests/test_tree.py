"""Tree labels and bucketed joins in time against plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docloom.operators import intervals, tree


def brute(rows):
    """unit -> (root, depth, n_below, weight_below) from (unit, parent, weight)."""
    up, own = {}, {}
    for u, p, w in rows:
        if u is not None:
            up[u] = min((x for x in (up.get(u), p) if x is not None), default=None)
            own[u] = min(w or 0, own.get(u, w or 0))
    up = {u: p if p in up else None for u, p in up.items()}
    paths = {}
    for u in up:
        path = [u]
        while up[path[-1]] is not None and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if up[path[-1]] is None:
            paths[u] = path
    below = {u: [v for v, p in paths.items() if u in p[1:]] for u in paths}
    return {u: (p[-1], len(p) - 1, len(below[u]), sum(own[v] for v in below[u])) for u, p in paths.items()}, below


def test_labels_of_trees_chains_and_stars(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCKS", 4)
    r = random.Random(2)
    rows = [("top", None, 1), ("loner", None, None), ("orphan", "missing", 5), (None, "top", 3)]
    rows += [(f"a{i}", r.choice(["top", *(f"a{j}" for j in range(i))]), i) for i in range(60)]
    rows += [(f"chain{i}", f"chain{i - 1}" if i else None, 1) for i in range(70)]
    rows += [(f"star{i:02d}", "loner", 2) for i in range(40)]
    rows += [("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("below_cycle", "x", 1), ("self", "self", 1)]
    rows += [("a5", "zzz", 9), ("a5", "top", 7), ("star00", "loner", 2)]
    want, below = brute(rows)
    found = tree.labels(spark.createDataFrame(rows, "child string, parent string, w long"), weight="w").cache()
    got = {x["unit"]: x for x in found.collect()}
    assert {u: (x["root"], x["depth"], x["n_below"], x["weight_below"]) for u, x in got.items()} == want
    assert all(x["leave"] - x["enter"] == x["n_below"] + 1 for x in got.values())
    for u in ("top", "a3", "loner", "chain40", "star07"):
        assert {x["unit"] for x in tree.subtree(found, u).collect()} == {u, *below[u]}
    up = tree.above(found, spark.createDataFrame([("chain9",), ("star01",), ("top",)], "unit string")).collect()
    assert {(x["unit"], x["upper"]) for x in up} == {("chain9", f"chain{i}") for i in range(9)} | {("star01", "loner")}
    assert tree.labels(spark.createDataFrame([], "child string, parent string")).count() == 0


T0 = datetime(2020, 1, 1)


def spells_of(r, n, keys):
    out = []
    for i in range(n):
        start = r.uniform(0, 1000)
        length = r.choice([0, r.uniform(0, 5), r.uniform(0, 40), r.uniform(0, 900)])
        out.append((i, r.choice(keys), T0 + timedelta(days=start), None if r.random() < 0.05 else T0 + timedelta(days=start + length)))
    return out


def test_facts_meet_the_spells_that_cover_them(spark):
    r = random.Random(5)
    keys = ["hot"] * 8 + ["cold", None]
    spells = spells_of(r, 300, keys)
    facts = [(i, r.choice([*keys, "nobody"]), T0 + timedelta(days=r.uniform(-50, 1200)) if r.random() < 0.95 else None) for i in range(400)]
    facts += [(1000 + i, s[1], s[2]) for i, s in enumerate(spells[:50])] + [(2000 + i, s[1], s[3]) for i, s in enumerate(spells[:50])]  # on the edges
    f = spark.createDataFrame(facts, "fact int, k string, at timestamp_ntz")
    s = spark.createDataFrame(spells, "spell int, k string, since timestamp_ntz, until timestamp_ntz")
    want = set()
    for i, k, at in facts:
        mine = [j for j, kk, a, b in spells if k is not None and k == kk and at is not None and a <= at and (b is None or at < b)]
        want |= {(i, j) for j in mine} or {(i, None)}
    for width in (None, 86_400, 10**9):
        got = [(x["fact"], x["spell"]) for x in intervals.bucketed_holder_join(f, s, "k", F.col("at"), width=width).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plain = {(x["fact"], x["spell"]) for x in intervals.holder_join(f, s, "k", F.col("at")).collect()}
    assert plain == want
    assert intervals.bucketed_holder_join(f.limit(0), s, "k", F.col("at")).count() == 0
    assert intervals.bucketed_holder_join(f, s.limit(0), "k", F.col("at")).filter("spell is not null").count() == 0


def test_overlaps_come_once(spark):
    r = random.Random(6)
    a, b = spells_of(r, 120, ["x", "x", "y", None]), spells_of(r, 120, ["x", "x", "y", None])
    schema = "n int, k string, since timestamp_ntz, until timestamp_ntz"
    far = datetime(9999, 12, 31)
    want = {(i, j) for i, k, s, e in a for j, kk, s2, e2 in b if k is not None and k == kk and s < (e2 or far) and s2 < (e or far) and s < (e or far) and s2 < (e2 or far)}
    for width in (None, 86_400, 10**9):
        got = [(x["n"], x["other_n"]) for x in intervals.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", width=width).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_key_has_no_hot_task(spark):
    """One key with 20,000 spells and facts: no bucket has more than a few of them."""
    n = 20_000
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    s = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("spell"), at(F.col("id") * 3600).alias("since"), at(F.col("id") * 3600 + 7200).alias("until"))
    f = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").alias("fact"), at(F.col("id") * 3600 + 1800).alias("at"))
    got = intervals.bucketed_holder_join(f, s, "k", F.col("at"))
    assert got.count() == 2 * n - 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and plan.count("Join") == 2
