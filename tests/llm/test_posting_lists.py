"""Posting lists against a search of all vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import posting_lists as P

SCHEMA = "vec_id long, embedding array<double>"


def exact(rows, is_query, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = set()
    for q, v in good.items():
        if is_query(q):
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good.items() if i != q)[:k]
            out |= {(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(found)}
    return out


def rounded(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    return [(i, (centres[i % 40] + 0.4 * rng.normal(size=16)).tolist()) for i in range(3000)]


def test_recall_and_order(spark, clusters):
    rows = spark.createDataFrame(clusters, SCHEMA)
    asked = F.col("vec_id") % 20 == 0
    got = P.nearest(rows, asked, list_rows=64).cache()
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert P.recall(got, P.brute_force(rows, asked)) >= 0.95
    per = {}
    for r in got.collect():
        per.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert len(per) == 150 and all([x[0] for x in sorted(p)] == list(range(1, 11)) and [x[1:] for x in sorted(p)] == sorted(x[1:] for x in p) for p in per.values())


def test_brute_force_is_exact(spark, clusters):
    rows = clusters[:400]
    assert rounded(P.brute_force(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0)) == exact(rows, lambda i: i % 7 == 0)


def test_few_rows_are_searched_whole(spark, clusters):
    rows = clusters[:300] + [(9000, [0.0] * 16), (9001, None), (9002, [None] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [1.0] * 3), (None, [1.0] * 16)]
    got = P.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0)
    assert rounded(got) == exact([r for r in rows if r[1] is None or len(r[1]) == 16], lambda i: i % 7 == 0)
    some = P.nearest(spark.createDataFrame(clusters[:4], SCHEMA), F.lit(True))
    assert rounded(some) == exact(clusters[:4], lambda i: True) and some.count() == 12
    assert P.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert P.nearest(spark.createDataFrame([(1, None)], SCHEMA), F.lit(True)).count() == 0


def test_copies_make_no_long_list(spark, clusters):
    """A third of all rows are one vector; its copies find each other, the least ids first."""
    rows = [*clusters[:400], *((10_000 + i, clusters[5][1]) for i in range(200)), (20_000, [-0.0, *clusters[6][1][1:]]), (20_001, [0.0, *clusters[6][1][1:]])]
    table = spark.createDataFrame(rows, SCHEMA)
    got = P.nearest(table, F.col("vec_id") % 10 == 5)
    assert rounded(got) == exact(rows, lambda i: i % 10 == 5)
    index = P.build(P.usable(table, "vec_id", "embedding"))
    assert index.members.agg(F.max(F.size("ids"))).first()[0] == 11 and index.members.select("key").distinct().count() == 401


def test_repeated_ids_and_clashing_columns(spark, clusters):
    rows = spark.createDataFrame([(1, clusters[0][1], "a", 5.0), (1, clusters[1][1], "b", 6.0), (2, clusters[2][1], "c", 7.0)], "vec_id long, embedding array<double>, key string, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in P.nearest(rows, F.lit(True)).collect()]
    assert sorted(got) == [(1, 1, 2), (1, 1, 2), (2, 1, 1)]


def test_lists_are_balanced_and_walks_find_what_is_near(clusters):
    x = np.array([v for _, v in clusters])
    centres = P.balanced_centroids(x, 60)
    sizes = np.bincount(P._squares(x, centres).argmin(1), minlength=len(centres))
    assert 50 <= len(centres) <= 120 and sizes.max() <= 6 * len(x) / len(centres)
    row, node, d = P.walk(x[:200], centres, P.neighbour_graph(centres), 0.15)
    full = np.sqrt(P._squares(x[:200], centres))
    want = full <= 1.15 * full.min(1)[:, None]
    assert np.allclose(d, full[row, node])
    found = {*zip(row.tolist(), node.tolist(), strict=True)}
    assert sum((i, int(j)) in found for i, j in enumerate(full.argmin(1))) >= 198
    assert len(found & {*zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True)}) >= 0.97 * want.sum()
    same = P.balanced_centroids(np.ones((500, 4)), 8)
    assert len(same) >= 8 and (same == 1).all()
