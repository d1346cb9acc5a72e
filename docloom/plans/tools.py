"""The tools of this package: search, profiles, overviews, news, claims and programmes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import search as S
from ..registry import ranks
from . import relational, texts
from ._base import table


def register(tools) -> None:
    for tool in (search, profile, overview, units, members, verify_claim, news, programme):
        tools.add(tool.__name__, tool)
    for name, query in (relational.QUERIES | texts.QUERIES).items():
        tools.add(f"query_{name}", query)


@ranks
def search(spark, sf_dir, query="", lang=None, k=10):
    docs = table(spark, sf_dir, "documents")
    where = F.col("lang") == lang if lang else None
    return S.search(docs, query or "", int(k), where=where)


def profile(spark, sf_dir, customer=None):
    rows = relational.profile_360(spark, sf_dir)
    return rows if customer is None else rows.filter(F.col("c_custkey") == int(customer))


def overview(spark, sf_dir, facet=None):
    rows = relational.overview_facets(spark, sf_dir)
    return rows if facet is None else rows.filter(F.col("facet") == facet)


def units(spark, sf_dir, root=None):
    rows = relational.hierarchy_depth(spark, sf_dir)
    return rows if root is None else rows.filter(F.col("root") == root)


def members(spark, sf_dir, unit=None):
    rows = relational.hierarchy_depth(spark, sf_dir).filter("depth = 2")
    return rows if unit is None else rows.filter(F.element_at(F.split("path", "/"), -2) == unit)


@ranks
def verify_claim(spark, sf_dir, claim="", k=5):
    """Documents that speak for a claim: those with all of its words first, then by score; the texts are read once for
    totals and once for scores."""
    docs = table(spark, sf_dir, "documents")
    words = len(S.query_terms(claim or ""))
    scored = S.scores(docs, claim or "").withColumn("all_words", F.col("parts") == words)
    return scored.select("doc_id", "score", "all_words").orderBy(F.desc("all_words"), F.desc(F.round("score", 6)), "doc_id").limit(int(k))


def news(spark, sf_dir, week=None):
    rows = table(spark, sf_dir, "events").withColumn("week", dates.iso_week(F.to_date("ts")))
    return rows if week is None else rows.filter(F.col("week") == week)


@ranks
def programme(spark, sf_dir, query="", k=10):
    """A search over hand-made and harvested programmes together."""
    own = table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text", F.lit("content").alias("layer"))
    harvested = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("data").alias("layer"))
    both = own.unionByName(harvested)
    return S.search(both, query or "", int(k)).join(both.select("doc_id", "layer"), "doc_id").orderBy(F.desc("score"), "doc_id")
