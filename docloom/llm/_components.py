"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, release


def _least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) with m, the least of u and all its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of an edge other than a component's least node; ``edges`` has longs u and v.

    Each round is two joins and aggregations on the edges; their number falls with the logarithm of the longest
    path.  Only a count and a checksum reach the driver.
    """
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        own = small.select("u", F.col("m").alias("v"))
        others = small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialize(own.unionByName(others).distinct(), "edges")
        release(before)
