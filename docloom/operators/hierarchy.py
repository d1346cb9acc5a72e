"""Units and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize, release


def depths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``unit, root, depth, path`` for every unit below a root; a root has a null parent.

    Rounds of joins with steps of 1, 2, 4, ... levels: their number grows with the logarithm of the greatest depth, and
    neither rows nor depth have a limit.  Units in a cycle, or below a missing parent, are not reached; a cycle below a
    root is an error.  A unit that has several ways to a root has a row for each (``tree.labels`` has one row for
    each unit, and no paths).
    """
    rows = edges.select(F.col(child).alias("unit"), F.col(parent).alias("up"))
    tree = materialize(rows.filter("up is null").select("unit", F.col("unit").alias("root"), F.lit(0).alias("depth"), F.col("unit").cast("string").alias("path")), "tree")
    # ``up`` is ``step`` levels above ``unit``, ``tail`` the path between them.
    above = materialize(rows.filter("up is not null").select("unit", "up", F.col("unit").cast("string").alias("tail")), "above")
    step, most = 1, above.count()
    while True:
        known = tree.select(F.col("unit").alias("up"), "root", "depth", "path")
        further = above.join(known, "up").select("unit", "root", (F.col("depth") + step).alias("depth"), F.concat_ws("/", "path", "tail").alias("path"))
        further = materialize(further, "further")
        if further.isEmpty():
            release(above, further)
            return tree
        if step > most:
            raise ValueError("units below a root form a cycle")
        tree = tree.unionByName(further)
        next_ = above.select(F.col("unit").alias("up"), F.col("up").alias("next"), F.col("tail").alias("head"))
        before, above = above, materialize(above.join(next_, "up").select("unit", F.col("next").alias("up"), F.concat_ws("/", "head", "tail").alias("tail")), "above")
        release(before)
        step *= 2


def inconsistencies(parents: DataFrame, children: DataFrame) -> DataFrame:
    """``unit, parent, rule`` where a unit's parent and a parent's list of units do not agree."""
    p = parents.filter("parent is not null").select("unit", "parent", F.lit(True).alias("up"))
    c = children.select("unit", "parent", F.lit(True).alias("down"))
    both = p.join(c, ["unit", "parent"], "full")
    rule = F.when(F.col("up").isNull(), "listed but names another parent").when(F.col("down").isNull(), "not listed by its parent")
    return both.select("unit", "parent", rule.alias("rule")).filter("rule is not null")


def missing_parents(parents: DataFrame) -> DataFrame:
    """Units whose parent has no row."""
    known = parents.select(F.col("unit").alias("parent")).distinct()
    return parents.filter("parent is not null").join(known, "parent", "left_anti")
