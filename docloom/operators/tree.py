"""Units below a unit, by numbers instead of paths.

A walk around each tree enters every unit before the units below it and leaves it behind them.  The places of a unit's
entry and exit label it: what lies between them is its subtree, so a subtree is a range, and what stands below a unit in
all is the difference of two running sums.  The labels are a table of their own, for any number of later questions.

The walk is a linked list that no task ever holds: each event knows its next one, and rounds of joins on written tables
double how far each sees (list ranking), so deep chains cost as many rounds as flat trees.  Children of one parent are
put in order in blocks by hash, so a parent of very many is spread over tasks.

Defined results: a unit whose parent is null or has no row is a root; of several parents the least counts; repeated rows
count once, with the least weight; units of a cycle have no labels; a null unit is left out; a null weight is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, release

#: Blocks that the children of a parent are dealt to.
BLOCKS = 1024


def _events(units: DataFrame) -> DataFrame:
    """``unit, leaves, n_unit, n_leaves, entered, open, weight``: each entry and exit with its next event (null: the end),
    from ``unit, parent, weight``."""
    kids = units.filter("parent is not null").withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(BLOCKS)))
    inner = kids.withColumn("sibling", F.lead("unit").over(Window.partitionBy("parent", "block").orderBy("unit")))
    blocks = kids.groupBy("parent", "block").agg(F.min("unit").alias("first"))
    blocks = blocks.withColumn("later", F.lead("first").over(Window.partitionBy("parent").orderBy("block")))
    first = blocks.groupBy("parent").agg(F.min(F.struct("block", "first")).alias("b")).select(F.col("parent").alias("unit"), F.col("b.first").alias("child"))
    sibling = inner.join(blocks.drop("first"), ["parent", "block"]).select("unit", F.coalesce("sibling", "later").alias("sibling"))
    rows = units.join(first, "unit", "left").join(sibling, "unit", "left")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    event = lambda leaves, n_unit, n_leaves, entered, open_, weight: F.struct(F.lit(leaves).alias("leaves"), n_unit.alias("n_unit"), n_leaves.alias("n_leaves"), entered.alias("entered"), open_.alias("open"), weight.alias("weight"))
    enter = event(False, F.coalesce("child", "unit"), F.col("child").isNull(), one, one, F.col("weight"))
    leave = event(True, F.coalesce("sibling", "parent"), F.col("sibling").isNull(), zero, -one, zero)
    return rows.select("unit", F.inline(F.array(enter, leave)))


def labels(edges: DataFrame, child: str = "child", parent: str = "parent", weight: str | None = None) -> DataFrame:
    """``unit, root, depth, enter, leave, n_below, weight_below`` of each unit.

    ``leave`` is exclusive; ``n_below`` and ``weight_below`` (whole numbers) are of the units below, without the unit.
    """
    held = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(0)
    rows = edges.select(F.col(child).alias("unit"), F.col(parent).alias("parent"), held.cast("long").alias("weight")).filter("unit is not null")
    rows = rows.groupBy("unit").agg(F.min("parent").alias("parent"), F.min("weight").alias("weight"))
    known = rows.select(F.col("unit").alias("parent"), F.lit(True).alias("there"))
    rows = materialize(rows.join(known, "parent", "left").select("unit", F.when(F.col("there"), F.col("parent")).alias("parent"), "weight"), "units")
    walk = materialize(_events(rows).withColumn("done", F.col("n_unit").isNull()).withColumn("last", F.when(F.col("n_unit").isNull(), F.col("unit"))), "walk")
    # Sums run from an event to the one before the next that it knows; of a walk with n events half the rest end each round.
    for _ in range(2 + math.ceil(math.log2(2 * rows.count() + 2))):
        going = walk.filter("not done")
        if going.isEmpty():
            break
        on = walk.select(F.col("unit").alias("n_unit"), F.col("leaves").alias("n_leaves"), F.col("n_unit").alias("m_unit"), F.col("n_leaves").alias("m_leaves"), *[F.col(c).alias(f"m_{c}") for c in ("entered", "open", "weight", "done", "last")])
        add = lambda c: (F.col(c) + F.col(f"m_{c}")).alias(c)
        further = going.join(on, ["n_unit", "n_leaves"]).select("unit", "leaves", F.col("m_unit").alias("n_unit"), F.col("m_leaves").alias("n_leaves"), add("entered"), add("open"), add("weight"), F.col("m_done").alias("done"), F.col("m_last").alias("last"))
        before, walk = walk, materialize(walk.filter("done").unionByName(further), "walk")
        release(before)
    ends = walk.filter("done").select("unit", "leaves", F.col("last").alias("root"), "entered", "open", "weight")
    sides = [ends.filter("not leaves"), ends.filter("leaves").select("unit", F.col("entered").alias("left_entered"), F.col("weight").alias("left_weight"))]
    whole = sides[0].filter("unit = root").select("root", F.col("entered").alias("all"))
    own = rows.select("unit", F.col("weight").alias("own"))
    found = sides[0].join(sides[1], "unit").join(own, "unit").join(whole, "root")
    return found.select(
        "unit",
        "root",
        (-F.col("open")).cast("int").alias("depth"),
        (F.col("all") - F.col("entered")).alias("enter"),
        (F.col("all") - F.col("left_entered")).alias("leave"),
        (F.col("entered") - F.col("left_entered") - 1).alias("n_below"),
        (F.col("weight") - F.col("left_weight") - F.col("own")).alias("weight_below"),
    )


def subtree(found: DataFrame, unit) -> DataFrame:
    """The labels of a unit and of all units below it: one range of its root's labels."""
    top = found.filter(F.col("unit") == F.lit(unit)).select("root", F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    return found.join(F.broadcast(top), "root").filter((F.col("enter") >= F.col("_from")) & (F.col("enter") < F.col("_to"))).drop("_from", "_to")  # one row


def above(found: DataFrame, units: DataFrame) -> DataFrame:
    """``unit, upper, depth``: each unit of ``units`` (unit) with every unit above it, nearest last."""
    asked = found.join(units, "unit").select("unit", "root", F.col("enter").alias("_at"))
    upper = found.filter("n_below > 0").select(F.col("unit").alias("upper"), "root", "depth", F.col("enter").alias("_from"), F.col("leave").alias("_to"))
    return asked.join(upper, "root").filter((F.col("_from") < F.col("_at")) & (F.col("_at") < F.col("_to"))).select("unit", "upper", "depth")
