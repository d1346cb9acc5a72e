"""Joins in time: holders of an office at a date, memberships at a vote, versions in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize

OPEN = "9999-12-31"


def valid_until(rows: DataFrame, keys: list[str], start: str, end: str = "until") -> DataFrame:
    """``rows`` with the start of the key's next row as its (open) end; the last has null."""
    return rows.withColumn(end, F.lead(start).over(Window.partitionBy(*keys).orderBy(start)))


def holder_join(facts: DataFrame, spells: DataFrame, key: str, at: Column, start: str = "since", end: str = "until", how: str = "left") -> DataFrame:
    """Each fact with the spell of its key that covers ``at``: start inclusive, end exclusive, null ends open.

    The equi key stays a hash join; the dates are its residual condition, so no nested loop is planned.
    """
    s = spells.withColumnRenamed(key, "_key")
    covers = (F.col(key) == F.col("_key")) & (at >= F.col(start)) & (at < F.coalesce(F.col(end), F.lit(OPEN).cast("timestamp_ntz")))
    return facts.join(s, covers, how).drop("_key")


def _seconds(x: Column) -> Column:
    return F.unix_seconds(x.cast("timestamp"))


def _width(spells: DataFrame, start: Column, end: Column) -> int:
    """A bucket's seconds: half the mean length of spells, so that all of them together cover about three times as many
    buckets as there are spells."""
    mean = spells.agg(F.avg(F.greatest(end - start, F.lit(0)))).first()[0]
    return max(1, int((mean or 0) / 2))


def _bounds(df: DataFrame, low: Column, high: Column) -> tuple[int, int]:
    """The first and last second that matter; one row."""
    a, b = df.agg(F.min(low), F.max(high)).first()
    return (a, b) if a is not None and b is not None else (0, 0)


def bucketed_holder_join(facts: DataFrame, spells: DataFrame, key: str, at: Column, start: str = "since", end: str = "until", width: int | None = None) -> DataFrame:
    """``holder_join`` (left) for keys with very many facts and spells.

    Time is cut into buckets of ``width`` seconds (None: from the spells' lengths). A spell goes to each bucket that it
    covers, within the facts' time, a fact to its own; so a hot key is spread over its buckets, and each match is made in
    one of them. Facts without a key or time have no spell.
    """
    id_, moment = F.monotonically_increasing_id(), _seconds(at)
    rows = materialize(facts.withColumn("_id", id_).withColumn("_at", moment).withColumn("_exact", at.cast("timestamp_ntz")), "facts")
    first, last = _bounds(rows, F.col("_at"), F.col("_at"))
    s = spells.withColumnsRenamed({key: "_key"}).withColumn("_from", F.greatest(_seconds(F.col(start)), F.lit(first)))
    s = s.withColumn("_to", F.least(F.coalesce(_seconds(F.col(end)), F.lit(last)), F.lit(last))).filter("_key is not null and _from <= _to")
    width = width or _width(s, F.col("_from"), F.col("_to"))
    bucket = lambda c: F.floor(F.col(c) / width)
    s = s.withColumn("_bucket", F.explode(F.sequence(bucket("_from"), bucket("_to")))).drop("_from", "_to")
    asked = rows.select("_id", "_exact", F.col(key).alias("_key"), bucket("_at").alias("_bucket"))
    inside = (F.col("_exact") >= F.col(start).cast("timestamp_ntz")) & (F.col("_exact") < F.coalesce(F.col(end), F.lit(OPEN)).cast("timestamp_ntz"))
    met = asked.join(s, ["_key", "_bucket"]).filter(inside).drop("_key", "_bucket", "_exact")
    return rows.join(met, "_id", "left").drop("_id", "_at", "_exact")


def overlap_join(left: DataFrame, right: DataFrame, key: str, start: str = "since", end: str = "until", width: int | None = None) -> DataFrame:
    """Pairs of spells of one key that share some time: ``left``'s columns, and ``right``'s with ``other_`` before them.

    Spells go to the buckets that they cover; a pair is made only in the bucket in which the later one begins. Null ends
    are open, both kinds count as far as the last known time; a spell that ends as another begins shares nothing with it.
    """
    r = right.select(F.col(key), *[F.col(c).alias(f"other_{c}") for c in right.columns if c != key])
    named = [(left, start, end, "_a"), (r, f"other_{start}", f"other_{end}", "_b")]
    sides, top = [], 0
    for df, s, e, _ in named:
        top = max(top, _bounds(df, _seconds(F.col(s)), F.greatest(_seconds(F.col(s)), F.coalesce(_seconds(F.col(e)), _seconds(F.col(s)))))[1])
    for df, s, e, p in named:
        sides.append(df.withColumn(f"{p}_from", _seconds(F.col(s))).withColumn(f"{p}_to", F.coalesce(_seconds(F.col(e)), F.lit(top + 1))).filter(f"{key} is not null and {p}_from <= {p}_to"))
    width = width or max(_width(d, F.col(f"{p}_from"), F.col(f"{p}_to")) for d, p in zip(sides, ("_a", "_b"), strict=True))
    bucket = lambda c: F.floor(F.col(c) / width)
    a, b = (d.withColumn("_bucket", F.explode(F.sequence(bucket(f"{p}_from"), bucket(f"{p}_to")))) for d, p in zip(sides, ("_a", "_b"), strict=True))
    open_ = lambda c: F.coalesce(F.col(c), F.lit(OPEN)).cast("timestamp_ntz")
    at = lambda c: F.col(c).cast("timestamp_ntz")
    shares = (at(start) < open_(f"other_{end}")) & (at(f"other_{start}") < open_(end)) & (at(start) < open_(end)) & (at(f"other_{start}") < open_(f"other_{end}"))
    pairs = a.join(b, [key, "_bucket"]).filter(shares & (F.greatest(bucket("_a_from"), bucket("_b_from")) == F.col("_bucket")))
    return pairs.drop("_bucket", "_a_from", "_a_to", "_b_from", "_b_to")


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """Each fact with the ``value`` of its key's last version at or before ``at``, or null; one sort by key.

    Both sides are laid into one timeline, so no pair of rows is made.
    """
    left = facts.withColumn("_at", F.col(at)).withColumn("_fact", F.lit(1)).withColumn(value, F.lit(None).cast(versions.schema[value].dataType))
    right = versions.select(key, F.col(start).alias("_at"), value).withColumn("_fact", F.lit(0))
    line = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_fact").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_fact = 1").drop("_at", "_fact")


def titles(column: Column) -> Column:
    """A composite title such as ``ministři A a B`` as its single titles."""
    return F.transform(F.split(column, r"\s+a\s+|,\s*"), lambda x: F.trim(x))
