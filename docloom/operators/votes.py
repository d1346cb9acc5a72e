"""Votes: tallies, plurality, dissent, the pass rule and other checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(votes: DataFrame) -> DataFrame:
    """``vote, value, n``."""
    return votes.groupBy("vote", "value").agg(F.count("*").alias("n"))


def faction_tally(votes: DataFrame) -> DataFrame:
    """``vote, tally``: ``ano 12, ne 1``, most frequent first, ties by value."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value", "n")))
    return value_counts(votes).groupBy("vote").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(" ", x["value"], x["n"])), ", ").alias("tally"))


def plurality(votes: DataFrame) -> DataFrame:
    """``vote, value, n, ties``: the most frequent value (ties: the first by name) and how many share its count."""
    w = Window.partitionBy("vote")
    ranked = value_counts(votes).withColumn("top", F.max("n").over(w)).filter("n = top")
    return ranked.groupBy("vote").agg(F.min("value").alias("value"), F.max("n").alias("n"), F.count("*").alias("ties"))


def dissenters(votes: DataFrame, only: str = "ano") -> DataFrame:
    """``vote, member, value`` of those who differ from the plurality, where that is ``only``."""
    top = plurality(votes).filter(F.col("value") == only).select("vote", F.col("value").alias("most"))
    return votes.join(top, "vote").filter("value != most").select("vote", "member", "value")


def totals(votes: DataFrame, values: dict[str, str]) -> DataFrame:
    """``vote``, one count for each of ``values`` (column name to value), ``present`` and ``passed``.

    ``consistent`` says that no more votes were counted than members were present.

    A vote passes if more than half of those present are for it; a member who is absent or excused is not present.
    """
    counts = [F.count_if(F.col("value") == v).alias(c) for c, v in values.items()]
    t = votes.groupBy("vote").agg(*counts, F.count_if(~F.col("value").isin("nepritomen", "omluven")).alias("present"))
    counted = F.lit(0)
    for c in values:
        counted = counted + F.col(c)
    return t.withColumn("passed", F.col(next(iter(values))) * 2 > F.col("present")).withColumn("consistent", counted <= F.col("present"))


def stated_totals(rows: DataFrame, votes_for: str, present: str, parts: Sequence[str]) -> DataFrame:
    """``rows`` with ``passes`` by the stated numbers and ``consistent``: present covers the sum of the parts; nulls
    leave both null."""
    total = F.lit(0)
    for p in parts:
        total = total + F.col(p)
    return rows.withColumn("passes", F.col(votes_for) * 2 > F.col(present)).withColumn("consistent", total <= F.col(present))


def map_counts(rows: DataFrame, key: str, votes: str) -> DataFrame:
    """``key, value, n`` from a map of member to value."""
    return rows.select(key, F.explode(votes).alias("member", "value")).groupBy(key, "value").agg(F.count("*").alias("n"))


def number_match(subject, number):
    """Whether a vote's subject holds a print number, so that damaged marks between letters and digits do not matter.

    Runs of letters and of digits are compared whole: ``Z?8983`` holds ``Z-8983``, but not ``Z-898``.
    """
    parts = lambda x: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.upper(x), F.lit("[A-Z]+|[0-9]+"), F.lit(0)), " "), F.lit(" "))
    return F.contains(parts(subject), parts(number))
