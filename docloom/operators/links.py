"""Joins on addresses and names, member counts, and what may be shown of people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def url_join(left: DataFrame, right: DataFrame, left_url: str, right_url: str, how: str = "left") -> DataFrame:
    """``left`` with the rows of ``right`` whose address is the same once both are canonical.

    An equi-join; what is no address meets nothing. Where ``right`` may repeat an address, reduce it to a row for each first.
    """
    r = right.withColumn("_url", T.canonical_url(F.col(right_url))).drop(right_url)
    return left.join(r, T.canonical_url(F.col(left_url)) == F.col("_url"), how).drop("_url")


def shared_addresses(rows: DataFrame, url: str, source: str) -> DataFrame:
    """``address, n_sources, n``: addresses, once canonical, that more than one source holds, and how often."""
    found = rows.select(T.canonical_url(F.col(url)).alias("address"), F.col(source).alias("_source")).filter("address is not null")
    each = found.groupBy("address", "_source").agg(F.count("*").alias("n"))
    return each.groupBy("address").agg(F.count("*").alias("n_sources"), F.sum("n").alias("n")).filter("n_sources > 1")


def account_join(posts: DataFrame, people: DataFrame, post_url: str, profile_url: str) -> DataFrame:
    """Each post with the person whose profile names its account, or nulls; twitter.com and x.com are one site.

    An address without a handle meets nobody.
    """
    p = people.withColumn("_account", T.account_handle(F.col(profile_url))).drop(profile_url)
    return posts.join(p, T.account_handle(F.col(post_url)) == F.col("_account"), "left").drop("_account")


def member_counts(units: DataFrame, members: DataFrame, key: str, heading: str) -> DataFrame:
    """Each unit with its number of members, the number in the brackets of its heading, and whether they agree.

    Members are counted only; their names leave the scan with the projection.
    """
    counted = members.groupBy(key).agg(F.count("*").alias("n_members"))
    stated = F.regexp_extract(heading, r"\(([0-9]+)\)\s*$", 1).try_cast("long")
    rows = units.join(counted, key, "left").withColumn("n_members", F.coalesce("n_members", F.lit(0)).cast("long"))
    return rows.withColumn("stated", stated).withColumn("agrees", F.coalesce(F.col("stated") == F.col("n_members"), F.lit(False)))


def official_contact(address: Column, domains: Sequence[str]) -> Column:
    """Whether an address is of one of the official domains or below it; null is not."""
    host = F.lower(F.regexp_extract(address, r"@([^@\s]+)$", 1))
    return F.coalesce(F.exists(F.array(*[F.lit(d.lower()) for d in domains]), lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d))), F.lit(False))
