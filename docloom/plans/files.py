"""Queries on archives: the documents are written as members, and come back from the directories or without them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import archive
from ..store import fresh_path
from ._base import Registry, table

q = Registry()


def _archived(spark, d) -> str:
    """A folder with all documents in archives, the members' sizes written behind their contents."""
    docs = table(spark, d, "documents")
    name = F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = fresh_path(spark, "archives")
    archive.write_archives(docs.select(name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), path)
    return path


_MEMBERS = "SELECT coalesce(lang, 'xx') || '/' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS size, 'OK' AS status, sha256(coalesce(text, '')) AS sha256 FROM documents"


def _told(members):
    return members.select("name", "size", "status", F.sha2("content", 256).alias("sha256"))


@q(_MEMBERS)
def archive_members(spark, d):
    return _told(archive.read_members(spark, _archived(spark, d)))


@q(_MEMBERS)
def carved_members(spark, d):
    return _told(archive.recover_files(spark, _archived(spark, d)))


@q(f"SELECT status, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM ({_MEMBERS}) GROUP BY 1")
def recovered_at_hits(spark, d):
    """What comes back at given places: the headers are found first, and each member ends at the next one at the latest."""
    path = _archived(spark, d)
    members = archive.recover_files(spark, path, archive.header_offsets(spark, path))
    return members.groupBy("status").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


QUERIES, SQL = q.queries, q.sql
