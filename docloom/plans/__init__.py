"""Queries over the tables, each with the same result in SQL."""

from __future__ import annotations

from . import files, people, relational, streams, texts

QUERIES = texts.QUERIES | relational.QUERIES | people.QUERIES | streams.QUERIES | files.QUERIES
ORACLE_SQL = texts.SQL | relational.SQL | people.SQL | streams.SQL | files.SQL
