"""What all query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import ENDINGS, GAP, LEAST_STEM, LIGATURES, MARKED, MARKS, PLAIN

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; ``sql`` is what DuckDB runs for the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_sql(x: str) -> str:
    out = f"regexp_replace(translate(lower({x}), '{MARKED}', '{PLAIN}'), '{MARKS}', '', 'g')"
    for letter, two in LIGATURES.items():
        out = f"replace({out}, '{letter}', '{two}')"
    return out


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split_regex({fold_sql(f'coalesce({x}, {chr(39) * 2})')}, '{GAP}'), lambda w: w <> '')"


def stem_sql(x: str) -> str:
    return f"regexp_replace({x}, '^([a-z0-9]{{{LEAST_STEM},}}?)({'|'.join(ENDINGS)})$', '\\1')"
