"""Facts about keys for rows, without a task that gets a hot key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts of this size at most are broadcast whole: the keys' bytes and ``ROW_BYTES`` for each row.
MOST_BYTES, ROW_BYTES = 32 << 20, 100
#: A key is hot if it has more than one row in so many; there are fewer such keys than this.
SHARE = 1000


def attach(rows: DataFrame, facts: DataFrame, key: str, n_rows: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row for each key and in ``n_rows`` how many rows bear it.

    Facts are broadcast if a count of them and of their keys' bytes shows that they are small.  Otherwise only those
    of hot keys are, fewer than ``SHARE``; the other rows meet theirs in a shuffle in which no such key has many, and
    rows with a null key pass by.
    """
    n, size, total = facts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)), F.coalesce(F.sum(n_rows), F.lit(0))).first()
    plain = facts.drop(n_rows)
    if size + n * ROW_BYTES <= most_bytes:
        return rows.join(F.broadcast(plain), key, "left")
    hot = facts.filter(F.col(n_rows) * SHARE > total).drop(n_rows)
    cold = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold.join(plain, key, "left")).unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
