"""A table of the latest version of each key, which batches change bucket by bucket.

Keys are dealt to buckets by hash.  A batch reads and rewrites only the buckets that it touches, into files of fresh
names, and then replaces the small file ``_current``, which names each bucket's folder; so a batch costs its own buckets,
not the table, and a run that dies at any step leaves the last table whole.  A batch that was finished is not done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.documents import latest
from ..store import delete, list_folder, read_pointer, write_pointer

BUCKETS = 64


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, state: dict, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of some buckets, or of all."""
    schema = StructType.fromJson(json.loads(state["schema"]))
    paths = [p for b, p in state["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(path: str, keys: Sequence[str], version: Sequence[str], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the row of each key with the greatest ``version`` in the table ``path``.

    Columns that a batch lacks become null in its rows; new columns are added.  ``buckets`` holds for a new table;
    later batches use the table's own number.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = read_pointer(spark, path) or {"buckets": buckets, "keys": list(keys), "batch": -1, "folders": {}, "schema": StructType().json()}
        if batch_id <= state["batch"]:
            return  # it was finished before
        n = state["buckets"]
        new = batch.withColumn("_bucket", _bucket(keys, n)).persist()
        try:
            touched = {r["_bucket"] for r in new.select("_bucket").distinct().collect()}  # as many as there are buckets
            if not touched:
                return write_pointer(spark, path, state | {"batch": batch_id})
            if state["folders"]:
                old = _table(spark, state, touched)
                rows = old.withColumn("_bucket", _bucket(keys, n)).unionByName(new, allowMissingColumns=True)
            else:
                rows = new
            kept = latest(rows, [*keys, "_bucket"], version)
            folder = f"{path}/data/{batch_id}-{uuid.uuid4().hex}"  # never one that the pointer may name
            # A bucket's rows already lie together, so they go to a file each without a further shuffle.
            kept.repartition(min(n, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
            schema = kept.drop("_bucket").schema
            if state["folders"] and _table(spark, state).columns != schema.names:
                schema = _table(spark, state).unionByName(spark.createDataFrame([], schema), allowMissingColumns=True).schema
            folders = state["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
            write_pointer(spark, path, state | {"batch": batch_id, "folders": folders, "schema": schema.json()})
        finally:
            new.unpersist()

    return run


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that ``upsert`` last finished, or None."""
    state = read_pointer(spark, path)
    return None if state is None else _table(spark, state)


def clear_old(spark: SparkSession, path: str) -> list[str]:
    """Delete the buckets' folders that the table no longer names, once no reader is at work on them; their names."""
    state = read_pointer(spark, path)
    used = set(state["folders"].values()) if state else set()
    found = [f for version in list_folder(spark, f"{path}/data") for f in list_folder(spark, version) if "/_bucket=" in f]
    gone = [f for f in found if not any(f.endswith(u.split("/data/", 1)[1]) for u in used)]
    for f in gone:
        delete(spark, f)
    return gone
