"""Tables that cut lineage, written to the folder which all executors share."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset in local mode."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    global _local
    try:
        return _local
    except NameError:
        _local = tempfile.mkdtemp(prefix="docloom-")
        return _local


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The rows then survive lost executors, and two consumers do not compute them twice.  The files go when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again: later ones have been written from them."""
    for table in tables:
        path = _paths.pop(table)
        _written.remove((table.sparkSession, path))
        _delete(table.sparkSession, path)


def write_pointer(spark: SparkSession, path: str, state: dict, name: str = "_current") -> None:
    """Replace the small file ``name`` under ``path``: written aside, then renamed, so no reader sees a part of it.

    The rename is one step on HDFS and local disks.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    aside, target = hadoop.Path(f"{path}/{name}-{uuid.uuid4().hex}"), hadoop.Path(f"{path}/{name}")
    out = aside.getFileSystem(conf).create(aside, False)
    try:
        out.write(json.dumps(state, ensure_ascii=False).encode())
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, options)


def read_pointer(spark: SparkSession, path: str, name: str = "_current") -> dict | None:
    """What ``write_pointer`` last wrote, or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_written() -> None:
    """Delete what ``materialize`` has written so far."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clear
            return


atexit.register(drop_written)
