"""Late subtitles with state and timers, and the table that batches change."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom import store
from docloom.streaming import clear_old, keep_results, monthly_counts, monthly_totals, outcomes, read_current, retry_results, to_try_again, upsert
from docloom.streaming import tables

TRY = "video string, published timestamp, fetched timestamp, subtitles string"
T0 = datetime(2026, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def run_batch(spark, folder, rows, sink, checkpoint):
    """One more file of tries, and one run of the stream over what is new."""
    spark.createDataFrame(rows, TRY).coalesce(1).write.mode("append").parquet(folder)
    stream = retry_results(spark.readStream.schema(TRY).parquet(folder))
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("kind", "video", "published", "fetched", "tries", "subtitles", "reason").collect())


def test_videos_are_tried_until_they_are_two_weeks_old(spark, tmp_path):
    """The clock moves by the tries themselves: a watermark one day behind the latest."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    sink = keep_results(out, buckets=4)
    run_batch(spark, folder, [("a", day(0), day(1), None), ("b", day(0), day(1), "hello"), ("c", day(0), day(1), None)], sink, check)
    assert sorted(r["video"] for r in to_try_again(spark, check).collect()) == ["a", "c"]
    run_batch(spark, folder, [("a", day(0), day(9), "late ones"), ("c", day(0), day(9), None)], sink, check)
    assert [(r["video"], r["tries"]) for r in to_try_again(spark, check).collect()] == [("c", 2)]
    found = lambda: {r["video"]: r["subtitles"] for r in read_current(spark, f"{out}/subtitles").collect()}
    assert found() == {"a": "late ones", "b": "hello"}
    run_batch(spark, folder, [("d", day(20), day(21), None), ("c", day(0), day(21), "too late"), (None, day(1), day(2), "x"), ("e", None, day(2), None)], sink, check)
    assert [r["video"] for r in to_try_again(spark, check).collect()] == ["d"]  # the state of a, b and c has ended
    run_batch(spark, folder, [("c", day(0), day(2), "came after the end"), ("d", day(20), day(22), None)], sink, check)
    closed = {r["video"]: (r["tries"], r["fetched"]) for r in spark.read.parquet(f"{out}/closed").collect()}
    assert closed == {"a": (2, day(9)), "b": (1, day(1)), "c": (2, None)}
    late = sorted((str(r["video"]), r["reason"]) for r in spark.read.parquet(f"{out}/late").collect())
    assert late == [("None", "incomplete"), ("c", "after the window"), ("c", "already closed"), ("e", "incomplete")]
    assert found() == {"a": "late ones", "b": "hello"}


def test_stream_equals_the_table(spark, tmp_path):
    r = random.Random(4)
    tries = []
    for v in range(40):
        published = r.uniform(0, 30)
        for _ in range(r.randrange(1, 6)):
            tries.append((f"v{v}", day(published), day(published + r.uniform(0, 18)), r.choice([None, None, "text"])))
    tries.sort(key=lambda x: x[2])
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    sink = keep_results(out, buckets=4)
    for i in range(0, len(tries), 45):
        part = tries[i : i + 45]
        r.shuffle(part)
        run_batch(spark, folder, part, sink, check)
    both = spark.read.parquet(f"{out}/closed").drop("batch").unionByName(spark.read.parquet(f"{out}/late").drop("batch"))
    want = outcomes(spark.createDataFrame(tries, TRY))
    assert rows_of(both) == rows_of(want) and want.filter("kind = 'closed'").count() > 10


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "table")
    keep = upsert(path, ["k"], ["v"], buckets=16)
    keep(spark.range(200).selectExpr("id AS k", "0 AS v", "'old' AS x"), 0)
    before, state = files(path), store.read_pointer(spark, path)
    keep(spark.createDataFrame([(5, 1, "new"), (5, -1, "older"), (500, 0, "added")], "k long, v int, x string"), 1)
    after = store.read_pointer(spark, path)
    moved = [b for b in after["folders"] if after["folders"][b] != state["folders"].get(b)]
    assert len(moved) <= 2 and before.items() <= files(path).items()
    rows = {r["k"]: r["x"] for r in read_current(spark, path).collect()}
    assert len(rows) == 201 and rows[5] == "new" and rows[500] == "added" and rows[6] == "old"
    keep(spark.createDataFrame([(5, 9, "again")], "k long, v int, x string"), 1)  # a batch that was finished
    assert read_current(spark, path).filter("k = 5").first()["x"] == "new"
    keep(spark.createDataFrame([(6, 1, "y")], "k long, v int, z string"), 2)  # a new column, and one that is missing
    rows = {r["k"]: (r["x"], r["z"]) for r in read_current(spark, path).filter("k in (5, 6)").collect()}
    assert rows == {5: ("new", None), 6: (None, "y")}
    gone = clear_old(spark, path)
    assert 1 <= len(gone) <= 3 and read_current(spark, path).count() == 201
    keep(spark.createDataFrame([], "k long, v int, x string"), 3)
    assert read_current(spark, path).count() == 201


@pytest.mark.parametrize("step", ["write", "pointer"])
def test_a_death_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "table")
    keep = upsert(path, ["k"], ["v"], buckets=4)
    keep(spark.range(20).selectExpr("id AS k", "0 AS v"), 0)

    def dies(*_, **__):
        raise OSError("killed")

    with monkeypatch.context() as m:
        if step == "pointer":
            m.setattr(tables, "write_pointer", dies)
        else:
            m.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", dies)
        with pytest.raises(OSError):
            keep(spark.range(10).selectExpr("id AS k", "1 AS v"), 1)
    assert {r["v"] for r in read_current(spark, path).collect()} == {0} and read_current(spark, path).count() == 20
    keep(spark.range(10).selectExpr("id AS k", "1 AS v"), 1)
    assert read_current(spark, path).agg(F.sum("v"), F.count("*")).first() == (10, 20)


def test_months_come_out_once_they_are_over(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    every = []

    def run(*rows):
        every.extend(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = monthly_totals(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((str(r["month"]), r["event_type"], r["n"], r["total"], r["late"]) for r in spark.read.schema("month date, event_type string, n long, total double, late boolean").parquet(out).collect())

    assert run((day(3), "a", 1.0), (day(5), "a", 2.0), (day(4), "b", None)) == []
    assert run((day(30), "a", 4.0), (day(31), "a", 8.0)) == []  # the clock stands at the 31st of January
    january = [("2026-01-01", "a", 3, 7.0, False), ("2026-01-01", "b", 1, 0.0, False)]
    assert run((day(33), "a", 16.0)) == january
    assert run((day(6), "b", 5.0)) == [*january, ("2026-01-01", "b", 1, 5.0, True)]
    done = run((day(70), "c", 1.0))
    assert ("2026-02-01", "a", 2, 24.0, False) in done and len(done) == 4
    whole = monthly_counts(spark.createDataFrame(every, schema)).filter("month < '2026-03-01'").collect()
    sums = {}
    for month, group, n, total, _ in done:
        sums[month, group] = tuple(map(sum, zip(sums.get((month, group), (0, 0.0)), (n, total), strict=True)))
    assert sums == {(str(r["month"]), r["event_type"]): (r["n"], r["total"] or 0.0) for r in whole}


def test_processors_load_where_the_package_is_not(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from docloom.streaming.months import MonthlyTotals
    from docloom.streaming.retries import Retries

    (tmp_path / "p").write_bytes(cloudpickle.dumps((Retries(), MonthlyTotals("g"))))
    load = "import pickle, sys; a, b = pickle.load(open('p', 'rb')); assert a.window_ms and b.group == 'g' and 'docloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", load], cwd=tmp_path, check=True, env={})
