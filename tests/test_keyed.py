"""Keyed state in a stream: previous rows, late rows, tombstones, restarts."""

import datetime as dt

from almanac.streaming import keyed

SCHEMA = "k string, seq long, gone boolean, at timestamp, title string, ns string, action string"


def ran(spark, tmp_path, rows, **more):
    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    source = tmp_path / "in"
    spark.createDataFrame([(k, n, g, at(s), t, ns, "x") for k, n, g, s, t, ns in rows], SCHEMA).repartition(2).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    with keyed.store(spark):
        pass
    keyed.run(keyed.upserts(stream, "k", ["seq"], ["title", "ns"], "gone", "at", **more), f"{tmp_path}/out", f"{tmp_path}/log")
    found = {}
    for p in sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[6:])):
        found = {r["k"]: (r["action"], r["title"], r["ns"], r["old_title"], r["old_ns"], r["last_changed"] and r["last_changed"].second, r["last_checked"] and r["last_checked"].second) for r in spark.read.parquet(str(p)).collect()} or found
    return found


def test_upserts_over_restarts(spark, tmp_path):
    first = [("a", 1, False, 1, "A", "0"), ("a", 3, False, 3, "B", "0"), ("a", 2, False, 2, "C", "0"), ("b", 5, False, 5, "X", None), ("c", 1, True, 1, "Z", "0"), (None, 1, False, 1, "n", "0"), ("d", None, False, 1, "n", "0")]
    assert ran(spark, tmp_path, first) == {"a": ("created", "B", "0", None, None, 3, 3), "b": ("created", "X", None, None, None, 5, 5)}
    second = [("a", 3, False, 9, "B", "0"), ("a", 4, False, 10, "B", "0"), ("b", 4, False, 4, "late", "0"), ("c", 0, False, 0, "late", "0"), ("e", 1, False, None, None, None)]
    assert ran(spark, tmp_path, second) == {"a": ("same", "B", "0", "B", "0", 3, 10), "e": ("created", None, None, None, None, None, None)}
    third = [("a", 5, False, 11, "B", "10"), ("b", 6, True, 12, "gone", "0"), ("c", 2, False, 13, "Z", "0")]
    assert ran(spark, tmp_path, third) == {"a": ("updated", "B", "10", "B", "0", 11, 11), "b": ("removed", None, None, "X", None, 12, 12), "c": ("created", "Z", "0", None, None, 13, 13)}
    assert ran(spark, tmp_path, [("b", 5, False, 14, "late", "0"), ("b", 7, False, 15, "Y", "0")]) == {"b": ("created", "Y", "0", None, None, 15, 15)}


def test_tombstones_expire(spark, tmp_path):
    more = {"delay": "1 second", "keep_ms": 5_000}
    ran(spark, tmp_path, [("a", 9, True, 1, None, None)], **more)
    ran(spark, tmp_path, [("z", 1, False, 50, "later", "0")], **more)  # moves the watermark over the tombstone's time
    assert ran(spark, tmp_path, [("z", 2, False, 55, "later", "0"), ("a", 1, False, 56, "back", "0")], **more)["a"][:2] == ("created", "back")


def test_alarms_of_a_stream(spark, tmp_path):
    """Late rows within the delay count, later ones don't; repeated ones count once; an alarm is told once."""
    from pyspark.sql import functions as F

    from almanac.streaming import windows

    schema, source = "id int, ts timestamp, v int", tmp_path / "in"
    at = lambda m: None if m is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)

    def run(*rows):
        spark.createDataFrame([(i, at(m), v) for i, m, v in rows], schema).write.mode("append").parquet(str(source))
        alarms = windows.stream_alarms(spark.readStream.schema(schema).parquet(str(source)), "ts", F.col("v"), 5, 5, "20 minutes", "id")
        alarms.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").collect() if list((tmp_path / "out").glob("*.parquet")) else []
        return sorted((int((r["start"] - at(0)).total_seconds()) // 60, r["total"]) for r in got)

    assert run((1, 0, 9), (2, 6, 9), (3, 11, 3), (3, 12, 3), (4, None, 9), (5, 13, None)) == []
    assert run((6, 11, 4), (7, 25, 9), (8, 16, 6)) == []  # late, but in time: the third period breaches too
    assert run((9, 100, 1)) == [(10, 7), (15, 6)]
    assert run((10, 3, 99), (11, 30, 99), (12, 200, 1)) == [(10, 7), (15, 6)]  # too late


def test_clashing_names(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, False, "x")], "gone string, k long, flag boolean, ts string")
    rows.withColumn("micros", rows["k"].cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("gone string, k long, flag boolean, ts string, micros timestamp").parquet(f"{tmp_path}/in")
    keyed.run(keyed.upserts(stream, "gone", ["k"], ["ts"], "flag", "micros"), f"{tmp_path}/out", f"{tmp_path}/log")
    (row,) = spark.read.parquet(f"{tmp_path}/out").collect()
    assert (row["gone"], row["k"], row["action"], row["ts"], row["old_ts"]) == ("a", 1, "created", "x", None)


def test_store_is_asked_by_bucket(spark, tmp_path):
    """Keys share buckets, whatever their type, so the store holds few values; the number of buckets is fixed by the first run."""
    import pytest

    schema = "k date, seq long, gone boolean, at timestamp, title string"
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)

    def run(rows, buckets):
        spark.createDataFrame([(day(i), s, False, None, t) for i, s, t in rows], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        keyed.run(keyed.upserts(stream, "k", ["seq"], ["title"], "gone", "at", buckets=buckets), f"{tmp_path}/out", f"{tmp_path}/log")
        return spark.read.parquet(f"{tmp_path}/out")

    run([(i, 1, "a") for i in range(200)], 3)
    got = run([(i, i % 2 + 1, "b") for i in range(200)], 3).filter("batch = 1").collect()
    assert sorted((r["k"], r["action"], r["old_title"]) for r in got) == [(day(i), "updated", "a") for i in range(1, 200, 2)]
    with keyed.store(spark):
        held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/log")
        assert held.count() <= 3
    with pytest.raises(Exception, match="3 buckets, not 5"):
        run([(i, 9, "c") for i in range(200)], 5)
