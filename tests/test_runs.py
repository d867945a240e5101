"""Runs: what is recomputed, what stays, and what a failure leaves."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from almanac.streaming import runs
from almanac.streaming.runs import Step


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet") if "/_" not in str(p)}


def steps(broken=()):
    def sums(t):
        return t["a"].groupBy("period").agg(F.sum("x").alias("x"))

    def both(t):
        return t["sums"].join(t["b"].groupBy("period").agg(F.count("*").alias("n")), "period", "left")

    def top(t):
        if "top" in broken:
            raise OSError("no answer")
        return t["both"].agg(F.sum("x").alias("x"))

    return [Step("sums", ("a",), sums), Step("both", ("sums", "b"), both), Step("top", ("both",), top, whole=True)]


def test_only_what_hangs_on_a_change_is_made(spark, tmp_path):
    root = str(tmp_path)
    a = lambda *rows: spark.createDataFrame(rows, "period string, x int")
    b = lambda *rows: spark.createDataFrame(rows, "period string, y string")
    told = lambda step: sorted(map(tuple, runs.read(spark, root, step).collect()), key=str)
    go = lambda x, y, broken=(): {(r["name"], r["period"]): r["status"] for r in runs.run(spark, root, {"a": x, "b": y}, steps(broken), "2024-01-01").collect()}
    with pytest.raises(ValueError):
        runs.read(spark, root, "sums")
    assert runs.last_run(spark, root) == 0
    first = a(("2020", 1), ("2020", 2), ("20:21", 5), (None, 7))
    assert set(go(first, b(("2020", "u"), ("20:21", None))).values()) == {"new"}
    assert told("sums") == [("2020", 3), ("20:21", 5), ("none", 7)] and told("top") == [(15, "all")]
    assert told("both") == [("2020", 3, 1), ("20:21", 5, 1), ("none", 7, None)]
    before = files(root)
    # Nothing has changed, in another order of rows.
    assert set(go(first.repartition(3).orderBy("x"), b(("20:21", None), ("2020", "u"))).values()) == {"same"}
    assert files(root) == before and runs.last_run(spark, root) == 2
    # One source's one period: what hangs on it, and the answer over all.
    assert go(first, b(("2020", "u"), ("20:21", "now")))["b", "20:21"] == "changed"
    new = set(files(root)) - set(before)
    assert {n.split("/")[0] for n in new} == {"both", "top"} and all("2020" not in n and "none" not in n for n in new) and all(files(root)[n] == t for n, t in before.items())
    # A failure between steps leaves the answers, and the changes are found again.
    changed = a(("2020", 1), ("2020", 2), ("20:21", 50), (None, 7))
    with pytest.raises(OSError):
        go(changed, b(("2020", "u"), ("20:21", "now")), broken=("top",))
    assert runs.last_run(spark, root) == 3 and told("sums") == [("2020", 3), ("20:21", 5), ("none", 7)] and told("both")[1] == ("20:21", 5, 1)
    assert go(changed, b(("2020", "u"), ("20:21", "now")))["a", "20:21"] == "changed"
    assert told("sums")[1] == ("20:21", 50) and told("both")[1] == ("20:21", 50, 1) and told("top") == [(60, "all")]
    # A period that is gone goes everywhere.
    assert go(a(("2020", 1), ("2020", 2), (None, 7)), b(("2020", "u")))["a", "20:21"] == "gone"
    assert told("sums") == [("2020", 3), ("none", 7)] and told("both") == [("2020", 3, 1), ("none", 7, None)] and told("top") == [(10, "all")]
    old = told("both")
    assert runs.vacuum(spark, root, ["sums", "both", "top"]) > 0 and told("both") == old and runs.vacuum(spark, root, ["sums", "both", "top"]) == 0
    # All is gone.
    go(a(), b())
    assert told("sums") == told("both") == [] and told("top") == [(None, "all")]


def test_state_tells_when(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([("p", 1), ("q", 1)], "period string, x int")
    one = [Step("s", ("a",), lambda t: t["a"])]
    runs.run(spark, root, {"a": rows}, one, "2024-01-01")
    runs.run(spark, root, {"a": rows.withColumn("x", F.when(F.col("period") == "q", 2).otherwise(1))}, one, "2024-01-02")
    got = {r["period"]: (r["last_checked"].day, r["last_changed"].day) for r in runs.state(spark, root).filter("kind = 'source'").collect()}
    assert got == {"p": (2, 1), "q": (2, 2)}
    # A step that is new is made for all periods, though nothing has changed.
    more = [*one, Step("n", ("s",), lambda t: t["s"].groupBy("period").count())]
    runs.run(spark, root, {"a": rows.withColumn("x", F.when(F.col("period") == "q", 2).otherwise(1))}, more, "2024-01-03")
    assert sorted(map(tuple, runs.read(spark, root, "n").collect())) == [("p", 1), ("q", 1)]


def test_digests(spark):
    df = spark.createDataFrame([("p", 1, "a"), ("p", 2, None), ("p", None, "2"), ("q", 1, "a"), ("q", 1, "a"), ("r", 1, "a")], "period string, x int, y string")
    of = lambda d: {r[0]: tuple(r)[1:] for r in d.collect()}
    whole = of(runs.digest(df))
    assert whole == of(runs.digest(df.repartition(5).orderBy(F.rand(1)))) and len(set(whole.values())) == 3
    parts = runs.digest(df.filter("x = 1")).unionByName(runs.digest(df.filter("x <> 1 OR x IS NULL")))
    assert of(runs.merged(parts)) == whole
    swapped = spark.createDataFrame([("p", 1, None), ("q", None, "1")], "period string, x int, y string")
    a, b = of(runs.digest(swapped.drop("period").withColumn("period", F.lit("p")).limit(1))), of(runs.digest(swapped.filter("x IS NULL").withColumn("period", F.lit("p"))))
    assert a != b
    f = of(runs.fingerprint(df, df.filter("period <> 'r'")))
    assert set(f) == {"p", "q", "r"} and f != of(runs.fingerprint(df, df))
