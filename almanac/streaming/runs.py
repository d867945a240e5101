"""Runs over all sources that recompute only what a change reaches, and commit once.

Sources are tables with a `period` (a season, a month).  A run takes a fingerprint of each
source's periods, recomputes the steps that hang on a changed one, for its periods only, and
writes them beside the old answers.  The last thing it writes says which folders hold what:
until then, and after a failure anywhere before, readers see the run before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The period of steps that are one answer over all periods.
ALL = "all"
_FOLDER = "in_period"
_STATE = "kind string, name string, period string, fingerprint string, run long, last_checked timestamp, last_changed timestamp"


@dataclass(frozen=True)
class Step:
    """A derived table: what it needs, sources or earlier steps by name, and how it is made of them.

    `build` gets the tables that it needs, for the periods to be made, and must keep `period`.
    A `whole` step gets all periods of what it needs, and is made anew if any of them has changed.
    """

    name: str
    needs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]
    whole: bool = False


def digest(rows: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    """(by, n, total, mixed): a digest of each group's rows whatever their order, repeated rows counted.

    It combines before its shuffle, and digests of parts of a group add up by `merged`.
    """
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    blank = F.array(*(c.isNull() for c in columns))  # the hash passes over nulls
    first, second = F.xxhash64(F.lit(1), *columns, blank), F.xxhash64(F.lit(2), blank, *reversed(columns))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(first.cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor(second).alias("mixed"))


def merged(parts: DataFrame, by: Sequence[str] = ("period",)) -> DataFrame:
    """Digests of whole groups of those of their parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mixed").alias("mixed"))


def fingerprint(*sources: DataFrame, by: str = "period") -> DataFrame:
    """(by, fingerprint) of each period over several sources at once; one that has no rows of a period counts as none."""
    marked = [digest(s, (by,)).select(by, F.lit(i).alias("i"), F.concat_ws(":", "n", "total", "mixed").alias("f")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, marked).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "f"))), lambda x: F.concat_ws("=", x["i"], x["f"])), " ").alias("fingerprint"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def last_run(spark: SparkSession, root: str) -> int:
    """The number of the last run that was committed, 0 before the first."""
    runs = [int(n[4:]) for n in listed(spark, f"{root}/_state") if n.startswith("run=")]
    return max((r for r in runs if exists(spark, f"{root}/_state/run={r}/_SUCCESS")), default=0)


def state(spark: SparkSession, root: str) -> DataFrame:
    """What the last run has committed: fingerprints of sources, folders and schemas of steps."""
    run = last_run(spark, root)
    return spark.read.schema(_STATE).parquet(f"{root}/_state/run={run}/*.parquet") if run else spark.createDataFrame([], _STATE)


def read(spark: SparkSession, root: str, step: str, at: DataFrame | None = None) -> DataFrame:
    """A step's table as the last run has committed it (or as the state `at` tells)."""
    told = (state(spark, root) if at is None else at).filter(F.col("name") == step)
    schema = told.filter("kind = 'schema'").select("fingerprint").first()
    if schema is None:
        raise ValueError(f"no run has made {step}")
    kinds = T.StructType.fromDDL(schema[0])
    held = told.filter("kind = 'step'").select("run", F.concat(F.lit("p_"), "period").alias(_FOLDER))
    runs = sorted(r[0] for r in held.select("run").distinct().collect())  # no more than there are periods
    if not runs:
        return spark.createDataFrame([], kinds)
    full = T.StructType([*kinds.fields, T.StructField("run", T.LongType()), T.StructField(_FOLDER, T.StringType())])
    rows = spark.read.schema(full).option("basePath", f"{root}/{step}").parquet(*(f"{root}/{step}/run={r}" for r in runs))
    return rows.join(held, ["run", _FOLDER], "left_semi").select(*kinds.names)


def gate(sources: dict[str, DataFrame], before: DataFrame) -> DataFrame:
    """(name, period, fingerprint, status) of all sources' periods: new, changed, same or gone."""
    now = reduce(DataFrame.unionByName, (fingerprint(df).select(F.lit(name).alias("name"), "period", "fingerprint") for name, df in sources.items()))
    old = before.filter("kind = 'source'").select("name", "period", F.col("fingerprint").alias("_old"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("fingerprint").isNull(), "gone").when(F.col("_old") == F.col("fingerprint"), "same").otherwise("changed")
    return now.join(old, ["name", "period"], "full").select("name", "period", "fingerprint", status.alias("status"))


def run(spark: SparkSession, root: str, sources: dict[str, DataFrame], steps: Sequence[Step], now: str) -> DataFrame:
    """Brings all steps up to date with the sources, and gives what the gate has found.

    Sources need a `period` that is text; null is the period 'none'.  Periods that are gone are
    removed from what hangs on them.  A step that is new is made for all periods.  A failure
    leaves everything as it was; the next run begins with the same changes.
    """
    number, before = last_run(spark, root) + 1, state(spark, root)
    sources = {n: df.withColumn("period", F.coalesce("period", F.lit("none"))) for n, df in sources.items()}
    gate(sources, before).write.mode("overwrite").parquet(f"{root}/_gate/run={number}")
    found = spark.read.parquet(f"{root}/_gate/run={number}")
    known = {r[0] for r in before.filter("kind = 'schema'").select("name").collect()}
    stale = {n: found.filter((F.col("name") == n) & (F.col("status") != "same")).select("period").distinct() for n in sources}
    every = {n: found.filter((F.col("name") == n) & (F.col("status") != "gone")).select("period") for n in sources}
    tables, held = dict(sources), before
    at = F.lit(now).cast("timestamp")
    for step in steps:
        reach = reduce(DataFrame.union, ((stale if step.name in known else every)[n] for n in step.needs)).distinct()
        if step.whole:
            if step.name in known and reach.isEmpty():
                stale[step.name] = every[step.name] = reach.filter("false")
                tables[step.name] = read(spark, root, step.name, held)
                continue
            reach, given = spark.createDataFrame([(ALL,)], "period string"), {n: tables[n] for n in step.needs}
        else:
            given = {n: tables[n].join(reach, "period", "left_semi") for n in step.needs}
        out = step.build(given)
        out = out.withColumn("period", F.lit(ALL)) if step.whole else out.withColumn("period", F.coalesce("period", F.lit("none")))
        path = f"{root}/{step.name}/run={number}"
        out.withColumn(_FOLDER, F.concat(F.lit("p_"), "period")).write.mode("overwrite").partitionBy(_FOLDER).parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        written = [n[len(_FOLDER) + 3 :] for n in listed(spark, path) if n.startswith(f"{_FOLDER}=")]  # by folders, no more than periods
        made = spark.createDataFrame([("step", step.name, unescaped(spark, p), None, number) for p in written] + [("schema", step.name, None, schema, number)], "kind string, name string, period string, fingerprint string, run long")
        mine = F.col("name") == step.name
        kept = held.filter(mine & (F.col("kind") == "step")).join(reach, "period", "left_anti")
        held = held.filter(~mine).unionByName(kept.select(*held.columns)).unionByName(made.withColumns({"last_checked": at, "last_changed": at}))
        tables[step.name] = read(spark, root, step.name, held)
        stale[step.name] = reach
        every[step.name] = held.filter(mine & (F.col("kind") == "step")).select("period")
    checked = found.filter("fingerprint IS NOT NULL").join(before.filter("kind = 'source'").select("name", "period", F.col("last_changed").alias("_was")), ["name", "period"], "left")
    marks = checked.select(F.lit("source").alias("kind"), "name", "period", "fingerprint", F.lit(number).cast("long").alias("run"), at.alias("last_checked"), F.when(F.col("status") == "same", F.col("_was")).otherwise(at).alias("last_changed"))
    held.filter("kind <> 'source'").unionByName(marks).coalesce(1).write.mode("overwrite").parquet(f"{root}/_state/run={number}")
    return found


def unescaped(spark: SparkSession, folder: str) -> str:
    """A partition's value by its folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder)


def vacuum(spark: SparkSession, root: str, steps: Sequence[str]) -> int:
    """Deletes folders that the last run doesn't refer to: replaced periods and what failed runs have left; how many there were.

    Not to be called while a run is under way, or while a reader holds a table of an earlier one.
    """
    last = last_run(spark, root)
    held = {(r["name"], r["run"], r["period"]) for r in state(spark, root).filter("kind = 'step'").collect()}  # as many as there are periods
    doomed = [f"{root}/{kind}/{n}" for kind in ("_state", "_gate") for n in listed(spark, f"{root}/{kind}") if n.startswith("run=") and int(n[4:]) != last]
    for step in steps:
        for run_ in (n for n in listed(spark, f"{root}/{step}") if n.startswith("run=")):
            inside = [n for n in listed(spark, f"{root}/{step}/{run_}") if n.startswith(f"{_FOLDER}=")]
            doomed += [f"{root}/{step}/{run_}/{n}" for n in inside if (step, int(run_[4:]), unescaped(spark, n[len(_FOLDER) + 3 :])) not in held]
    for path in doomed:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(doomed)
