"""All named queries with the SQL that checks them."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_LOCAL: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL where there is one."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return put


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for what must outlive a task.

    It must be set, but for sessions of one process, which get a temporary one.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if spark not in _LOCAL:
        _LOCAL[spark] = tempfile.mkdtemp(prefix="almanac-shared-")
    return _LOCAL[spark]


def kept(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, so that rows and their places stay the same however often they are read."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
    WITH sums AS (
      SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
      FROM lineitem GROUP BY l_suppkey)
    SELECT row_number() OVER (ORDER BY revenue DESC, l_suppkey) AS rank, l_suppkey,
           coalesce(s_name, cast(l_suppkey AS varchar)) AS name, revenue, n_lines
    FROM (SELECT * FROM sums WHERE revenue > 0 ORDER BY revenue DESC, l_suppkey LIMIT 50)
    LEFT JOIN supplier ON s_suppkey = l_suppkey"""
)
def leaderboard_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum per key, filter above zero, top 50, then names and row numbers for those 50 rows only."""
    from pyspark.sql import Window

    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n_lines"))
    )
    best = sums.filter("revenue > 0").orderBy(F.desc("revenue"), "l_suppkey").limit(50)
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return best.join(names, "l_suppkey", "left").select(
        F.row_number().over(Window.orderBy(F.desc("revenue"), "l_suppkey")).cast("long").alias("rank"),
        "l_suppkey", F.coalesce("s_name", F.col("l_suppkey").cast("string")).alias("name"), "revenue", "n_lines",
    )


def _load() -> None:
    from almanac.plans import analogues, archive, more, shop, stateful  # noqa: F401  they register on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
