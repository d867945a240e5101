"""Pieces that several training-data operators share.

All operators here take a DataFrame plus the names of its id and text columns, select
only those columns (so extra columns, whatever their names, never clash) and return a new
DataFrame.  Null texts count as empty texts; null ids stay null in the result.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.plans import registry

#: Words are runs of anything but ASCII white space (fixed by the query contracts).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, where checkpoints go too; a temporary one only for unset local sessions."""
    told = registry.shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(told)
    return told


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that was written on the way."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder: lineage ends there and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables on the way, as compressed Parquet in the shared folder, each dropped as soon as it has been used."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        del df
        self.release()
        return self.spark.read.parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        drop(self.spark, self.path)
        self.release()

    def release(self) -> None:
        """Has the driver give back shuffle files that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def tidy() -> None:
    """Gives memory that is free again back to the system; workers and drivers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries do so by themselves
        pass


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The worker's function, tidying up after its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        tidy()

    return run


def held_out(doc_id: Column) -> Column:
    """True for the test fold: crc32 of the id's decimal text divisible by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def local_forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each node over undirected edges a-b and those that made `root`."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        live = root[a] != root[b]
        a, b = a[live], b[live]
    return root


def small_side(df: DataFrame, most: int = 250_000) -> DataFrame:
    """A materialised table, to be broadcast if it has `most` rows at most; results are the same either way."""
    return F.broadcast(df) if df.count() <= most else df


def spread_join(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner", hot: int = 1024, ways: int = 64, counts: DataFrame | None = None) -> DataFrame:
    """Join of many rows a key with one row a key at most, rows of hot keys dealt by `by` into `ways` parts.

    The 256 largest keys over `hot` rows are dealt so; any other holds less than 1/256 of all
    rows.  Their broadcast is that small at any size.  `counts` may tell (key, _rows) where they
    are known.
    """
    counts = many.groupBy(key).agg(F.count("*").alias("_rows")) if counts is None else counts
    counts = cut(counts.filter(F.col("_rows") > hot))
    top = F.broadcast(counts.orderBy(F.desc("_rows"), key).limit(256).select(key, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(ways))).otherwise(F.lit(0)).cast("int")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
    left = many.join(top, key, "left").withColumn("_part", part).drop("_hot")
    right = one.join(top, key, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [key, "_part"], how).drop("_part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, hot: int = 1024) -> DataFrame:
    """(node, component): each node of an undirected edge list with the smallest node it reaches.

    Alternating large-star and small-star rounds (Kiveris et al. 2014).  Each round has one
    grouped minimum, which combines before its shuffle, and one equi-join in which the edges of
    hot nodes, as the centre of a star, are dealt over many tasks; each round is cut into the
    shared folder.  Null ends and loops are ignored; an empty edge list gives no rows.
    """
    e = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    def lows(x: DataFrame, least: Column) -> DataFrame:
        return x.groupBy("u").agg(least.alias("m"))

    def meet(x: DataFrame, low: DataFrame) -> DataFrame:
        # Fewer edges than this can't make a task hot.
        return spread_join(x, low, "u", "v", hot=hot) if seen[0] > hot else x.join(low, "u")

    seen = mark(e)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v"), F.col("u")))
        large = meet(both, lows(both, F.least("u", F.min("v")))).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = cut(large)
        small = meet(large, lows(large, F.min("v"))).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u > v").distinct()
        e = cut(small)
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def row_key(id_: Column, text: Column) -> Column:
    """Names a row by its id and text; a null text counts as an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(F.coalesce(id_.cast("long").cast("string"), F.lit("-")), F.lit(":"), F.md5(text.cast("binary")), F.lit(":"), F.length(text).cast("string"))


def rows_of(docs: DataFrame, rows: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each key in `kept`, all columns kept; `rows` holds the keys of all documents.

    Whole texts stay where they are while the keys that go are few enough to be broadcast.
    """
    name = free_name("one_key", docs)
    marked = docs.withColumn(name, row_key(docs[id_col], docs[text_col]))
    counted = rows.groupBy("key").agg(F.count("*").alias("c")).join(kept.select("key", F.lit(True).alias("stays")), "key", "left")
    special = cut(counted.filter("c > 1 OR stays IS NULL").select(F.col("key").alias(name), F.coalesce("stays", F.lit(False)).alias("stays")))
    once = marked.join(small_side(special.select(name)), name, "left_anti").select(*docs.columns)
    repeated = special.filter("stays").select(name)
    if repeated.isEmpty():
        return once
    return once.unionByName(marked.join(small_side(repeated), name, "left_semi").dropDuplicates([name]).select(*docs.columns))


def one_of_each(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of the documents of each component in (doc_id, key, component) that of the smallest id, a null id last; all columns kept."""
    first = parts.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select(F.col("x.key").alias("key"))
    return rows_of(docs, parts, first, id_col, text_col)


def free_name(base: str, df: DataFrame) -> str:
    """A column name that the table doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in taken:
        name += "_"
    return name


def stamp(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]
