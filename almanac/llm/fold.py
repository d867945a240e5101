"""The bounded labelled sample that classifiers are fitted on, and scoring of whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, tidied


def training_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, longest: int, id_col: str = "doc_id", text_col: str = "text", total: int = 1 << 26) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `size` labelled documents outside the held-out fold.

    The choice is by a hash of the id, so it is the same at every run and unrelated to any
    column.  Texts of more than `longest` characters are left to scoring, and drawing ends where
    texts would pass `total` characters together, which bounds what reaches the driver.  Null
    labels and null ids are never drawn; of rows of one id the least text is.
    """
    drawn = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
        .filter(F.col("_y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_y").alias("_y"))
    )
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t")).filter(F.length("_t") <= longest)
    # The order is settled on ids and lengths alone, of `size` rows at most.
    ids = drawn.join(texts.groupBy("_id").agg(F.max(F.length("_t")).alias("_n")), "_id").orderBy(F.xxhash64("_id"), "_id").limit(size)
    ids = ids.withColumn("_sum", F.sum("_n").over(Window.orderBy(F.xxhash64("_id"), "_id"))).filter(F.col("_sum") <= total).select("_id", "_y")
    rows = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_t").alias("_t")).orderBy("_id").toArrow()
    return rows.column("_t").to_pylist(), rows.column("_y").to_pylist()


def with_columns(docs: DataFrame, text_col: str, make: Callable[[], Callable[[str], tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """The documents with columns that `make()`'s function gives for each whole text; one worker builds it once.

    Existing columns of the same names are replaced.
    """
    new = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields))
    rest = docs.drop(*(n for n, _ in fields))
    schema = T.StructType([*rest.schema.fields, *new.fields])
    kinds = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    at = rest.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            got = [f(x.as_py() or "") for x in batch.column(at)]
            made = [pa.array([g[i] for g in got], kinds[t]) for i, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *new.names])

    return rest.mapInArrow(tidied(work), schema)


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
