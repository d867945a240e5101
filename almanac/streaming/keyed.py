"""Keyed state inside a stream: upserts that tell the row before, tombstones, and times of checks.

The state lives in Spark's own store, in buckets of keys, so a batch touches only the buckets of
its keys, and a stream that is started again on its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def store(spark: SparkSession):
    """The state store that these streams need, for as long as one is started."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def _columns(orders: int, values: int) -> list[str]:
    """Names that a stream's columns have inside: of the key, its order, removal, time and values."""
    return ["k", *(f"o{i}" for i in range(orders)), "gone", "micros", *(f"v{i}" for i in range(values))]


class _Upserts(StatefulProcessor):
    """Of a key's rows in a batch only the last counts; it is told beside what the state held.

    A bucket's keys are one value of the store, a table in Arrow's format, so that a batch asks
    the store once a bucket and not several times a key.
    """

    def __init__(self, order: int, values: int, told: Sequence[str], buckets: int, keep: int | None) -> None:
        self.n, self.values, self.told, self.buckets, self.keep = order, values, list(told), buckets, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("keys", T.BinaryType())]))

    def _read(self) -> dict:
        """The bucket's rows by key: their order, removal, times of change and check, values."""
        got = self.held.get()
        if got is None:
            return {}
        told = pa.ipc.open_stream(bytes(got[0])).read_all()
        if told.schema.metadata[b"buckets"] != b"%d" % self.buckets:
            raise ValueError(f"the state has {told.schema.metadata[b'buckets'].decode()} buckets, not {self.buckets}")
        key, *rest = (c.to_pylist() for c in told.columns)
        return dict(zip(key, zip(*rest, strict=True), strict=True))

    def _write(self, held: dict) -> None:
        """Keeps the bucket's rows, and has the next tombstone's time told."""
        if not held:
            self.held.clear()
            return
        kinds = [None, *[pa.int64()] * self.n, pa.bool_(), pa.int64(), pa.int64(), *[pa.string()] * self.values]
        columns = [list(held), *(list(c) for c in zip(*held.values(), strict=True))]
        told = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[str(i) for i in range(len(columns))], metadata={"buckets": str(self.buckets)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, told.schema) as out:
            out.write_table(told)
        self.held.update((sink.getvalue().to_pybytes(),))
        ends = [self._end(h) for h in held.values() if self._end(h) is not None]
        if ends:
            self.handle.registerTimer(min(ends))

    def _end(self, held: tuple) -> int | None:
        """When a tombstone goes."""
        return held[self.n + 2] // 1000 + self.keep if self.keep is not None and held[self.n] and held[self.n + 2] is not None else None

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, best = self.n, {}
        for row in rows:
            k, *r = row[1 : n + self.values + 4]
            if k not in best or r[:n] > best[k][:n]:
                best[k] = r
        held, told, moved, made = self._read(), [], False, Row(*self.told)
        for k, r in best.items():
            order, gone, at, new, was = tuple(r[:n]), r[n], r[n + 1], tuple(r[n + 2 :]), held.get(k)
            if was is not None and order <= was[:n]:
                continue  # late or repeated
            alive = was is not None and not was[n]
            old, changed = (was[n + 3 :], was[n + 1]) if alive else ((None,) * len(new), None)
            action = ("removed" if alive else None) if gone else "created" if not alive else "same" if old == new else "updated"
            changed, left = at if action != "same" else changed, (None,) * len(new) if gone else new
            held[k], moved = (*order, gone, changed, at, *left), True
            if action:
                told.append(made(k, *order, action, changed, at, *left, *old))
        if moved:
            self._write(held)
        return iter(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Tombstones that have been kept for long enough go, unless their keys have come back."""
        now, held = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._read()
        if held:
            self._write({k: h for k, h in held.items() if self._end(h) is None or self._end(h) > now})
        return iter(())

    def close(self) -> None:
        pass


def upserts(changes: DataFrame, key: str, order: Sequence[str], values: Sequence[str], gone: str, at: str, delay: str | None = None, keep_ms: int | None = None, buckets: int = 1024) -> DataFrame:
    """(key, order, action, last_changed, last_checked, values, old values) of each key that a batch changes or confirms.

    `changes` is a stream of rows with `order`, whole numbers that must be total for a key, text
    `values`, a boolean column `gone` for removals and the time `at`.  Of a batch the last row of
    a key by order counts; it is 'created', 'updated', 'same' or 'removed' against the state, and
    the row before comes with it.  Rows not after the state's own are late or repeated and tell
    nothing; a removal leaves a tombstone, so that late rows don't bring a key back.  last_checked
    moves with every row that counts, last_changed only if the values do.

    With `delay`, times are watermarked and tombstones kept for `keep_ms` after the removal; rows
    later than the watermark are dropped by Spark then.  Null keys, orders and times: rows without
    a key or an order are ignored, a null time stays null.  Rows of a hot key are cut down to one
    a batch of Arrow before they are shuffled.

    Keys lie in `buckets` by their hash; a batch reads and writes the buckets of its keys, in
    memory one at a time.  Their number is fixed by a checkpoint's first run, an error tells of
    another; for hundreds of millions of keys ask for more of them, so that each holds some thousands.
    """
    names = _columns(len(order), len(values))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    columns = [F.col(key), *(F.col(c).cast("long") for c in order), F.coalesce(F.col(gone), F.lit(False)), micros, *(F.col(v).cast("string") for v in values)]
    own = changes.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), *([F.col(at).cast("timestamp").alias("ts")] if delay else []))
    own = own.filter(" AND ".join(f"{c} IS NOT NULL" for c in names[: len(order) + 1]))
    kind = own.schema["k"].dataType

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(names[1 : len(order) + 1]).drop_duplicates("k", keep="last")

    # A combiner would lose the watermark, so it is only put before streams without one.
    combined = own.withWatermark("ts", delay) if delay else own.mapInPandas(last, own.schema)
    dealt = combined.select(F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b"), *names, *(["ts"] if delay else []))
    longs = lambda *c: [T.StructField(x, T.LongType()) for x in c]
    texts = lambda *c: [T.StructField(x, T.StringType()) for x in c]
    out = T.StructType([T.StructField(key, kind), *longs(*order), *texts("action"), *longs("last_changed", "last_checked"), *texts(*values, *(f"old_{v}" for v in values))])
    told = dealt.groupBy("b").transformWithState(_Upserts(len(order), len(values), out.names, buckets, keep_ms), out, "Update", "EventTime" if delay else "None")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("last_changed", "last_checked")})


def run(told: DataFrame, path: str, checkpoint: str) -> None:
    """Runs such a stream to its present end; each batch's rows are a Parquet folder `batch=N` under `path`, written again as the same if it is repeated."""
    spark = told.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with store(spark):
        told.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
