"""Services asked in batches: split where an answer is cut short, tried again where one fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ask = Callable[[list[str]], list[str | None]]


class Truncated(Exception):
    """An answer to a batch was cut short."""


def answered(keys: list[str], ask: Ask, attempts: int = 3, wait: float = 1.0) -> list[str | None]:
    """The answers to a batch, in its order.

    A batch whose answer is cut short is halved until it fits; a single key whose answer is
    still cut short has none (T10).  Other failures are tried again, each time after twice the
    wait; the last one is raised (T9).
    """
    done: list[str | None] = []
    open_ = [keys] if keys else []
    while open_:
        batch = open_.pop()
        for attempt in range(attempts):
            try:
                got = ask(batch)
                if len(got) != len(batch):
                    raise Truncated(f"{len(got)} answers to {len(batch)} keys")
                done += got
                break
            except Truncated:
                half = len(batch) // 2
                if half:
                    open_ += [batch[half:], batch[:half]]
                else:
                    done.append(None)
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
                time.sleep(wait * 2**attempt)
    return done


def translated(keys: DataFrame, make: Callable[[], Ask], key: str = "en", size: int = 50, attempts: int = 3, wait: float = 1.0, workers: int = 2) -> DataFrame:
    """(key, he) of distinct keys, by a service that each of `workers` tasks makes once and asks `size` keys at a time.

    The result is a backend table of dictionaries; materialise it, since each evaluation asks anew.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()
        for batch in batches:
            names = batch.column(0).to_pylist()
            got = [x for i in range(0, len(names), size) for x in answered(names[i : i + size], ask, attempts, wait)]
            yield pa.record_batch([batch.column(0), pa.array(got, pa.string())], names=[key, "he"])

    rows = keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct().repartition(workers, key)
    return rows.mapInArrow(work, f"`{key}` string, he string")
