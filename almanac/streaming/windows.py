"""Event-time windows: alarms over consecutive periods, rate limits, sessions; batch and streaming alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, every: str, *aggs: Column, keys: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """Aggregates per window of `every`; with `late`, events behind that watermark are dropped from streams."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.window(ts, every), *keys).agg(*aggs).withColumn("start", F.col("window.start")).drop("window")


def alarms(periods: DataFrame, start: str, measure: str, threshold: float, minutes: int, consecutive: int = 3) -> DataFrame:
    """The periods that end `consecutive` adjoining periods whose measure breaches the threshold.

    Each breach counts for its own period and those that follow; a period that as many count for
    as are asked ends such a run.  No order is needed, so no task sees all periods.
    """
    slot = (F.unix_timestamp(start) / (60 * minutes)).cast("long")
    bad = periods.filter(F.col(measure) > threshold).withColumn("_slot", slot)
    reached = bad.select("_slot").distinct().select(F.explode(F.sequence(F.col("_slot"), F.col("_slot") + (consecutive - 1))).alias("_slot"))
    ends = reached.groupBy("_slot").agg(F.count("*").alias("_n")).filter(F.col("_n") == consecutive)
    return bad.join(ends.select("_slot"), "_slot", "left_semi").drop("_slot")


def rate_limited(df: DataFrame, ts: str, key: str, width: str, slide: str, limit: int) -> DataFrame:
    """(key, start, n) of sliding windows in which a key exceeds its limit."""
    counts = df.groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > limit).select(key, F.col("window.start").alias("start"), "n")


def marked(df: DataFrame, ts: str, text: str, markers: tuple[str, ...], every: str) -> DataFrame:
    """(start, n): rows per period whose text holds one of the markers."""
    pattern = "|".join(rf"\Q{m}\E" for m in markers)
    return tumbling(df.filter(F.col(text).rlike(pattern)), ts, every, F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, stop, n) of runs of events with no pause as long as the gap."""
    rows = df.withWatermark(ts, late) if late else df
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def stream_alarms(events: DataFrame, ts: str, measure: Column, threshold: float, minutes: int, delay: str, id_col: str | None = None, consecutive: int = 3) -> DataFrame:
    """(start, total): the periods of a stream that end `consecutive` adjoining ones whose sum breaches the threshold.

    Windows over windows: the sums of periods are final once the watermark has passed them, and
    go as events of their own time into longer sliding windows that count breaches.  Rows later
    than `delay` are dropped, and so are rows whose `id_col` has come within it already; rows
    without a time have no period, rows without a measure add nothing.  Append mode tells each
    alarm once, when no row that counts can change it any more.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)  # watermarks know no times without a zone
    if id_col:
        rows = rows.dropDuplicatesWithinWatermark([id_col])
    period, reach = f"{minutes} minutes", f"{minutes * consecutive} minutes"
    sums = rows.groupBy(F.window(ts, period)).agg(F.sum(measure).alias("total"))
    breaches = sums.filter(F.col("total") > threshold).select(F.window_time("window").alias("at"), F.col("window.start").alias("start"), "total")
    last = F.max(F.struct("start", "total")).alias("last")
    runs = breaches.groupBy(F.window("at", reach, period).alias("run")).agg(F.count("*").alias("n"), last)
    return runs.filter(F.col("n") == consecutive).select("last.start", "last.total")
