"""Ordered operators: ranks, picks by order, fills, prefixes and limits.

Every order is made total by an explicit tiebreak, since Spark has no input order to fall back on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.plans.registry import kept

Keys = Sequence[Column | str]


def top_k(df: DataFrame, measure: str, k: int, tiebreak: Keys, positive: str = "before", rank: str | None = "rank") -> DataFrame:
    """The k rows of largest measure.

    `positive` drops measures of zero and below 'before' the limit (O2), 'after' it (O3, which
    may leave fewer than k rows) or not at all ('no', O1).  The limit is per partition first,
    so at most k rows a task are merged, and ranks (W1) are counted over those k rows only.
    """
    rows = df.filter(F.col(measure) > 0) if positive == "before" else df
    rows = rows.orderBy(F.desc(measure), *tiebreak).limit(k)
    if rank:
        rows = rows.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(measure), *tiebreak)).cast("long"))
    return rows.filter(F.col(measure) > 0) if positive == "after" else rows


#: A row's place in its task is the lower part of its id, the task's number the upper one.
_PLACE = 33


def total_rank(df: DataFrame, order: Keys, rank: str = "rank") -> DataFrame:
    """Every row's number from 1 by an order that is total, over tables of any size.

    Tasks get ranges of the order and number their own rows; how many rows are before a task's
    is summed up over the tasks.  No task sees more than its range.
    """
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftrightunsigned("_id", _PLACE)
    sizes = sorted(tuple(r) for r in dealt.groupBy(task.alias("t")).count().collect())  # a row a task
    before, rows = [], 0
    for t, n in sizes:
        before.append((t, rows))
        rows += n
    starts = df.sparkSession.createDataFrame(before, "_task long, _before long")
    numbered = dealt.withColumn("_task", task).join(F.broadcast(starts), "_task")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << _PLACE) - 1) + 1).alias(rank))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], tiebreak: Keys, time: str | None = None) -> DataFrame:
    """Left join of each row to the last row of its key on the right that isn't later (the captain of the latest line-up).

    `values` come from the right, with its time as `time` if wanted; of equal times the last by
    `tiebreak`, which must be total then.  Rows without a key or a time find nothing.  Both sides
    are laid out by key and time in ranges; a key that goes over many tasks hands its last row
    on, one row a task at most, so hot keys cost no more than others.
    """
    found = F.struct(*(F.col(v).alias(v) for v in values), F.col(right_time).alias("_at"))
    tie = F.struct(*tiebreak) if tiebreak else F.struct(F.lit(0).alias("t"))
    told = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), tie.alias("_tie"), found.alias("_found"))
    once = told.groupBy("_k", "_t").agg(F.max_by("_found", "_tie").alias("_found"))
    rows = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.struct(*(F.col(f"`{c}`").alias(c) for c in left.columns)).alias("_row"))
    open_ = F.col("_k").isNull() | F.col("_t").isNull()
    both = once.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows.filter(~open_).withColumn("_found", F.lit(None).cast(once.schema["_found"].dataType)))
    both = both.withColumn("_mine", F.col("_row").isNotNull().cast("int"))
    # Rows of one key and time may be cut apart too, so a key's order goes on by a hash.
    both = both.withColumn("_n", F.when(F.col("_mine") == 1, F.xxhash64("_row")).otherwise(0))
    dealt = kept(both.repartitionByRange("_k", "_t", "_mine", "_n").withColumn("_task", F.spark_partition_id()))
    last = dealt.filter("_mine = 0").groupBy("_task", "_k").agg(F.max_by("_found", "_t").alias("_last"))
    spans = dealt.select("_task", "_k").distinct()
    # Only the keys at a task's border are in more than one; of those, what the tasks before have last.
    shared = spans.join(spans.groupBy("_k").agg(F.count("*").alias("c")).filter("c > 1"), "_k").join(last, ["_task", "_k"], "left")
    earlier = Window.partitionBy("_k").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    handed = shared.select("_task", "_k", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
    here = Window.partitionBy("_task", "_k").orderBy("_t", "_mine").rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("_met", F.last("_found", ignorenulls=True).over(here)).filter("_mine = 1").join(F.broadcast(handed), ["_task", "_k"], "left")
    out = met.select("_row", F.coalesce("_met", "_handed").alias("_f")).unionByName(rows.filter(open_).select("_row", F.lit(None).cast(once.schema["_found"].dataType).alias("_f")))
    return out.select("_row.*", *(F.col(f"_f.{v}").alias(v) for v in values), *([F.col("_f._at").alias(time)] if time else []))


def top_k_per(df: DataFrame, keys: Keys, measure: str, k: int, tiebreak: Keys, rank: str = "rank") -> DataFrame:
    """The k rows of largest measure of each key; Spark prunes per task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.desc(measure), *tiebreak)
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def pick(df: DataFrame, keys: Sequence[str], order: Keys, last: bool = True) -> DataFrame:
    """One row per key: the last by an order (W2, latest wins) or the first.

    An aggregate rather than a window: it combines before its shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    whole, by = F.struct(*rest), F.struct(*order)
    best = F.max_by(whole, by) if last else F.min_by(whole, by)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def forward_fill(df: DataFrame, keys: Keys, order: Keys, column: str, out: str) -> DataFrame:
    """The latest non-null value up to each row."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(frame))


def populated_prefix(df: DataFrame, order: str, measure: str, least: int) -> DataFrame:
    """The rows before the first, by order, whose measure is under `least` (W6); null measures are."""
    gap = df.filter(F.coalesce(F.col(measure) < least, F.lit(True))).agg(F.min(order)).scalar()
    return df.filter(gap.isNull() | (F.col(order) < gap))


def newest_populated(df: DataFrame, order: str, measure: str, least: int):
    """The last of the unbroken run of well filled periods (W6); ValueError where even the first isn't."""
    found = populated_prefix(df, order, measure, least).agg(F.max(order)).first()[0]
    if found is None:
        raise ValueError(f"no period has {least} of {measure} before a gap")
    return found


def by_locale(df: DataFrame, column: str, *tiebreak: Column | str, locale: str = "he") -> DataFrame:
    """Rows in a language's own order of words (O10), then by the tiebreaks."""
    return df.orderBy(F.collate(F.col(column), locale), *tiebreak)


def priority_pick(df: DataFrame, keys: Sequence[str], rank: str, source_order: str) -> DataFrame:
    """Of each key the row of highest rank; of equals the earliest source stays."""
    return pick(df, keys, [F.col(rank), -F.col(source_order)])


def most_recent_used(df: DataFrame, owner: str, item: str, when: str, cap: int = 5) -> DataFrame:
    """(owner, items): distinct items, newest first, no more than the feature's `cap`."""
    once = df.groupBy(owner, item).agg(F.max(when).alias("_at"))
    kept = top_k_per(once, [owner], "_at", cap, [item], "_r")
    items = F.array_sort(F.collect_list(F.struct("_r", item)))
    return kept.groupBy(owner).agg(F.transform(items, lambda x: x[item]).alias("items"))
