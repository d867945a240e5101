"""Exact medians and median absolute deviations over sliding time windows.

A window is a run of a series' clicks in time order, so a counted binary trie over the cents'
bits, kept with one running count a level, knows every window's subtree counts as differences
of two running counts.  Descending the bits selects a median; counts below two bounds, taken
the same way, bisect the radius that holds half of the window.  Series are cut into chunks of
time with a halo of one window before each; a chunk of too many clicks is cut further, and
clicks that stay in the window for a whole such part reach it as counts by cents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, tidied

HOUR = 3_600_000_000
#: Cents beyond this would not leave room for the doubled deviations in 64 bits.
MOST = 1 << 58


class Trie:
    """A counted binary trie over the bits of `values` in their order, so that any run of them can be asked.

    A level holds, for each place of its order, how many places before it have a zero bit, and
    the weight of what goes to the zero and to the one side; subtrees of a run are runs again.
    """

    def __init__(self, values: np.ndarray, weights: np.ndarray | None) -> None:
        self.low = int(values.min()) if len(values) else 0
        rest = (values - self.low).astype(np.uint64)
        self.bits = int(rest.max()).bit_length() if len(rest) else 0
        self.top = self.low + (1 << self.bits)
        self.zeros: list[np.ndarray] = []
        self.held: list[np.ndarray | None] = [self._sums(weights)]
        for bit in range(self.bits - 1, -1, -1):
            one = (rest >> np.uint64(bit)) & np.uint64(1) == 1
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            order = np.r_[np.flatnonzero(~one), np.flatnonzero(one)]
            rest = rest[order]
            weights = None if weights is None else weights[order]
            self.held.append(self._sums(weights))

    @staticmethod
    def _sums(weights: np.ndarray | None) -> np.ndarray | None:
        return None if weights is None else np.r_[0, np.cumsum(weights)]

    def size(self, a: np.ndarray, b: np.ndarray, level: int = 0) -> np.ndarray:
        held = self.held[level]
        return (b - a).astype(np.int64) if held is None else held[b] - held[a]

    def select(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of each run a..b; k must be less than the run's size."""
        k, found = k.copy(), np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            n = self.size(za, zb, level + 1)
            one = k >= n
            base = zeros[-1]
            a, b = np.where(one, base + a - za, za), np.where(one, base + b - zb, zb)
            k -= np.where(one, n, 0)
            found = found << 1 | one
        return found + self.low

    def below(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The weight of the values under the bound in each run a..b."""
        high = bound >= self.top
        x = np.clip(bound - self.low, 0, (1 << self.bits) - 1).astype(np.int64)
        none, full, n = bound <= self.low, self.size(a, b), np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            za, zb = zeros[a], zeros[b]
            one = x >> (self.bits - 1 - level) & 1 == 1
            n += np.where(one, self.size(za, zb, level + 1), 0)
            base = zeros[-1]
            a, b = np.where(one, base + a - za, za), np.where(one, base + b - zb, zb)
        return np.where(high, full, np.where(none, 0, n))


def medians(trie: Trie, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, doubled median, doubled median of the doubled deviations from it) of each run; the last two need a size of 1."""
    n, median2, mad4 = trie.size(a, b), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    at = np.flatnonzero(n > 0)
    a, b, m = a[at], b[at], n[at]
    low, high = (m - 1) // 2, m // 2
    mid = trie.select(a, b, low) + trie.select(a, b, high)
    # Half of a run lies between its quartiles, so they bound the radius from above; from below, one of them does.
    p, q = mid - 2 * trie.select(a, b, low // 2), 2 * trie.select(a, b, m - 1 - low // 2) - mid
    lo, hi = np.zeros(len(a), np.int64), np.maximum(p, q)
    need = low + 1

    def within(i: np.ndarray, r: np.ndarray) -> np.ndarray:
        """How many of a run have |2 value - mid| <= r."""
        return trie.below(a[i], b[i], (mid[i] + r) // 2 + 1) - trie.below(a[i], b[i], -((r - mid[i]) // 2))

    i = np.arange(len(a))
    while len(i := i[lo[i] < hi[i]]):
        r = lo[i] + (hi[i] - lo[i]) // 2
        ok = within(i, r) >= need[i]
        hi[i] = np.where(ok, r, hi[i])
        lo[i] = np.where(ok, lo[i], r + 1)
    second = lo.copy()
    i = np.arange(len(a))
    i = i[(high > low)]
    i = i[within(i, lo[i]) <= high[i]]
    if len(i):  # the next larger deviation is that of the value just above or just below the radius
        above = trie.below(a[i], b[i], (mid[i] + lo[i]) // 2 + 1)
        under = trie.below(a[i], b[i], -((lo[i] - mid[i]) // 2))
        far = np.iinfo(np.int64).max
        up = np.where(above < m[i], 2 * trie.select(a[i], b[i], np.minimum(above, m[i] - 1)) - mid[i], far)
        down = np.where(under > 0, mid[i] - 2 * trie.select(a[i], b[i], np.maximum(under - 1, 0)), far)
        second[i] = np.minimum(up, down)
    median2[at], mad4[at] = mid, lo + second
    return n, median2, mad4


def _solve(part: np.ndarray, ts: np.ndarray, cents: np.ndarray, has: np.ndarray, weight: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(place, size, median2, mad4) of the own rows; rows come by part and time, those of a part's halo first."""
    first = np.r_[True, part[1:] != part[:-1]]
    since = ts - ts[first][np.cumsum(first) - 1]
    # Parts are laid one behind the other, further apart than any window reaches.
    length = np.maximum.reduceat(since, np.flatnonzero(first)) if len(ts) else since
    line = since + (np.r_[0, np.cumsum(length + 2 * width)[:-1]])[np.cumsum(first) - 1]
    held = np.flatnonzero(has)
    trie = Trie(cents[held], None if (weight[held] == 1).all() else weight[held])
    at = np.flatnonzero(own)
    a = np.searchsorted(line[held], line[at] - width, "right")
    b = np.searchsorted(line[held], line[at], "right")
    return at, *medians(trie, a, b)


def _work(width: int, rows: int):
    names = ["click_id", "kind", "n", "median2", "mad4", "far"]

    def told(batches: list[pa.RecordBatch], parts: list[np.ndarray]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        get = lambda c: t.column(c).to_numpy()
        has, c = t.column("cents").is_valid().to_numpy(), t.column("cents").fill_null(0).to_numpy()
        at, n, median2, mad4 = _solve(np.concatenate(parts), get("at"), c, has, get("weight"), get("own"), width)
        far = 2 * np.abs(2 * c[at] - median2) > 3 * mad4
        take = lambda c: t.column(c).take(pa.array(at)).combine_chunks()
        return pa.record_batch([take("click_id"), take("kind"), pa.array(n), pa.array(median2, mask=n < 2), pa.array(mad4, mask=n < 2), pa.array(far, mask=(n < 2) | ~has[at])], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole parts are gathered up to about `rows` rows; no part is ever spread over two answers."""
        held, parts, last, number = [], [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kind, slot, part = (batch.column(c) for c in ("kind", "slot", "part"))
            codes = kind.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            slots, subs = slot.to_numpy(), part.to_numpy()
            new = np.r_[(kind[0].as_py(), slots[0], subs[0]) != last, (codes[1:] != codes[:-1]) | (slots[1:] != slots[:-1]) | (subs[1:] != subs[:-1])]
            numbers = number + np.cumsum(new)
            number, last = int(numbers[-1]), (kind[-1].as_py(), slots[-1], subs[-1])
            at = 0
            for end in [*np.flatnonzero(new).tolist(), batch.num_rows]:
                if end < batch.num_rows and sum(map(len, parts)) + end - at >= rows or end == batch.num_rows:
                    if end > at:
                        held.append(batch.slice(at, end - at))
                        parts.append(numbers[at:end])
                        at = end
                    if held and end < batch.num_rows:
                        yield told(held, parts)
                        held, parts = [], []
        if held:
            yield told(held, parts)

    return work


def cents_of(value: Column) -> Column:
    """floor(100 value + 0.5); none where the value is null, not finite or of more than 2^58 cents."""
    return F.when(F.abs(value) < MOST / 100, F.floor(value * 100 + 0.5).cast("long"))


def micros_of(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 by the time as it is written; times without a zone are never put into one."""
    if dict(df.dtypes)[ts] == "timestamp":
        return F.unix_micros(F.col(ts))
    t = F.col(ts).cast("timestamp_ntz")
    minutes = (F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(t)) * 60 + F.minute(t)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def rolling(clicks: DataFrame, minutes: int = 60, chunk_minutes: int = 360, most: int = 1_000_000, rows: int = 100_000, id_col: str = "click_id", ts_col: str = "ts", kind_col: str = "kind", value_col: str = "value") -> DataFrame:
    """(click_id, kind, n, median2, mad4, far) of every click over its series' last `minutes`, its own time included.

    Chunks are `chunk_minutes` long, a multiple of the window; one that holds more than `most`
    rows with its halo is cut into parts down to a minute, so a series and an hour of any share
    are spread.  `rows` is how many a worker takes at once; results depend on none of these.

    Defined cases: of rows of one id that of the least (time, kind, value), nulls first, counts,
    and null ids are one id; rows without a time are dropped before; a null kind is a kind;
    values that are null, not finite or of more than 2^58 cents have no cents and no `far`;
    windows of less than two cents have no medians; equal times see each other; ties of cents
    all count; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    width, chunk = minutes * 60_000_000, chunk_minutes * 60_000_000
    if chunk % width:
        raise ValueError("chunks must be a multiple of the window")
    told = clicks.filter(F.col(ts_col).isNotNull()).select(F.col(id_col).alias("click_id"), F.struct(micros_of(clicks, ts_col).alias("at"), F.col(kind_col).cast("string").alias("kind"), cents_of(F.col(value_col).cast("double")).alias("cents")).alias("x"))
    once = cut(told.groupBy("click_id").agg(F.min("x").alias("x")).select("click_id", "x.*"))
    slot = F.expr(f"at div {chunk} - CAST(at % {chunk} < 0 AS INT)")
    placed = once.withColumn("first", slot)
    reaches = F.col("at") + width > (F.col("first") + 1) * chunk
    placed = placed.withColumn("slot", F.explode(F.when(reaches & F.col("cents").isNotNull(), F.array("first", F.col("first") + 1)).otherwise(F.array("first"))))
    start, schema = F.col("slot") * chunk, "click_id, kind, slot, part, at, cents, weight, own".split(", ")
    dense = cut(placed.groupBy("kind", "slot").agg(F.count("*").alias("c")).filter(F.col("c") > most))
    if dense.isEmpty():
        laid = placed.select("click_id", "kind", "slot", F.lit(0).alias("part"), "at", "cents", F.lit(1).cast("long").alias("weight"), (F.col("first") == F.col("slot")).alias("own"))
    else:
        key = F.struct(F.coalesce("kind", F.lit("")).alias("k"), F.col("kind").isNull().alias("none"), "slot")
        dense = dense.select(key.alias("key"), F.least(F.ceil(F.col("c") / most), F.lit(chunk_minutes)).cast("int").alias("parts"))
        cells = spread_join(placed.withColumn("key", key), dense, "key", "click_id", "left").drop("key")
        length = F.ceil(F.lit(chunk) / F.coalesce("parts", F.lit(1))).cast("long")
        cells = cells.withColumn("length", length).withColumn("mine", F.when(F.col("first") == F.col("slot"), ((F.col("at") - start) / F.col("length")).cast("int")))
        own = cells.filter("mine IS NOT NULL").select("click_id", "kind", "slot", F.col("mine").alias("part"), "at", "cents", F.lit(1).cast("long").alias("weight"), F.lit(True).alias("own"))
        # Later parts that begin while the click is in the window: it leaves in the last of them and stays through the others.
        low, high = F.coalesce(F.col("mine") + 1, F.lit(0)), F.least(F.ceil((F.col("at") + width - start) / F.col("length")) - 1, F.ceil(F.lit(chunk) / F.col("length")) - 1).cast("int")
        met = cells.filter("cents IS NOT NULL").withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("part", F.explode(F.sequence("low", "high")))
        begins = start + F.col("part") * F.col("length")
        stays = F.col("at") + width >= begins + F.col("length")
        leaving = met.filter(~stays).select(F.lit(None).cast(once.schema["click_id"].dataType).alias("click_id"), "kind", "slot", "part", "at", "cents", F.lit(1).cast("long").alias("weight"), F.lit(False).alias("own"))
        stay = met.filter(stays).groupBy("kind", "slot", "part", begins.alias("at"), "cents").agg(F.count("*").alias("weight")).select(F.lit(None).cast(once.schema["click_id"].dataType).alias("click_id"), "kind", "slot", "part", "at", "cents", "weight", F.lit(False).alias("own"))
        laid = own.unionByName(leaving).unionByName(stay)
    dealt = laid.select(schema).repartition("kind", "slot", "part").sortWithinPartitions("kind", "slot", "part", "at")
    kind = once.schema["click_id"].dataType.simpleString()
    return dealt.mapInArrow(tidied(_work(width, rows)), f"click_id {kind}, kind string, n long, median2 long, mad4 long, far boolean")


SQL = r"""
    WITH once AS (
      SELECT click_id, x.at AS at, x.kind AS kind, x.cents AS cents FROM (
        SELECT click_id, min({'at': epoch_us(ts), 'kind': kind, 'cents': CASE WHEN isfinite(value) THEN CAST(floor(100 * value + 0.5) AS bigint) END}) AS x
        FROM clicks WHERE ts IS NOT NULL GROUP BY click_id)),
    windows AS (
      SELECT a.click_id, a.kind, a.cents, list_sort(list(b.cents) FILTER (b.cents IS NOT NULL)) AS w
      FROM once a JOIN once b ON a.kind IS NOT DISTINCT FROM b.kind AND b.at > a.at - 3600000000 AND b.at <= a.at
      GROUP BY a.click_id, a.kind, a.cents),
    middle AS (SELECT *, coalesce(len(w), 0) AS n, w[(len(w) + 1) // 2] + w[len(w) // 2 + 1] AS m FROM windows),
    away AS (SELECT *, list_sort(list_transform(w, lambda v: abs(2 * v - m))) AS d FROM middle),
    spread AS (SELECT *, d[(n + 1) // 2] + d[n // 2 + 1] AS mad FROM away)
    SELECT click_id, kind, n, CASE WHEN n >= 2 THEN m END AS median2, CASE WHEN n >= 2 THEN mad END AS mad4,
           CASE WHEN n >= 2 AND cents IS NOT NULL THEN 2 * abs(2 * cents - m) > 3 * mad END AS far
    FROM spread"""
