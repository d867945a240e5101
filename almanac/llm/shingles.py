"""Near copies by the Jaccard similarity of their word shingles.

Minima of a set's members under random orders estimate the similarity of sets (Broder 1997), and
sets that agree in all minima of a band are candidates.  With the default bands a pair at
similarity 0.8 shares none with probability 0.000003; each candidate is checked on whole sets.
Likely pairs are checked first, by joins; all others of a band inside the block that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, cut, row_key, small_side, spread_join, tidied

#: Bands of minima, and minima in each.
BANDS, ROWS = 32, 5
#: Members whose minima are taken at once, so that memory stays bounded for any text length.
CHUNK = 1 << 12


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, ASCII capitals as small letters; bytes know ASCII letters and white space only."""
    return (text or "").encode().lower().split()


class Words(dict):
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, keep: int = 1 << 17) -> None:
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingler(width: int = 5) -> Callable[[str | None], np.ndarray]:
    """A function that gives the distinct shingles of a whole text as sorted 64-bit hashes.

    ASCII capitals count as small letters.  A text of fewer than `width` words has one shingle,
    of all its words; one without words has none.
    """
    memo = Words()

    def shingles(text: str | None) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(w) - width + 1)
        h = np.full(n, min(width, len(w)), np.uint64)
        for i in range(min(width, len(w))):
            h = (h ^ w[i : i + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)

    return shingles


def sketcher(minima: int = BANDS * ROWS, seed: int = 7) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the minima of a set of hashes under so many orders, 32 bits each."""
    by = np.random.default_rng(seed).integers(0, 1 << 63, minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(members: np.ndarray) -> np.ndarray:
        low = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(members), CHUNK):
            np.minimum(low, (by[:, None] * members[None, i : i + CHUNK]).min(axis=1), out=low)
        return (low >> np.uint64(32)).astype("<u4")

    return sketch


def described(docs: DataFrame, id_col: str, text_col: str, width: int, print_: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, key, cls, n, fp, sketch): cls names the set of a text's n shingles, fp is what `print_` makes of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketch = shingler(width), sketcher()
        for batch in batches:
            cls, n, fp, low = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                n.append(len(s))
                fp.append(print_(s))
                low.append(sketch(s).tobytes())
            made = [pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "key", "cls", "n", "fp", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, key string, cls binary, n long, fp long, sketch binary")


def banded(classes: DataFrame) -> DataFrame:
    """(band, t, node, pivot) of all classes (node, sketch) that share the minima of band number t with another."""
    minima = f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {4 * ROWS} + 1, {4 * ROWS})))"
    placed = classes.select("node", F.posexplode(F.expr(minima)).alias("t", "band"))
    shared = cut(placed.groupBy("band").agg(F.count("*").alias("many"), F.min("node").alias("pivot")).filter("many > 1"))
    counts = shared.select("band", F.col("many").alias("_rows"))
    return spread_join(placed, shared.drop("many"), "band", "node", counts=counts).select("band", "t", "node", "pivot")


def of_nodes(texts: DataFrame, keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of each class asked for; texts are (key, text) and keys (key, node).  Other texts stay in place."""
    wanted = cut(keys.join(nodes.select("node").distinct(), "node", "left_semi").select("key", "node"))
    return texts.join(small_side(wanted), "key").groupBy("node").agg(F.first("text").alias("text"))


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both) - 1e-9


def checked(pairs: DataFrame, texts: DataFrame, keys: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets reach the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, q = shingler(width), None, None
        for batch in batches:
            ok = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                p = shingles(x.as_py())
                if b != last:  # joins leave rows of one end together
                    last, q = b, shingles(y.as_py())
                ok.append(alike(p, q, similarity))
            mask = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    own = of_nodes(texts, keys, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    of = lambda end: own.select(F.col("node").alias(end), F.col("text").alias(f"t{end}"))
    met = spread_join(spread_join(pairs, of("a"), "a", "b"), of("b"), "b", "a")
    return met.select("a", "b", "ta", "tb").mapInArrow(tidied(work), "a long, b long")


def _cells(live: DataFrame, size: int) -> DataFrame:
    """(block, first, alone, t, node, component): each band's members in cells, once for every pair of its cells.

    Components of over `size` members have cells of their own, and pairs of cells of one
    component are left out, so a family of copies of any size meets only what isn't in it.
    Blocks are named by all that makes them, so no two share a name.
    """
    live = live.withColumn("part_of", F.concat_ws(":", "band", "component"))
    parts = live.groupBy("part_of", "band", "component").agg(F.count("*").alias("c"))
    total = parts.groupBy("band").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") <= size, F.col("c")).otherwise(0)).alias("mixed"))
    parts = cut(parts.join(total, "band"))
    big = cut(parts.filter(F.col("total") > size))
    columns = [F.col("t"), F.col("node"), F.col("component")]
    large = cut(big.select("band").distinct())
    few = live.join(large, "band", "left_anti").select(F.col("band").cast("string").alias("block"), F.lit(True).alias("first"), F.lit(True).alias("alone"), *columns)
    if large.isEmpty():
        return few
    room = F.when(F.col("c") > size, F.ceil(F.col("c") / size)).otherwise(F.ceil(F.col("mixed") / size)).cast("int")
    known = big.select("part_of", F.when(F.col("c") > size, F.col("component")).alias("whose"), room.alias("room"))
    counts = big.select("part_of", F.col("c").alias("_rows"))
    dealt = spread_join(live, known, "part_of", "node", counts=counts)
    by = F.when(F.col("whose").isNull(), F.col("component")).otherwise(F.col("node"))
    cell = F.concat_ws(".", F.coalesce("whose", F.lit(-1)), F.pmod(F.xxhash64(by), F.col("room")))
    dealt = dealt.select("band", F.coalesce("whose", F.lit(-1)).alias("whose"), cell.alias("cell"), F.concat_ws(":", "band", cell).alias("place"), *columns)
    dealt = cut(dealt)
    cells = cut(dealt.groupBy("band", "whose", "cell", "place").agg(F.count("*").alias("_rows")))
    others = cells.select("band", F.col("whose").alias("of"), F.col("cell").alias("other"), F.col("place").alias("there"))
    pairs = cells.join(others, "band").filter("cell <= other AND NOT (whose >= 0 AND whose = of)")
    pairs = cut(pairs.select("place", "there", F.concat_ws(":", "place", "other").alias("block"), (F.col("cell") == F.col("other")).alias("alone")))
    sides = pairs.select("place", F.struct("block", F.lit(True).alias("first"), "alone").alias("x"))
    sides = sides.unionByName(pairs.filter("NOT alone").select(F.col("there").alias("place"), F.struct("block", F.lit(False).alias("first"), "alone").alias("x")))
    sides = sides.groupBy("place").agg(F.collect_list("x").alias("xs"))  # as many as a band has cells
    met = spread_join(dealt, sides, "place", "node", counts=cells.select("place", "_rows"))
    return few.unionByName(met.select(F.explode("xs").alias("x"), *columns).select("x.*", *columns))


#: Columns of a block's rows beside its name.
BESIDE = ["node", "component", "t", "first", "alone"]


def _blocks(solve: Callable, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hands block after block to `solve`: its name, the columns BESIDE, and as many binary columns as told."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            if sum(h.num_rows for h in held) > 1:
                table = pa.Table.from_batches(held)
                beside = [table.column(i).to_numpy() for i in range(1, 1 + len(BESIDE))]
                yield from solve(table.column(0)[0].as_py(), *beside, *([v.as_buffer() for v in table.column(1 + len(BESIDE) + i)] for i in range(columns)))

        for batch in batches:
            if not batch.num_rows:
                continue
            block = batch.column(0).to_numpy(zero_copy_only=False)
            edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)].tolist()
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if held and block[x] != held[0].column(0)[0].as_py():
                    yield from told()
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield from told()

    return tidied(work)


def _likely(least: float, component: np.ndarray, t: np.ndarray, first: np.ndarray, alone: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(share, i, j) of a block's pairs of different components whose minima agree in a share of `least` or more, some at a time."""
    rows, others = (np.arange(len(t)),) * 2 if alone[0] else (np.flatnonzero(first), np.flatnonzero(~first))
    step = max(1, (1 << 13) // max(1, len(others)))
    for k in range(0, len(rows), step):
        p, q = (x.ravel() for x in np.meshgrid(rows[k : k + step], others, indexing="ij"))
        ok = (component[p] != component[q]) & (t[p] == t[q])
        if alone[0]:
            ok &= p < q
        p, q = p[ok], q[ok]
        same = sketch[p] == sketch[q]
        share = same.mean(axis=1)
        near = share >= least
        p, q, share, same = p[near], q[near], share[near], same[near]
        here = same.reshape(len(p), BANDS, ROWS).all(axis=2).argmax(axis=1) == t[p]
        if here.any():
            yield share[here], p[here], q[here]


def _sketches(rows: list[pa.Buffer]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<u4").reshape(len(rows), -1)


def across(live: DataFrame, sketches: DataFrame, texts: DataFrame, keys: DataFrame, width: int, similarity: float, size: int = 4096) -> DataFrame:
    """(a, b): a forest, block by block, over the links between classes of a band and of different components.

    A pair counts in the first band that it shares.  Minima that agree in a share lower by 4.7
    standard errors and more rule it out.  So blocks are gone through twice: sketches, of 640
    bytes whatever the text, tell who has a likely partner there, and only those send their whole
    sets.  What is left is checked on them, likely pairs first, and not where links found before
    have joined the two already.  No pair leaves a worker that isn't needed, however many there are.
    """
    least = similarity - 4.7 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(width)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                yield pa.record_batch([part.column(0), pa.array([shingles(x.as_py()).tobytes() for x in part.column(1)], pa.binary())], names=["node", "grams"])

    def sieve(block, node, component, t, first, alone, sketch) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(len(node), bool)
        for _, p, q in _likely(least, component, t, first, alone, _sketches(sketch)):
            wanted[p] = wanted[q] = True
        if wanted.any():
            columns = [pa.array(x[wanted]) for x in (node, component, t, first, alone)]
            yield pa.record_batch([pa.array([block] * int(wanted.sum()), pa.string()), *columns], names=["block", *BESIDE])

    def solve(block, node, component, t, first, alone, sketch, grams) -> Iterator[pa.RecordBatch]:
        root = {c: c for c in component.tolist()}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links, sets = [], [np.frombuffer(x, np.uint64) for x in grams]
        for share, p, q in _likely(least, component, t, first, alone, _sketches(sketch)):
            order = np.argsort(-share, kind="stable")
            for i, j in zip(p[order].tolist(), q[order].tolist(), strict=True):
                a, b = top(int(component[i])), top(int(component[j]))
                if a != b and alike(sets[i], sets[j], similarity):
                    root[a] = b
                    links.append((int(node[i]), int(node[j])))
        if links:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("block").sortWithinPartitions("block")

    give_back = Scratch(live.sparkSession).release
    beside = "node long, component long, t int, first boolean, alone boolean"
    cells = _cells(live, size)
    open_ = cut(in_blocks(cells.join(sketches, "node").select("block", *BESIDE, "sketch")).mapInArrow(_blocks(sieve, 1), f"block string, {beside}"))
    give_back()
    sets = cut(of_nodes(texts, keys, open_).mapInArrow(tidied(made), "node long, grams binary"))
    give_back()
    rows = open_.join(sketches, "node").join(sets, "node").select("block", *BESIDE, "sketch", "grams")
    return in_blocks(rows).mapInArrow(_blocks(solve, 2), "a long, b long")


def grouped(classes: DataFrame, hints: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, component) of classes (node, key, n, sketch) linked at the similarity; `hints` are likely pairs (a, b).

    The hints, and for each class the pivot that it meets in most bands, are checked first,
    which joins large families in few pairs; then every pair of a band across the components
    found so far is checked, so no link that a band shows is lost.
    """
    keys, worded = classes.select("key", "node"), classes.filter("n > 0")
    give_back = Scratch(classes.sparkSession).release  # shuffle files of what has been cut
    shared = cut(banded(worded))
    give_back()
    met = shared.filter("node <> pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max(F.struct("count", "pivot")).alias("x"))
    first = met.select(F.col("x.pivot").alias("a"), F.col("node").alias("b")).unionByName(hints.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    first = cut(first)
    links = cut(checked(first, texts, keys, width, similarity))
    give_back()
    parts = cut(connected_components(links))
    give_back()
    live = shared.select("band", "t", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = live.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band")
    live = cut(spread_join(live, mixed, "band", "node", "left_semi"))
    give_back()
    found = cut(across(live, worded.select("node", "sketch"), texts, keys, width, similarity))
    return parts if found.isEmpty() else cut(connected_components(links.unionByName(found)))
