"""SimHash fingerprints and near-duplicate groups by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import connected_components, cut, local_forest, one_of_each, row_key, rows_of
from .fold import with_columns

#: Shingles whose bits are counted at once, so that memory stays bounded for any text length.
CHUNK = 1 << 14


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text: bit set if set in over half of its shingles' XXH64 values."""
    words = shingles.words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = map(b" ".join, zip(*(words[i : i + n] if i + width > len(words) else words[i:] for i in range(min(width, len(words)))), strict=False))
    ones, left = np.zeros(64, np.int64), n
    while left > 0:
        take = min(CHUNK, left)
        h = np.fromiter(map(xxhash.xxh64_intdigest, (x for x, _ in zip(joined, range(take), strict=False)), repeat(seed)), np.uint64, take)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(take, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= take
    return int(sum(1 << int(i) for i in np.flatnonzero(ones * 2 > n)))


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of 64-bit hashes as a signed long: a bit is set if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


# --- the trie self-join -------------------------------------------------------------------


def trie_pairs(v: np.ndarray, starts: np.ndarray, fixed: np.ndarray, budget: int, leaf: int = 16, frontier: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `budget` bits apart within each bucket of distinct sorted 64-bit values.

    A trie node is a range of the sorted array whose values share their top bits.  Pairs of
    nodes descend together, one bit at a time; a pair of children of unlike bits spends one
    bit of the budget, and pairs that overspend are dropped with all that is below them.
    Small pairs of nodes end in direct comparison.  `starts` delimits the buckets and `fixed`
    gives the number of top bits that a bucket's values share, where its root stands.
    """
    lo, hi = starts[:-1], starts[1:]
    keep = hi - lo > 1
    roots = np.stack([lo, hi, lo, hi, fixed, np.zeros_like(lo)])[:, keep].astype(np.int64)
    stack = [roots[:, i : i + frontier] for i in range(0, roots.shape[1], frontier)]
    while stack:
        al, ah, bl, bh, depth, spent = stack.pop()
        same = al == bl
        done = ((ah - al) * (bh - bl) <= leaf) | (depth >= 64)
        if done.any():
            i, j = _leaves(al[done], ah[done], bl[done], bh[done])
            near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
            if near.any():
                yield i[near], j[near]
        al, ah, bl, bh, depth, spent, same = (x[~done] for x in (al, ah, bl, bh, depth, spent, same))
        if not len(al):
            continue
        am, bm = _middle(v, al, ah, depth), _middle(v, bl, bh, depth)
        pairs = [
            (al, am, bl, bm, 0, None),
            (am, ah, bm, bh, 0, None),
            (al, am, bm, bh, 1, None),
            (am, ah, bl, bm, 1, ~same),  # of a node with itself, the mirror of the pair above
        ]
        nxt = []
        for w, x, y, z, cost, only in pairs:
            ok = (w < x) & (y < z) & (spent + cost <= budget) & ~((w == y) & (x - w == 1))
            if only is not None:
                ok &= only
            if ok.any():
                nxt.append(np.stack([w, x, y, z, depth + 1, spent + cost])[:, ok])
        if nxt:
            new = np.concatenate(nxt, axis=1)
            stack += [new[:, i : i + frontier] for i in range(0, new.shape[1], frontier)]


def _middle(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First index of [lo, hi) whose bit at `depth` (0: the top) is set, by bisection of all ranges at once."""
    lo, hi, bit = lo.copy(), hi.copy(), (63 - depth).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        one = (v[np.minimum(mid, len(v) - 1)] >> bit) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _leaves(al, ah, bl, bh) -> tuple[np.ndarray, np.ndarray]:
    na, nb = ah - al, bh - bl
    size = na * nb
    at = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return al[at] + k // nb[at], bl[at] + k % nb[at]


def _links(budget: int, chunk: int):
    """mapInArrow: rows (path, fixed, v, fp) sorted by bucket and v -> forest edges (a, b) of fingerprints."""

    def solve(path, fixed, v, fp):
        v, fixed = v.view(np.uint64), fixed.astype(np.int64)
        prefix = v >> (64 - fixed).astype(np.uint64)
        new = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (prefix[1:] != prefix[:-1])])
        starts = np.r_[new, len(v)]
        root, held, n = np.arange(len(v)), [], 0
        for pair in trie_pairs(v, starts, fixed[new], budget):
            held.append(pair)
            n += len(pair[0])
            if n > 1 << 19:  # only a forest is kept, however many pairs there are
                root, held, n = local_forest(*(np.concatenate(x) for x in zip(*held, strict=True)), root), [], 0
        if held:
            root = local_forest(*(np.concatenate(x) for x in zip(*held, strict=True)), root)
        at = np.flatnonzero(root != np.arange(len(v)))
        if not len(at):
            return None
        return pa.record_batch([pa.array(fp[at]), pa.array(fp[root[at]])], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            kept = [np.r_[x, batch.column(i).to_numpy(zero_copy_only=False)] for i, x in enumerate(kept)]
            if len(kept[0]) < chunk:
                continue
            path, fixed, v = kept[:3]
            prefix = v.view(np.uint64) >> (64 - fixed).astype(np.uint64)
            last = np.flatnonzero((path != path[-1]) | (prefix != prefix[-1]))
            end = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if end and (out := solve(*(x[:end] for x in kept))) is not None:
                yield out
            kept = [x[end:] for x in kept]
        if len(kept[0]) and (out := solve(*kept)) is not None:
            yield out

    return work


def _children(rows: DataFrame, n: int) -> DataFrame:
    """Each (path, fixed, v, fp) once for each of `n` blocks of its free bits, that block turned to the front and then fixed.

    `fixed` top bits of v are settled already; the path tells which blocks were, and in what order.
    """
    free = "64 - fixed"
    made = F.expr(f"""transform(sequence(0, {n - 1}), i -> named_struct('i', i, 'at', cast(i * ({free}) div {n} as int), 'next', cast((i + 1) * ({free}) div {n} as int)))""")
    each = rows.select("path", "fixed", "v", "fp", F.explode(made).alias("x")).select("path", "fixed", "v", "fp", "x.*")
    low = "shiftrightunsigned(-1L, fixed)"  # the free bits
    part = f"(v & {low})"
    # A shift by 64 is none in the engine, which is what the first block needs.
    turned = f"((shiftleft({part}, at) | shiftrightunsigned({part}, {free} - at)) & {low}) | (v & ~{low})"
    return each.select(F.expr(f"path * {n} + i + 1").alias("path"), F.expr("fixed + next - at").alias("fixed"), F.expr(turned).alias("v"), "fp")


def near_edges(fps: DataFrame, budget: int = 2, hot: int = 512, levels: int = 4, chunk: int = 1 << 18) -> DataFrame:
    """Edges (a, b) whose closure joins all distinct fingerprints at most `budget` bits apart.

    Of budget + 1 blocks of bits one must agree between two such fingerprints, so every
    fingerprint goes to one bucket per block, below a trie root whose path spells that block
    first.  Buckets of more than `hot` fingerprints are split in the same way on their free
    bits, up to `levels` times (with a budget of 2, after four at most 2^13 values can share a
    bucket), so a family of near copies of any size is dealt over many tasks and no pair is lost.
    """
    n = budget + 1
    root = fps.select(F.lit(0).cast("long").alias("path"), F.lit(0).alias("fixed"), F.col("fp").alias("v"), "fp")
    bucket = F.expr("shiftrightunsigned(v, 64 - fixed)")
    rows, ready = _children(root, n).withColumn("bucket", bucket), None
    for level in range(levels):
        if level < levels - 1:
            rows = cut(rows)
            heavy = cut(rows.groupBy("path", "bucket").count().filter(F.col("count") > hot).select("path", "bucket"))
        if level == levels - 1 or heavy.isEmpty():
            ready = rows if ready is None else ready.unionByName(rows)
            break
        calm = rows.join(heavy, ["path", "bucket"], "left_anti")
        ready = calm if ready is None else ready.unionByName(calm)
        rows = _children(rows.join(heavy, ["path", "bucket"], "left_semi"), n).withColumn("bucket", bucket)
    dealt = ready.repartition("path", "bucket").sortWithinPartitions("path", "v")  # in a bucket the top bit is one, so signed order will do
    return dealt.select("path", "fixed", "v", "fp").mapInArrow(_links(budget, chunk), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, hot: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Defined cases: null text = empty text = fingerprint zero, and zero links like any other
    value; repeated rows come back once each; a null id is never the name of a component, and a
    component with null ids only has a null component_id; an empty table gives no rows.
    """
    rows, by_fp = _grouped(docs, id_col, text_col, width, budget, hot)
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, budget: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every document; and (fp, component, component_id), a component named by its least fingerprint."""
    rows = cut(fingerprints(docs, id_col, text_col, width))
    return rows, _components(rows, budget, hot)


def _components(rows: DataFrame, budget: int, hot: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint of (doc_id, fp)."""
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_edges(classes, budget, hot))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select(classes["fp"], "least", F.coalesce("component", classes["fp"]).alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def _printed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, fp): every document with its row's key and fingerprint."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    made = with_columns(keyed, "text", lambda: lambda t: ((fp := fingerprint(t, width)) - (fp >> 63 << 64),), [("fp", "long")])
    return made.select("doc_id", "key", "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, hot: int = 512, similarity: float | None = None) -> DataFrame:
    """One document of each group, all columns kept: that of the smallest id.

    Without `similarity`, groups are those of fingerprints.  With it, two documents link if the
    Jaccard similarity of their sets of shingles reaches it: what the trie links is checked on
    whole sets first, and then the pairs that bands of minima show, since sets of similarity 0.8
    have fingerprints some ten bits apart, which no trie over 64 bits can tell from chance.

    Of repeated rows one stays; rows of one id and unlike texts are documents of their own, so
    one stays for each of their groups.  Documents without an id stay, one a group, where none
    of their group has an id.  Null, empty and wordless texts are copies of each other; an empty
    table gives no rows; other columns may have any names.
    """
    if similarity is None:
        rows = cut(_printed(docs, id_col, text_col, width))
        named = _components(rows, budget, hot).select("fp", "component")
        return one_of_each(docs, rows.join(named, "fp").select("doc_id", "key", "component"), id_col, text_col)
    rows = cut(shingles.described(docs, id_col, text_col, width, of_hashes))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    classes = cut(rows.groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), least.alias("least")).withColumn("key", F.col("least.key")).withColumn("node", F.monotonically_increasing_id()))
    prints = cut(classes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("pivot")))
    same = classes.filter("n > 0").join(prints, "fp").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    near = near_edges(prints.select("fp"), budget, hot)
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("pivot").alias("pa")), "a").join(prints.select(F.col("fp").alias("b"), F.col("pivot").alias("pb")), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    parts = shingles.grouped(classes, same.unionByName(near), texts, width, similarity)
    named = classes.join(parts, "node", "left").select("least", F.coalesce("component", "node").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("x")).select(F.col("x.key").alias("key"))
    return rows_of(docs, rows.select("key"), first, id_col, text_col)
