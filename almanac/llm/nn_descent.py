"""Near-duplicate embeddings by NN-descent (Dong, Moses and Li 2011).

Equal vectors of a label form one class.  A neighbour graph over classes starts from random
hyperplane blocks and is refined through joins of neighbours of neighbours.  Its edges at or
over the threshold, with those of the blocks, give components.  Nodes whose lists are saturated
with links are compared exactly across components, then with their whole component, in blocks,
so every link inside is counted.  An audit
compares vectors of components of every size with all others; poor recall, or none to be seen,
starts another round, and after the last one components are compared exactly.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, cut, local_forest

log = logging.getLogger(__name__)
Group = tuple[np.ndarray, ...]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1."""
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Group, np.ndarray]]:
    """(key, other columns, vectors) of each run of equal keys; the key comes first and the vectors last.

    Batches must be sorted by key; a run may span batches.
    """
    held_key, held = None, []

    def joined() -> tuple[int, Group, np.ndarray]:
        return held_key, tuple(np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)), np.concatenate([h[1] for h in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        others = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns - 1)]
        lists = batch.column(batch.num_columns - 1)
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and key[a] != held_key:
                yield joined()
                held = []
            held_key = key[a]
            held.append((tuple(o[a:b] for o in others), flat[at[a] : at[b]].reshape(b - a, -1)))
    if held:
        yield joined()


def classes_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with its validity; and (node, grp, n, v), one node per distinct valid vector of a label."""
    kind = vectors.schema[vector_col].dataType
    inner = "double" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType) else "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{inner}>").alias("v"), F.col(label_col).cast("string").alias("label"))
    good = "label IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.withColumn("ok", F.coalesce(F.expr(good), F.lit(False)))
    same = rows.filter("ok").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    named = same.select(F.monotonically_increasing_id().alias("node"), F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp"), "label", "n", "least", "v")
    return rows, cut(named)


def _block(*parts) -> Column:
    """A block's name from all its parts, numbers after at most one text, so that no two blocks share it."""
    return F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)).alias("block")


def blocks(nodes: DataFrame, tables: int, size: int, seed: int) -> DataFrame:
    """(block, node): nodes of a group that lie on the same sides of random hyperplanes, `tables` times.

    A group has as many hyperplanes as bring its blocks to about `size`.  Larger blocks, as of
    dense clusters, are dealt out by hash: any share of a dense cluster serves as well.
    """
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("many")).withColumn("bits", F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("many") / size)))).cast("int"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            node, grp, bits, lists = (batch.column(i) for i in range(4))
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            width, bits = np.diff(at), bits.to_numpy()
            for d in np.unique(width):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * 30))
                own = np.flatnonzero(width == d)
                x = np.stack([flat[at[i] : at[i + 1]] for i in own]).astype(np.float64)
                side = (x @ planes[d] > 0).reshape(len(own), tables, 30)
                side &= np.arange(30)[None, None, :] < bits[own][:, None, None]
                code = (side * (1 << np.arange(30))).sum(axis=2)
                pick = pa.array(np.repeat(own, tables))
                yield pa.record_batch([node.take(pick), grp.take(pick), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(code.ravel())], names=["node", "grp", "t", "code"])

    coded = cut(nodes.join(sizes, "grp").select("node", "grp", "bits", "v").mapInArrow(codes, "node long, grp string, t int, code long"))
    key = ["grp", "t", "code"]
    crowd = coded.groupBy(*key).agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("node", "t", F.lit(seed)), F.ceil(F.col("c") / (2 * size)))
    return coded.join(crowd.filter(F.col("c") > 1), key).select(_block(*key, part), "node")


def _sorted(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def within_blocks(placed: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, sim): of every node in a block its k nearest, and a forest over the links at the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node,), v in groups(batches):
            if len(node) < 2:
                continue
            x = unit(v)
            s = x @ x.T
            i, j = np.nonzero(np.triu(s >= threshold, 1))
            root = local_forest(i, j, np.arange(len(node)))
            np.fill_diagonal(s, -2)
            top = np.argpartition(-s, min(k, len(node) - 1) - 1, axis=1)[:, : min(k, len(node) - 1)]
            at = np.repeat(np.arange(len(node)), top.shape[1])
            leaf = np.flatnonzero(root != np.arange(len(node)))
            a, b = np.r_[node[at], node[leaf]], np.r_[node[top.ravel()], node[root[leaf]]]
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.r_[s[at, top.ravel()], np.full(len(leaf), 2.0)])], names=["a", "b", "sim"])

    rows = placed.join(nodes.select("node", "v"), "node").select("block", "node", "v")
    return _sorted(rows, "block").mapInArrow(work, "a long, b long, sim double")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, sim): the k best distinct neighbours of each node; a list is never longer than what its node was offered."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).filter(F.col("r") <= k).drop("r")


def descend(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, turn: int) -> DataFrame:
    """One refinement: (a, b, sim) between neighbours, forward or reverse, of a common node that improve a list.

    Reverse neighbours are as many as forward ones at most, chosen anew by hash at each turn.
    """
    worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).alias("worst"))
    back = graph.select(F.col("b").alias("mid"), F.col("a").alias("node"))
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("mid").orderBy(F.xxhash64("mid", "node", F.lit(turn)), "node"))).filter(F.col("r") <= k).drop("r")
    around = graph.select(F.col("a").alias("mid"), F.col("b").alias("node")).union(back).union(graph.select(F.col("a").alias("mid"), F.col("a").alias("node"))).distinct()
    rows = around.join(nodes.select("node", "v"), "node").join(worst, F.col("node") == F.col("a"), "left").select("mid", "node", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _, (node, low), v in groups(batches):
            x = unit(v)
            s = x @ x.T
            i, j = np.nonzero((s > low[:, None]) & ~np.eye(len(node), dtype=bool))
            held.append((node[i], node[j], s[i, j]))
            if len(held) >= 4096:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["a", "b", "sim"])
                held = []
        if held:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["a", "b", "sim"])

    return _sorted(rows, "mid").mapInArrow(work, "a long, b long, sim double")


def chunked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The rows in chunks of about `size` of each key, once for each pair of its chunks: block, first (or second chunk), alone (one chunk with itself)."""
    many = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("chunks"))
    out = rows.join(many, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pair = F.explode(F.expr("transform(sequence(0, chunks - 1), o -> named_struct('low', least(own, o), 'high', greatest(own, o)))")).alias("p")
    out = out.select("*", pair)
    return out.select(_block(key, "p.low", "p.high"), *rows.columns, (F.col("own") == F.col("p.low")).alias("first"), (F.col("p.low") == F.col("p.high")).alias("alone"))


def count_links(parts: DataFrame, nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """(node, n_links) inside each component: its nodes, in chunks of about `size`, chunk against chunk."""
    rows = chunked(parts.select("component", "node"), "component", size)
    rows = rows.join(nodes.select("node", "n", "v"), "node").select("block", "node", "n", "first", "alone", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, n, first, alone), v in groups(batches):
            x = unit(v)
            if alone[0]:
                found = (x @ x.T >= threshold) & ~np.eye(len(node), dtype=bool)
                yield pa.record_batch([pa.array(node), pa.array(found @ n)], names=["node", "links"])
            elif first.any() and not first.all():
                found = x[first] @ x[~first].T >= threshold
                yield pa.record_batch([pa.array(np.r_[node[first], node[~first]]), pa.array(np.r_[found @ n[~first], n[first] @ found])], names=["node", "links"])

    return _sorted(rows, "block").mapInArrow(work, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def cross_links(members: DataFrame, nodes: DataFrame, threshold: float, size: int) -> DataFrame:
    """(a, b): a forest over every link between (node, component) of different components, by exact search.

    Angles obey the triangle inequality, so two components are compared only where the angle of
    one member of each is within both radii and the threshold's angle.
    """
    placed = cut(members.select("node", "component").join(nodes.select("node", "grp", "v"), "node"))
    heads = placed.join(placed.groupBy("component").agg(F.min("node").alias("node")).select("node"), "node", "left_semi").select("component", "grp", "node", F.col("v").alias("head"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(1), batch.column(2))]
            angle = [float(np.arccos(np.clip((unit(x[a : b][None]) @ unit(y[c : d][None]).T)[0, 0], -1, 1))) for (at, x), (bt, y) in [both] for a, b, c, d in zip(at[:-1], at[1:], bt[:-1], bt[1:], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(angle, pa.float64())], names=["component", "angle"])

    radius = placed.join(heads.select("component", "head"), "component").select("component", "v", "head").mapInArrow(far, "component long, angle double").groupBy("component").agg(F.max("angle").alias("radius"))
    reach = cut(heads.join(radius, "component").select("grp", "component", "node", "radius", F.col("head").alias("v")))
    rows = chunked(reach, "grp", size).select("block", "component", "radius", "first", "alone", "v")
    widest = float(np.arccos(threshold)) + 1e-6

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (name, r, first, alone), v in groups(batches):
            x = unit(v)
            p, q = (np.arange(len(x)),) * 2 if alone[0] else (np.flatnonzero(first), np.flatnonzero(~first))
            if not len(p) or not len(q):
                continue
            ok = np.arccos(np.clip(x[p] @ x[q].T, -1, 1)) <= r[p][:, None] + r[q][None, :] + widest
            i, j = np.nonzero(np.triu(ok, 1) if alone[0] else ok)
            yield pa.record_batch([pa.array(name[p[i]]), pa.array(name[q[j]])], names=["ca", "cb"])

    pairs = _sorted(rows, "block").mapInArrow(near, "ca long, cb long")
    many = placed.groupBy("component").agg(F.ceil(F.count("*") / size).cast("int").alias("chunks"))
    pairs = cut(pairs.join(many.select(F.col("component").alias("ca"), F.col("chunks").alias("na")), "ca").join(many.select(F.col("component").alias("cb"), F.col("chunks").alias("nb")), "cb"))

    def side(own: str, chunks: str, others: str, order: tuple[str, str], first: bool) -> DataFrame:
        mine = pairs.join(placed, F.col(own) == F.col("component")).withColumn("own", F.pmod(F.xxhash64("node"), F.col(chunks)).cast("int"))
        return mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select(_block("ca", "cb", *order), "node", F.lit(first).alias("first"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (node, first), v in groups(batches):
            x, p, q = unit(v), np.flatnonzero(first), np.flatnonzero(~first)
            if not len(p) or not len(q):
                continue
            i, j = np.nonzero(x[p] @ x[q].T >= threshold)
            root = local_forest(p[i], q[j], np.arange(len(node)))
            leaf = np.flatnonzero(root != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[leaf]), pa.array(node[root[leaf]])], names=["a", "b"])

    both = side("ca", "na", "nb", ("own", "other"), True).unionByName(side("cb", "nb", "na", ("other", "own"), False))
    return _sorted(both, "block").mapInArrow(work, "a long, b long")


def settled(links: DataFrame, graph: DataFrame, nodes: DataFrame, k: int, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """(links, parts) after nodes whose whole lists are links, where closer members crowd others out, are compared across components."""
    parts = cut(connected_components(links))
    full = graph.groupBy("a").agg(F.count("*").alias("c"), F.min("sim").alias("worst")).filter((F.col("c") >= k) & (F.col("worst") >= threshold)).select(F.col("a").alias("node"))
    found = cut(cross_links(parts.join(full, "node", "left_semi"), nodes, threshold, size))
    if found.isEmpty():
        return links, parts
    links = links.union(found)
    return links, cut(connected_components(links))


def audit(nodes: DataFrame, parts: DataFrame, threshold: float, asked: int, seed: int, recall: float, most: int = 8192) -> bool:
    """True if hash-chosen nodes, compared with all others, show that components hold the links of each node.

    `asked` nodes are drawn from each stratum, of components alike in size by a factor of two;
    single nodes are one.  In each the mean over nodes of the share of links found must reach
    `recall`.  A sample without links is no evidence: it grows up to `most` nodes a stratum.
    A sample that is the whole table must have every link.
    """
    of = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    sizes = of.groupBy("component").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("stratum"))
    of = cut(of.join(sizes, "component"))
    strata = {r["stratum"]: r["count"] for r in of.groupBy("stratum").count().collect()}
    while strata:
        drawn = [of.filter(F.col("stratum") == s).orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(asked).select("node") for s in strata]
        chosen = nodes.select("node", "grp", "v").join(reduce(DataFrame.union, drawn), "node", "left_semi").toArrow().combine_chunks()
        whole = chosen.num_rows == sum(strata.values())
        ca, cb = (of.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"), F.col("stratum").alias(f"s{x}")) for x in "ab")
        true = _links_of(chosen, nodes, threshold).join(ca, "a").join(cb, "b")
        shares = true.groupBy("sa", "a").agg(F.avg((F.col("ca") == F.col("cb")).cast("double")).alias("share"))
        got = shares.groupBy("sa").agg(F.count("*").alias("n"), F.avg("share").alias("mean"), F.min("share").alias("least")).collect()
        log.info("audit of %d nodes: %s", chosen.num_rows, [(r["sa"], r["n"], r["mean"]) for r in got])
        if whole:
            return all(r["least"] == 1 for r in got)
        if got:
            return all(r["mean"] >= recall for r in got)
        if asked >= most:
            return False
        asked = min(4 * asked, most)
    return True


def _links_of(chosen: pa.Table, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every link of the chosen (node, grp, v), against all nodes."""
    ids, lists = chosen.column("node").to_numpy(), chosen.column("v").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    own: dict[str, list[int]] = {}
    for i, g in enumerate(chosen.column("grp").to_pylist()):
        own.setdefault(g, []).append(i)
    by = {g: (ids[rows], unit(np.stack([flat[at[r] : at[r + 1]] for r in rows]))) for g, rows in own.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, grp, lists = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for g, (q, x) in by.items():
                rows = np.flatnonzero(grp == g)
                if not len(rows):
                    continue
                y = unit(np.stack([flat[at[r] : at[r + 1]] for r in rows])).T
                for k in range(0, len(q), 1024):
                    i, j = np.nonzero(x[k : k + 1024] @ y >= threshold)
                    a, b = q[k + i], node[rows[j]]
                    yield pa.record_batch([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return nodes.select("node", "grp", "v").mapInArrow(work, "a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, k: int = 8, tables: int = 6, size: int = 256, turns: int = 3, rounds: int = 4, recall: float = 0.999, asked: int = 1024, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link when their labels are equal and their cosine, in double precision, reaches
    the threshold.  Defined cases: null labels, and vectors that are null, empty, zero or hold
    null or non-finite components, link with nothing; vectors of unlike length don't link;
    equal vectors link through their class and are not expanded into pairs; a null id is never
    a component's name; repeated rows come back as often as given; an empty table gives no rows.
    """
    rows, nodes = classes_of(vectors, id_col, vector_col, label_col)
    slack = threshold - 1e-12
    graph = links = parts = None
    for turn in range(rounds):
        start = cut(within_blocks(blocks(nodes, tables, size, seed + turn), nodes, k, slack))
        links = start.filter("sim >= 2").select("a", "b") if links is None else links.union(start.filter("sim >= 2").select("a", "b"))
        offered = start.filter("sim < 2")
        graph = cut(nearest(offered if graph is None else offered.union(graph), k))
        for t in range(turns):
            better = cut(nearest(descend(graph, nodes, k, slack, turn * turns + t).union(graph), k))
            moved = better.join(graph, ["a", "b"], "left_anti").count()
            graph = better
            if moved <= 0.001 * max(1, graph.count()):
                break
        links = cut(links.union(graph.filter(F.col("sim") >= slack).select("a", "b")).distinct())
        links, parts = settled(links, graph, nodes, k, slack, 512)
        if audit(nodes, parts, slack, asked << turn, seed + turn, recall):
            break
    else:
        log.warning("recall is not shown after %d rounds: all components are compared exactly", rounds)
        alone = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        parts = cut(connected_components(links.union(cross_links(alone, nodes, slack, 512))))
    counted = count_links(parts, nodes, slack, 512)
    whole = nodes.join(parts, "node", "left").join(counted, "node", "left").select("label", "v", "n", "least", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    whole = cut(whole)
    names = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    named = whole.join(names, "component").select("label", "v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.filter("ok").join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same in DuckDB, by comparing all pairs of a label.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT p.y, r.c FROM r JOIN p ON p.x = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*)::BIGINT AS n FROM p GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)"""
