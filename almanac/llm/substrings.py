"""Removal of word sequences that repeat across or within documents, by compacted de Bruijn paths.

Each window of `width` words is an edge of a graph whose nodes are its first and its last words.
Consecutive edges whose windows share their minimizer, the smallest hash of a few words in them,
make a path, so a graph of far fewer paths stands for all edges.  A path whose minimizer is met
on no other path has no branches: its occurrences are joined by name, and the words at the
earliest one's coordinates in its source verify the others.  Paths that share a minimizer may
branch; the earliest occurrence of each is taken apart into its edges again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, spread_join, tidied

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __init__(self, keep: int = 1 << 18) -> None:
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[word] = found
        return found


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    many = len(words) - n + 1
    h = np.full(many, n, np.uint64)
    for i in range(n):
        h = (h ^ words[i : i + many]) * _A
        h ^= h >> np.uint64(32)
    h *= _B
    return h ^ (h >> np.uint64(29))


def paths(words: np.ndarray, sizes: np.ndarray, width: int, seed: int, bits: int = 64) -> tuple[np.ndarray, ...]:
    """(document, start, edges, minimizer, name) of the paths of documents laid one behind the other, `sizes` words each.

    Every window within a document is an edge of exactly one path.  A window's minimizer is the
    leftmost smallest hash of `seed` words in it.  It depends on the window's words alone, so
    equal windows have equal minimizers at equal places.  The name covers all words of the path
    and the place of the minimizer, in so many `bits`.
    """
    ends = np.cumsum(sizes)
    if len(words) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h, w = grams(words, seed), grams(words, width)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, reach = width - seed + 1, 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    document = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + width <= ends[document])
    at, document = at[inside], document[inside]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (document[1:] != document[:-1])]) if len(at) else np.zeros(0, np.int64)
    edges = np.diff(np.r_[first, len(at)])
    start = inside[first]
    # A path has no more edges than a window has words, so its first and last window hold all its words.
    name = np.zeros(len(start), np.uint64)
    for part in (w[start], w[start + edges - 1], edges.astype(np.uint64), (at[first] - start).astype(np.uint64)):
        name = (name ^ part) * _A
        name ^= name >> np.uint64(32)
    document = document[first]
    return document, start - (ends - sizes)[document], edges, h[at[first]], name >> np.uint64(64 - bits)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, id, tie, text): the order of documents is by id, nulls last; equal ids go by their text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    repeated = rows.groupBy("id").count().filter("count > 1")
    tie = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")
    return rows.select("doc_id", "id", tie.alias("tie"), "text")


def _cut_words(text: str) -> list[bytes]:
    return text.encode().split()  # of bytes: ASCII white space only


def _parts(batch: pa.RecordBatch, column: int = 2, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of texts of about `size` bytes together, a longer text by itself."""
    total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def found_paths(rows: DataFrame, width: int, seed: int, bits: int = 64) -> DataFrame:
    """(minimizer, name, id, tie, start, edges) of all paths of all documents."""
    names = ["minimizer", "name", "id", "tie", "start", "edges"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashes()
        for batch in batches:
            for part in _parts(batch):
                texts = [_cut_words(x.as_py()) for x in part.column(2)]
                sizes = np.fromiter(map(len, texts), np.int64, len(texts))
                words = np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
                document, start, edges, minimizer, name = paths(words, sizes, width, seed, bits)
                of = pa.array(document)
                yield pa.record_batch([pa.array(minimizer.view(np.int64)), pa.array(name.view(np.int64)), part.column(0).take(of), part.column(1).take(of), pa.array(start.astype(np.int32)), pa.array(edges.astype(np.int32))], names=names)

    return rows.select("id", "tie", "text").mapInArrow(tidied(work), "minimizer long, name long, id long, tie long, start int, edges int")


def spelled(asked: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, tie, start, edges, key, first, whole, digest): 64-bit digests of words at their coordinates.

    `asked` holds (id, tie, start, edges, minimizer, name, first, shared, apart).  A path that is
    shared gives one row with its name as the key, one that is taken apart a row for each edge
    with its minimizer as the key: either key is 64 bits that the digest doesn't depend on.
    """
    lists = asked.groupBy("id", "tie").agg(F.collect_list(F.struct("start", "edges", "minimizer", "name", "first", "shared", "apart")).alias("asked"))
    names = ["id", "tie", "start", "edges", "key", "first", "whole", "digest"]

    def digests(text: bytes, begins: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        blake = hashlib.blake2b
        return [blake(text[a:b], digest_size=8).digest() for a, b in zip(begins[start].tolist(), (begins[stop] - 1).tolist(), strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                rows, out, sums = [], [], []
                for k in range(part.num_rows):
                    words = _cut_words(part.column(2)[k].as_py())
                    text = b" ".join(words)
                    begins = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]
                    asked = part.column(3).slice(k, 1).flatten()
                    start, edges, minimizer, name, first, shared, apart = (asked.field(c).to_numpy(zero_copy_only=False) for c in range(7))
                    own = np.flatnonzero(shared)
                    sums += digests(text, begins, start[own], start[own] + edges[own] + width - 1)
                    each = np.repeat(np.flatnonzero(apart), edges[apart])
                    at = start[each] + np.arange(len(each)) - np.searchsorted(each, each, "left")
                    sums += digests(text, begins, at, at + width)
                    rows.append(len(own) + len(each))
                    out.append((np.r_[start[own], at], np.r_[edges[own], np.ones(len(each), np.int32)], np.r_[name[own], minimizer[each]], np.r_[first[own], first[each]], np.arange(rows[-1]) < len(own)))
                of = pa.array(np.repeat(np.arange(len(rows)), rows))
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())
                made = [pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([part.column(0).take(of), part.column(1).take(of), *made, pa.array(np.frombuffer(b"".join(sums), np.int64))], names=names)

    texts = rows.select("id", "tie", "text").join(lists, ["id", "tie"])
    return texts.select("id", "tie", "text", "asked").mapInArrow(tidied(work), "id long, tie long, start int, edges int, key long, first boolean, whole boolean, digest long")


def _place() -> Column:
    return F.struct("id", "tie", "start")


def repeats(rows: DataFrame, width: int, seed: int, scratch: Scratch, bits: int = 64) -> DataFrame:
    """(id, tie, start, edges, source): edges and whole paths whose words begin earlier too, at `source`, the earliest place."""
    every = scratch.put("paths", found_paths(rows, width, seed, bits))
    met = cut(every.groupBy("minimizer").agg(F.count("*").alias("_rows")).filter("_rows > 1"))
    # Of a minimizer that is met once, no edge repeats.
    live = scratch.put("live", spread_join(every, met.select("minimizer"), "minimizer", "name", counts=met))
    scratch.drop("paths")
    key = F.struct("minimizer", "name").alias("path")
    names = scratch.put("names", live.groupBy("minimizer", "name").agg(F.count("*").alias("many"), F.min(_place()).alias("source")))
    forks = cut(names.groupBy("minimizer").agg(F.count("*").alias("_rows")).filter("_rows > 1"))
    named = spread_join(names, forks.select("minimizer", F.lit(True).alias("fork")), "minimizer", "name", "left", counts=forks)
    named = scratch.put("named", named.select(key, "many", "source", F.coalesce("fork", F.lit(False)).alias("fork")))
    scratch.drop("names")
    # A path without branches is its name; the earliest occurrence of one with branches is taken apart into edges.
    asked = spread_join(live.withColumn("path", key), named, "path", "id", counts=named.select("path", F.col("many").alias("_rows")))
    first = _place() == F.col("source")
    asked = asked.select("id", "tie", "start", "edges", "path.minimizer", "path.name", first.alias("first"), (F.col("many") > 1).alias("shared"), (first & F.col("fork")).alias("apart"))
    told = scratch.put("told", spelled(asked, rows, width))
    # The words at the source's coordinates verify the other occurrences of a path.
    source = told.filter("whole AND first").groupBy("key").agg(F.min(F.struct("digest", "id", "tie", "start")).alias("x"))
    source = source.select("key", F.col("x.digest").alias("words"), F.struct("x.id", "x.tie", "x.start").alias("source"))
    later = scratch.put("later", spread_join(told.filter("whole AND NOT first"), source, "key", "id").select("id", "tie", "start", "edges", "source", "key", (F.col("digest") == F.col("words")).alias("proven")))
    edges = told.filter(~F.col("whole")).select("id", "tie", "start", F.struct("key", "digest").alias("edge"))
    wrong = later.filter(~F.col("proven")).select(F.col("key").alias("name")).distinct()
    if not wrong.isEmpty():  # names that different words share: all their paths are taken apart
        again = live.join(wrong, "name", "left_semi").withColumns({"first": F.lit(False), "shared": F.lit(False), "apart": F.lit(True)})
        edges = scratch.put("edges", edges.unionByName(spelled(again, rows, width).select("id", "tie", "start", F.struct("key", "digest").alias("edge"))).distinct())
    one = cut(edges.groupBy("edge").agg(F.count("*").alias("_rows"), F.min(_place()).alias("source")).filter("_rows > 1"))
    more = spread_join(edges, one.select("edge", "source"), "edge", "id", counts=one.select("edge", "_rows")).filter(_place() != F.col("source"))
    columns = ("id", "tie", "start", "edges", "source")
    found = scratch.put("covered", later.filter("proven").select(*columns).unionByName(more.withColumn("edges", F.lit(1)).select(*columns)).distinct())
    scratch.drop("live", "named", "told", "later", "edges")
    return found


def spans(found: DataFrame, width: int) -> DataFrame:
    """(id, tie, start, stop, source): repeats that continue each other at their sources too, joined to spans of words."""
    by = Window.partitionBy("id", "tie").orderBy("start", "edges")
    before = F.lag(F.struct("start", "edges", "source")).over(by)
    rows = found.withColumn("b", before)
    goes_on = (F.col("b.source.id") == F.col("source.id")) & (F.col("b.source.tie") == F.col("source.tie")) & (F.col("b.source.start") - F.col("b.start") == F.col("source.start") - F.col("start")) & (F.col("start") <= F.col("b.start") + F.col("b.edges"))
    rows = rows.withColumn("span", F.sum(F.when(goes_on, 0).otherwise(1)).over(by))
    stop = F.max(F.col("start") + F.col("edges") + (width - 1))
    return rows.groupBy("id", "tie", "span").agg(F.min("start").alias("start"), stop.alias("stop"), F.min("source").alias("source")).drop("span")


def removed(docs: DataFrame, width: int = 20, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document without the words of windows that begin earlier too.

    Earlier is a smaller id, or the same document and an earlier start; the input is judged, not
    what is left.  `bits` of the paths' names only decide how much is verified in vain.

    Defined cases: null and empty texts have no words (and the digest of nothing); texts of less
    than `width` words lose none; null ids come last; rows of one id are ordered by a hash of
    their text, and rows that repeat both id and text are one document, given back as often as
    they came; texts of any length are taken whole; an empty table gives no rows.
    """
    rows, scratch = _documents(docs, id_col, text_col), Scratch(docs.sparkSession)
    found = repeats(rows, width, seed, scratch, bits)
    lists = cut(spans(found, width).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    scratch.close()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for k in range(batch.num_rows):
                words = _cut_words(batch.column(1)[k].as_py())
                n.append(len(words))
                out = 0
                if batch.column(2)[k].is_valid:
                    spans = batch.column(2).slice(k, 1).flatten()
                    bounds = np.zeros(len(words) + 1, np.int64)
                    np.add.at(bounds, spans.field(0).to_numpy(), 1)
                    np.add.at(bounds, spans.field(1).to_numpy(), -1)
                    keep = np.cumsum(bounds[:-1]) == 0
                    out = len(words) - int(keep.sum())
                    words = list(compress(words, keep.tolist()))
                gone.append(out)
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    texts = rows.join(lists, ["id", "tie"], "left").select("doc_id", "text", "spans")
    return texts.mapInArrow(tidied(work), "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (
      SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i,
             unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS h
      FROM split WHERE len(ws) >= 20),
    ordered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM windows),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ordered WHERE r > 1),
    words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM split),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS bigint) AS n_words, CAST(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM split LEFT JOIN kept USING (doc_id)"""
