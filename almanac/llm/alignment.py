"""Alignment of two tokenizers over the same texts.

Tokens of both tokenizers that cover a common byte are edges of a bipartite graph; its connected
components, found by union-find, are exactly the minimal groups between bytes where tokens of
both end.  Both tokenizers are cut at the same places of a text, so a text is a row of units,
each aligned once and remembered.  How many documents hold a pair of ids is counted in workers
first and then by Spark; the most frequent pairs are sent to all workers, the rest joined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Codec, pretokens
from .common import cut, drop, local_forest, shared_dir, stamp, tidied
from .token_counts import MARK

#: The most pairs that are sent to every worker, 20 bytes each.
BROADCAST = 1 << 19
#: Both tokenizers begin anew before a space or line feed between characters that aren't white space.
_cut = re.compile(r"(?<=\S)(?=[ \n]\S)").split


class Bytes:
    """Ids of a byte-level BPE file's tokens; merged by tiktoken where its ranks are the merges' order."""

    def __init__(self, codec: Codec) -> None:
        import tiktoken

        self.codec, self.merger = codec, None
        ranks = {b: i for i, b in enumerate(codec.bytes_of) if i not in set(codec.special.values())}
        if codec.made == sorted(codec.made) and (not codec.made or codec.made[0] > max(codec.first)) and len(ranks) == len(codec.first) + len(codec.made):
            self.merger = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, unit: str) -> list[int]:
        # Beyond these letters what counts as one depends on a library's version of Unicode.
        if self.merger and (unit.isascii() or max(unit) < "\u0250"):
            return self.merger(unit)
        return [i for w in pretokens(unit) for i in self.codec.merge(w.encode())]


class Pieces:
    """Ids and bytes of a SentencePiece BPE model's tokens."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.sp.id_to_piece, range(n)))]
        self.mark = self.sp.piece_to_id(MARK)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units, each beginning with the space that the model adds, or with a line feed, which has none before it."""
        ids = self.sp.encode([u[u[0] == " " :] for u in units], num_threads=1)
        return [x if u[0] == " " else x[x[0] == self.mark :] for x, u in zip(ids, units, strict=True)]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all tokens that share a byte; a and b are where the tokens end, none empty, over the same bytes."""
    first = np.searchsorted(b, np.r_[0, a[:-1]], "right")
    many = np.searchsorted(b, a, "left") - first + 1
    i = np.repeat(np.arange(len(a)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many - first, many)


def components(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, in order, of the components that the links join, for the tokens of either side; each has tokens of both."""
    root = local_forest(i, j + n_a, np.arange(n_a + n_b))
    of_a = np.cumsum(root[:n_a] == np.arange(n_a)) - 1
    return of_a, of_a[root[n_a:]]


class Aligner:
    """Aligns texts unit by unit; `keep` units are remembered, on which results don't depend."""

    def __init__(self, codec: Codec, model: bytes, keep: int = 300_000) -> None:
        self.bytes, self.pieces, self.keep = Bytes(codec), Pieces(model), keep
        self.spelled = (codec.bytes_of, self.pieces.bytes_of)
        self.b_size = len(self.pieces.bytes_of)
        self.length = [np.array([len(x) for x in by], np.int64) for by in self.spelled]
        # An id and what follows it: another one of its side, then the other side or the next group.
        self.shown = [f"{i}{after}" for by, end in zip(self.spelled, "|;", strict=True) for after in ("," + end) for i in range(len(by))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.told: list[str] = []  # a unit's groups, with the separator behind
        self.links = np.zeros(1 << 16, np.int64)
        self.units = np.zeros((1 << 12, 6), np.int64)  # tokens of either side, groups, whether bytes differ, first link and links

    def learn(self, units: list[str]) -> None:
        """Aligns new units together: their bytes are laid one behind the other."""
        own = [u.encode() for u in units]
        ids = [[self.bytes.encode(u) for u in units], self.pieces.encode(units)]
        size = np.fromiter(map(len, own), np.int64, len(own))

        def laid(side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = np.fromiter(map(len, ids[side]), np.int64, len(own))
            flat = np.fromiter(chain.from_iterable(ids[side]), np.int64, int(n.sum()))
            return n, flat, np.cumsum(self.length[side][flat])

        bad = np.zeros(len(own), bool)
        if any(b"".join(map(self.spelled[s].__getitem__, chain.from_iterable(ids[s]))) != b"".join(own) for s in (0, 1)):
            bad = np.array([any(b"".join(map(self.spelled[s].__getitem__, ids[s][k])) != u for s in (0, 1)) for k, u in enumerate(own)])
            for k in np.flatnonzero(bad).tolist():
                ids[0][k], ids[1][k] = [], []
        (n_a, a, ends_a), (n_b, b, ends_b) = laid(0), laid(1)
        i, j = overlaps(ends_a, ends_b) if len(a) else (np.zeros(0, np.int64),) * 2
        group_a, group_b = components(i, j, len(a), len(b))
        last_a, last_b = (np.r_[g[1:] != g[:-1], np.ones(min(1, len(g)), bool)] for g in (group_a, group_b))
        sizes = [len(x) for x in self.spelled]
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = a + last_a * sizes[0]
        code[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = b + 2 * sizes[0] + last_b * sizes[1]
        text = list(map(self.shown.__getitem__, code.tolist()))
        upto = np.cumsum(n_a)
        link_ends = np.searchsorted(i, upto, "left")
        groups = np.diff(np.r_[0, np.r_[0, np.cumsum(last_a)][upto]])
        first, held = len(self.told), int(self.units[len(self.told) - 1, 4:].sum()) if self.told else 0
        while first + len(own) > len(self.units):
            self.units = np.concatenate([self.units, np.zeros_like(self.units)])
        while held + len(i) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[held : held + len(i)] = a[i] * self.b_size + b[j]
        starts = np.r_[0, link_ends[:-1]]
        self.units[first : first + len(own)] = np.stack([n_a, n_b, groups, bad.astype(np.int64), held + starts, link_ends - starts], axis=1)
        text_ends = (upto + np.cumsum(n_b)).tolist()
        self.told += ["".join(text[x:y]) for x, y in zip([0, *text_ends[:-1]], text_ends, strict=True)]
        self.place.update(zip(units, range(first, first + len(own)), strict=True))

    def align(self, texts: Iterable[str], at_once: int = 1 << 17) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text the places of its units and (n_a, n_b, n_groups); a text whose bytes differ has no units."""
        held: list[list[str]] = []
        size = 0

        def flush() -> Iterator[tuple[list[int], np.ndarray]]:
            if len(self.place) > self.keep:
                self.forget()
            known = self.place
            new = list({u for units in held for u in units if u not in known})
            for k in range(0, len(new), at_once):
                self.learn(new[k : k + at_once])
            for units in held:
                at = list(map(known.__getitem__, units))
                sums = self.units[at, :4].sum(axis=0) if at else np.zeros(4, np.int64)
                yield ([], np.zeros(3, np.int64)) if sums[3] else (at, sums[:3])

        for text in texts:
            held.append(_cut(" " + text) if text else [])
            size += len(held[-1])
            if size > at_once:
                yield from flush()
                held, size = [], 0
        yield from flush()

    def pairs(self, at: list[int]) -> np.ndarray:
        """The links of units as first id times the number of second ids, plus second id."""
        start, n = self.units[at, 4], self.units[at, 5]
        return self.links[np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(told, name: str) -> Aligner:
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(*told.value)
    return _ALIGNERS[name]


def linked(rows: DataFrame, told, name: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, many): texts' distinct linked pairs, and how often each is linked."""
    names = "doc_id n_a n_b n_groups n_links groups_sha256 pairs many".split()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(told, name)
        for batch in batches:
            out: list[tuple] = []
            for at, sums in aligner.align(x.as_py() or "" for x in batch.column(1)):
                pairs, many = np.unique(aligner.pairs(at), return_counts=True) if at else (np.zeros(0, np.int64),) * 2
                text = "".join(map(aligner.told.__getitem__, at))[:-1]
                out.append((*sums.tolist(), int(many.sum()), hashlib.sha256(text.encode()).hexdigest() if at else "", pairs, many))
            cols = list(zip(*out, strict=True))
            ends = pa.array(np.r_[0, np.cumsum([len(p) for p in cols[5]])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in cols[5:]]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), *lists], names=names)

    return rows.mapInArrow(tidied(work), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, many array<long>")


def pair_counts(texts: DataFrame, at_once: int = 1 << 21) -> DataFrame:
    """(pair, docs): how many rows hold a pair; workers add up before anything is sent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums, held, size = none, [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = np.unique(np.concatenate([none[0], *held]), return_counts=True)
            both = np.concatenate([sums[0], pairs])
            order = np.argsort(both, kind="stable")
            first = np.flatnonzero(np.r_[True, both[order][1:] != both[order][:-1]]) if len(both) else none[0]
            return both[order][first], np.add.reduceat(np.concatenate([sums[1], n])[order], first) if len(both) else none[1]

        def told() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x.astype(np.int64)) for x in sums], names=["pair", "docs"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > at_once:
                sums, held, size = added(), [], 0
                if len(sums[0]) > at_once:
                    yield told()
                    sums = none
        sums = added()
        yield told()

    return texts.select("pairs").mapInArrow(tidied(work), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def ranked(pairs: DataFrame, b_size: int) -> DataFrame:
    """(pair, docs, best): whether a pair's count is the highest of its first id; ids are bounded by the vocabulary."""
    a = F.expr(f"pair div {b_size}")
    top = pairs.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))
    return pairs.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _level(docs: Column) -> Column:
    return F.floor(F.log2(docs) * 16).cast("int")


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    `most` pairs at most, those that most documents hold, are sent to all workers; documents'
    other pairs are joined, each of them held by few documents only.  Texts are read once: their
    pairs lie in the shared folder until the counts are added up.

    Defined cases: null and empty texts, and texts whose tokens don't give back a space and the
    text, have no tokens (zeros and an empty digest); null ids stay null; rows that are repeated
    count as documents of their own and come back as often as given; equal counts of an id are
    all highest; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    codec = Codec(byte_path)
    with open(piece_path, "rb") as f:
        model = f.read()
    told, b_size = spark.sparkContext.broadcast((codec, model)), len(Pieces(model).bytes_of)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    at = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    linked(rows, told, f"{codec.key} {stamp(model)}").withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(at)
    texts = spark.read.parquet(at)
    pairs = cut(ranked(cut(pair_counts(texts)), b_size))
    left, least = most, None
    for r in sorted(pairs.groupBy(_level(F.col("docs")).alias("level")).count().collect(), key=lambda r: -r["level"]):  # some hundred levels
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    chosen = pairs.filter(_level(F.col("docs")) >= least).orderBy("pair").toArrow() if least is not None else None
    known = tuple(chosen.column(c).to_numpy() for c in ("pair", "docs", "best")) if chosen is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    frequent = spark.sparkContext.broadcast(known)
    names = ["row", "n_best", "count_sum", "rest", "rest_many"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_of, best = frequent.value
        for batch in batches:
            lists = batch.column(1)
            pair, many = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            place = np.searchsorted(held, pair)
            hit = place < len(held)
            hit[hit] = held[place[hit]] == pair[hit]
            count, place, of = many[hit], place[hit], row[hit]
            sums = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
            np.add.at(sums[0], of, count * best[place])
            np.add.at(sums[1], of, count * docs_of[place])
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=len(n)))].astype(np.int32))
            yield pa.record_batch([batch.column(0), *map(pa.array, sums), *(pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (pair, many))], names=names)

    sums = cut(texts.select("row", "pairs", "many").mapInArrow(tidied(work), "row long, n_best long, count_sum long, rest array<long>, rest_many array<long>"))
    own = cut(texts.drop("pairs", "many"))
    drop(spark, at)
    rare = pairs if least is None else pairs.filter(_level(F.col("docs")) < least)
    rest = sums.select("row", F.explode(F.arrays_zip(F.col("rest").alias("pair"), F.col("rest_many").alias("many"))).alias("x")).select("row", "x.pair", "x.many").join(rare, "pair")
    more = rest.select("row", F.when(F.col("best"), F.col("many")).otherwise(0).alias("n_best"), (F.col("many") * F.col("docs")).alias("count_sum"))
    total = sums.select("row", "n_best", "count_sum").unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return own.join(total, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
