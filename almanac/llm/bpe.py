"""Byte-level BPE encoding and decoding behind a minimal acyclic transducer of frequent words.

The most frequent pre-tokens of the corpus, counted over all documents, are compiled into a
minimal automaton whose arcs carry numbers: their sum along a word's path is the word's place
in a table of id sequences.  The file is written to the shared folder, shipped with Spark's
file distribution and memory-mapped by every worker.  Words outside it are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, stamp, tidied, tidy

#: The published pattern that splits texts before byte-level merges (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by Unicode's definition; the regex module adds four control characters to it.
SPACES = r"[\t-\r \x85\xa0  -     　]"
#: Letters and digits of Unicode versions after 16, which the tokenizers library does not know as such (fixed values).
NEWER = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EEE 11B0A 11DB0-11DF1 1246F-1247F 12550-12686 16EA0-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DFFF 1E6C0-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
_NEWER = "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]"


def _rule(letter: str, digit: str) -> str:
    """The pattern with Unicode's white space and the given classes of letters and digits."""
    other = rf"(?:(?!{SPACES}|{letter}|{digit})(?s:.))"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{digit}+| ?{other}+|{SPACES}+(?=$|{SPACES})|{SPACES}+".replace("(?=$|", r"(?=\Z|")


_plain = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:(?!{SPACES})[^\p{{L}}\p{{N}}])").replace(r"\s+(?!\S)", rf"{SPACES}+(?=\Z|{SPACES})").replace(r"\s", SPACES)).findall
_careful = regex.compile(_rule(rf"(?:(?!{_NEWER})\p{{L}})", rf"(?:(?!{_NEWER})\p{{N}})")).findall
_has_newer = re.compile(_NEWER).search


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens, as the tokenizers library cuts them."""
    return _plain(text) if text.isascii() or not _has_newer(text) else _careful(text)


#: Where a text may be cut: before white space that begins with a space; `\s` here is wider than the library's.
_cut = re.compile(r"(?<!\s) ").search


def slices(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in slices of about `size`, cut only before a space that follows no white space of any kind."""
    at = 0
    while len(text) - at > size and (found := _cut(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


LEXICON = 1 << 18


def byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next from 256 up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Vocabulary and merges of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.key = json.dumps(told, sort_keys=True).encode()
        model, pre = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("ignore_merges") or told["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("only plain byte-level BPE files are supported")
        chars, vocab = byte_chars(), model["vocab"]
        spell = lambda token: bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = spell(token)
        self.key = stamp(self.key)
        self.first = [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]
        self.rank_of: dict[int, int] = {}  # by left id << 32 | right id
        self.made: list[int] = []  # by rank
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank_of.setdefault(vocab[a] << 32 | vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.texts = [str(i) for i in range(len(self.bytes_of))]
        pairs = np.array(sorted(self.rank_of.items()), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.first_of, self.made_of = np.array(self.first, np.int64), np.array(self.made, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank first, the leftmost among equals."""
        ids, rank, none = [self.first[b] for b in word], self.rank_of.get, len(self.made)
        if len(ids) > 128:
            return self._merge_long(ids)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = self.made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank_of.get, len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[best], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes], longest: int = 48, few: int = 8) -> list[bytes]:
        """Ids of many pre-tokens as 32-bit integers: those of equal length take their merges in step."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            if size > longest or len(at) < few:
                for i in at:
                    out[i] = np.array(self.merge(words[i]), "<i4").tobytes()
            elif size:
                self._in_step(np.array(at), self.first_of[np.frombuffer(b"".join([words[i] for i in at]), np.uint8)].reshape(-1, size), out)
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pair_keys):
            return np.zeros(a.shape, np.int64)
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], len(self.made))

    def _in_step(self, at: np.ndarray, ids: np.ndarray, out: list[bytes]) -> None:
        """Merges rows of ids of equal length, one pair of each row at a time; rows without a pair are done."""
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(at):
            width = ids.shape[1]
            best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(at), np.int64)
            low = ranks[np.arange(len(at)), best] if width > 1 else np.full(len(at), len(self.made))
            live = low < len(self.made)
            if not live.all():
                for i, row in zip(at[~live].tolist(), ids[~live].astype("<i4"), strict=True):
                    out[i] = row.tobytes()
                at, ids, ranks, best, low = at[live], ids[live], ranks[live], best[live], low[live]
            if not len(at):
                break
            row = np.arange(len(at))
            ids[row, best] = self.made_of[low]
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(len(at), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(len(at), width - 2)
            right = np.flatnonzero(best < width - 2)
            ranks[right, best[right]] = self._ranks(ids[right, best[right]], ids[right, best[right] + 1])
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self._ranks(ids[left, best[left] - 1], ids[left, best[left]])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; special tokens are kept, ill-formed byte runs become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


# --- the transducer -----------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A memory-mappable minimal acyclic transducer of the words and their ids.

    Words are added in order; states left behind are merged with equal ones, so suffixes are
    shared.  An arc's number counts the words that its state has before that arc; their sum
    along a path is the word's place among the sorted words.
    """
    known: dict[tuple, int] = {}  # settled states: finality and arcs (byte << 32 | state), to their number
    below: list[int] = []  # words below each
    path: list[tuple[bool, list[int]]] = [(False, [])]  # states of the last word, still open
    low = (1 << 32) - 1

    def settle(depth: int) -> None:
        while len(path) > depth:
            final, arcs = path.pop()
            key = (final, *arcs)
            state = known.get(key)
            if state is None:
                state = known[key] = len(below)
                below.append(final + sum(below[a & low] for a in arcs))
            if path:
                path[-1][1].append(last[len(path) - 1] << 32 | state)

    last = b""
    order = sorted(words)
    for word in order:
        settle(1 + next((i for i, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last))))
        path += [(False, []) for _ in range(len(path) - 1, len(word))]
        path[-1] = (True, path[-1][1])
        last = word
    settle(0)

    ends = np.fromiter((key[0] for key in known), np.int64, len(known))
    n_arcs = sum(len(key) - 1 for key in known)
    table = np.empty((3, n_arcs), np.int64)
    at = 0
    for state, (final, *arcs) in enumerate(known):  # numbered as they were settled, so arcs come sorted
        before = int(final)
        for a in arcs:
            table[:, at] = state << 8 | a >> 32, a & low, before
            before += below[a & low]
            at += 1
    offsets = np.cumsum([0, *(len(words[w]) for w in order)], dtype=np.int64)
    ids = np.fromiter(chain.from_iterable(words[w] for w in order), np.int32, int(offsets[-1]))
    head = np.array([n_arcs, len(ends), len(order), len(ids), len(ends) - 1, max(map(len, order), default=0)], np.int64)
    return b"".join(x.tobytes() for x in (head, table, ends, offsets, ids))


class Lexicon:
    """The mapped transducer; looks many words up at once, one byte of each at a time."""

    def __init__(self, data: np.ndarray) -> None:
        n_arcs, n_states, n_words, n_ids, self.root, self.longest = (int(x) for x in data[:48].view(np.int64))
        sizes = [n_arcs, n_arcs, n_arcs, n_states, n_words + 1]
        at = 48 + 8 * np.cumsum([0, *sizes])
        self.keys, self.targets, self.adds, self.finals, self.offsets = (data[a : a + 8 * n].view(np.int64) for a, n in zip(at, sizes, strict=False))
        self.ids = data[at[-1] : at[-1] + 4 * n_ids]

    @classmethod
    def map(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, mode="r"))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as 32-bit integers, None for words outside."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        size = np.fromiter(map(len, words), np.int64, len(words))
        at = np.flatnonzero((size > 0) & (size <= self.longest))
        starts = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.full(len(at), self.root), np.zeros(len(at), np.int64)
        for depth in range(self.longest):
            if not len(at):
                break
            key = state << 8 | flat[starts[at] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            at, arc = at[ok], arc[ok]
            state, place = self.targets[arc], place[ok] + self.adds[arc]
            over = size[at] == depth + 1
            hit = over & (self.finals[state] == 1)
            for i, a, b in zip(at[hit].tolist(), self.offsets[place[hit]].tolist(), self.offsets[place[hit] + 1].tolist(), strict=True):
                out[i] = self.ids[4 * a : 4 * b].tobytes()
            at, state, place = at[~over], state[~over], place[~over]
        return out


class Encoder:
    """Whole texts to ids: special strings first, then pre-tokens through memo, lexicon and merges."""

    def __init__(self, codec: Codec, lexicon: Lexicon, keep: int = 700_000) -> None:
        self.codec, self.lexicon, self.keep = codec, lexicon, keep
        self.memo: dict[str, bytes] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(codec.special, key=len, reverse=True))) + ")") if codec.special else None
        for text, i in codec.special.items():
            if pretokens(text) == [text]:
                raise ValueError(f"special string {text!r} looks like a pre-token")

    def cut(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in lists, special strings standing alone."""
        for part in self.special.split(text) if self.special else [text]:
            if part in self.codec.special:
                yield [part]
            elif part:
                yield from map(pretokens, slices(part))

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.memo) + len(new) > self.keep:
            self.memo.clear()
            new = list(words)
        raw, rest = [w.encode() for w in new], []
        for w, b, ids in zip(new, raw, self.lexicon.find(raw), strict=True):
            if ids is not None:
                self.memo[w] = ids
            elif w in self.codec.special:
                self.memo[w] = np.array([self.codec.special[w]], "<i4").tobytes()
            else:
                rest.append((w, b))
        self.memo.update(zip((w for w, _ in rest), self.codec.merge_all([b for _, b in rest]), strict=True))

    def encode(self, texts: Iterable[str], at_once: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of each text; words of about `at_once` characters are looked up together."""
        held: list[list[list[str]]] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            self.learn(set(chain.from_iterable(chain.from_iterable(held))))
            for lists in held:
                yield np.frombuffer(b"".join(map(self.memo.__getitem__, chain.from_iterable(lists))), "<i4")

        for text in texts:
            held.append(list(self.cut(text)))
            size += len(text)
            if size > at_once:
                yield from flush()
                held, size = [], 0
        yield from flush()


# --- DataFrame operators ------------------------------------------------------------------


def frequent_words(docs: DataFrame, codec: Codec, size: int = LEXICON, text_col: str = "text", longest: int = 48) -> dict[bytes, list[int]]:
    """At most `size` of the most frequent words of all documents, as pre-tokens, with their ids.

    Words are runs of letters with the space before them, counted by Spark's own functions
    over every text; counts are combined before their shuffle.  A histogram over sixteenths of
    octaves sets the least count that keeps within `size`, so only chosen words reach the driver.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.length("word") <= longest).filter("n > 1")
    counted = counted.select("word", F.floor(F.log2("n") * 16).cast("int").alias("level"))
    counted = cut(counted)
    room, least = size, None
    for level, n in sorted(counted.groupBy("level").count().collect(), reverse=True):  # some hundred levels
        room -= n
        if room < 0:
            break
        least = level
    if least is None:
        return {}
    chosen = counted.filter(F.col("level") >= least).select("word").toArrow().column(0)
    return {w: codec.merge(w) for w in (x.as_py().encode() for x in chosen)}


def ship(spark: SparkSession, data: bytes, kind: str = "lexicon") -> str:
    """Writes bytes to the shared folder and has Spark hand the file to every executor; returns its name."""
    name = f"{kind}-{stamp(data)}.bin"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):  # named by its content: another run's file is as good, and may be in use
        side = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}.{uuid.uuid4().hex}")
        out = fs.create(side, True)
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
        out.close()
        if not fs.rename(side, path) and not fs.exists(path):
            raise OSError(f"could not write {path}")
    spark.sparkContext.addFile(path.toString())
    return name


_ENCODERS: dict[str, Encoder] = {}


def _encoder(codec, name: str, keep: int) -> Encoder:
    """The worker's encoder for a lexicon, kept from task to task with its memo of `keep` words."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(codec.value, Lexicon.map(SparkFiles.get(name)), keep)
    return _ENCODERS[name]


def prepare(docs: DataFrame, tokenizer_path: str, size: int = LEXICON, text_col: str = "text"):
    """(broadcast codec, shipped lexicon's name) for a corpus."""
    spark = docs.sparkSession
    codec = Codec(tokenizer_path)
    name = ship(spark, compile_lexicon(frequent_words(docs, codec, size, text_col)), f"lexicon-{codec.key}")
    tidy()
    return spark.sparkContext.broadcast(codec), name


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON, keep: int = 150_000) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text; workers remember `keep` words, which results don't depend on.

    Defined cases: null and empty texts have no ids; null ids stay null; repeated rows come back
    as often as given; an empty table gives no rows.
    """
    codec, name = prepare(docs, tokenizer_path, size, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(codec, name, keep)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = list(encoder.encode(Texts(part.column(1))))
                yield pa.record_batch([part.column(0), pa.array(map(len, got), pa.int64()), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return _pairs(docs, id_col, text_col).mapInArrow(tidied(work), "doc_id long, n_tokens long, ids array<int>")


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every id list; a null list gives an empty text."""
    codec = rows.sparkSession.sparkContext.broadcast(Codec(tokenizer_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec.value.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")


class Texts:
    """The texts of a column one at a time, null as empty."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column

    def __iter__(self) -> Iterator[str]:
        return (x.as_py() or "" for x in self.column)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = LEXICON, keep: int = 700_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and its ids decoded again.

    Defined cases: null texts count as empty (no ids, digests of nothing); special strings in a
    text become their ids; rows come back as often as given; an empty table gives no rows.
    """
    codec, name = prepare(docs, tokenizer_path, size, text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sha = _encoder(codec, name, keep), hashlib.sha256
        told = encoder.codec.texts.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for ids in encoder.encode(Texts(batch.column(1))):
                ids = ids.tolist()
                n.append(len(ids))
                a.append(sha(",".join(map(told, ids)).encode()).hexdigest())
                b.append(sha(encoder.codec.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _pairs(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
