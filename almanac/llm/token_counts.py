"""Token counts of whole texts under a SentencePiece BPE model, by a whole-token shortcut.

Offline, on the driver, the vocabulary is put through the merges once: the strings that come
out as one token are proven whole.  Texts are cut at boundaries that no vocabulary string
spans; units that are proven whole count one each without any merging, and only the other
units are merged (and remembered).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # stands for a space in the model's vocabulary


@dataclass
class PieceModel:
    """What counting needs of a model: merge order by string, and single characters that are tokens."""

    order: dict[str, int]
    whole: frozenset[str] = frozenset()
    pattern: str = ""
    keep: int = 600_000
    _memo: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, norm = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or spec.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError("only BPE models with byte fallback, a dummy prefix, identity normalisation and no user-defined or unused pieces are supported")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(sp.get_score(i), sp.id_to_piece(i)) for i, p in enumerate(proto.pieces) if p.type == 1]
        ranked = sorted({s for s, _ in pieces}, reverse=True)
        place = {s: i for i, s in enumerate(ranked)}
        model = cls({piece: place[score] for score, piece in pieces})
        model.prove()
        return model

    def prove(self) -> None:
        """Finds the strings that encode alone as one token, and the cuts that no string spans."""
        if wrong := [p for p in self.order if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces span a word boundary: {wrong[:3]}")
        self.whole = frozenset(p for p in self.order if len(self.merge(p)) == 1)
        inner = {c for p in self.order if len(p) > 1 for c in p} - {MARK}
        chars = "".join(re.escape(c) for c in sorted(inner))
        #: A run of marks belongs to what follows; characters of no longer piece stand alone.
        self.pattern = f"{MARK}+[{chars}]*|[{chars}]+|[^{MARK}{chars}]"

    def merge(self, unit: str) -> list[str]:
        """The unit's tokens: the best-ranked adjacent pair first, the leftmost among equals."""
        parts, rank, none = list(unit), self.order.get, len(self.order) + 1
        if len(parts) > 128:
            return self._merge_long(parts)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i] += parts[i + 1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        order, n = self.order, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := order.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(made) or parts[i] + parts[j] != made:
                continue
            parts[i], parts[j] = made, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := order.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def count_unit(self, unit: str) -> int:
        """Tokens of a unit that isn't proven whole; characters outside the vocabulary fall back to bytes."""
        found = self._memo.get(unit)
        if found is None:
            order = self.order
            found = sum(1 if p in order else len(p.encode()) for p in self.merge(unit))
            if len(unit) <= 64:
                if len(self._memo) >= self.keep:
                    self._memo.clear()
                self._memo[unit] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        find, whole, n = re.compile(self.pattern).findall, self.whole.__contains__, 0
        known = self._memo.get
        for part in slices(MARK + text.replace(" ", MARK), MARK):
            units = find(part)
            rest = list(filterfalse(whole, units))
            n += len(units) - len(rest) + sum(known(u) or self.count_unit(u) for u in rest)
        return n


def slices(text: str, mark: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in slices of about `size`, cut only before a mark that follows another character."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(mark, cut)) > 0 and text[cut - 1] == mark:
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    Defined cases: null and empty texts have no bytes and no tokens; rows come back as often as
    they are given, null ids included; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = model.value.count
        for batch in batches:
            texts, sizes, tokens = batch.column(1), [], []
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(count(text))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
