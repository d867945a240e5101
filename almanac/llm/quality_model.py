"""Quality classifier: Naive Bayes features under a support vector machine.

N-gram indicators are scaled by the log ratio of their smoothed class counts (Wang and Manning
2012) and a linear hinge-loss model is fitted on them by dual coordinate descent (Hsieh et al.
2008).  Margins become scores by a logistic fit on documents kept out of the descent.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, free_name, held_out, tidy
from .fold import logistic, training_sample, with_columns

BITS = 18
#: Shapes are taken of pieces: whole words mostly, and long words piece by piece to their end.
PIECE = 32
_words = re.compile(WORD).findall
_pieces = re.compile(f"{WORD[:-1]}{{1,{PIECE}}}").findall
_RUNS = [(re.compile(p), s) for p, s in ((r"[^\W\d_]", "a"), (r"\d+", "0"), (r"A+", "A"), (r"a+", "a"), (r"([^\w])\1+", r"\1\1"))]


def shape(word: str) -> str:
    """The word with letters as A or a and digits as 0, runs shortened; other characters stay."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    for pattern, by in _RUNS[1:]:
        out = pattern.sub(by, out)
    return out


class Grams(dict):
    """Hashes of words, or pieces of long words, and of their shapes, remembered up to a bound."""

    def __init__(self, keep: int = 1 << 18) -> None:
        super().__init__()
        self.keep = keep
        self.seen = np.zeros(1 << BITS, np.int64)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        found = zlib.crc32(word.encode()) << 31 | zlib.crc32(shape(word[:PIECE]).encode()) >> 1  # a longer word's pieces are asked for, too
        self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """Ids of the distinct n-grams of a whole text: words and word pairs, shapes of pieces up to threes, and how often threes of words repeat."""
        words = _words(text)
        if not words:
            return np.zeros(1, np.int32)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words)).astype(np.uint64)
        word, form = both >> np.uint64(31), both & np.uint64(0x7FFFFFFF)
        if max(map(len, words)) > PIECE:
            pieces = _pieces(text)
            form = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)).astype(np.uint64) & np.uint64(0x7FFFFFFF)
        mix = [_mixed(1, word), _mixed(2, form)]
        if len(words) > 1:
            mix.append(_mixed(3, word[:-1], word[1:]))
        if len(form) > 1:
            mix.append(_mixed(4, form[:-1], form[1:]))
        if len(form) > 2:
            mix.append(_mixed(5, form[:-2], form[1:-1], form[2:]))
        if len(words) > 2:
            threes = _hash(6, word[:-2], word[1:-1], word[2:])
            share = 1 - len(np.unique(threes)) / len(threes)
            mix.append(_mixed(7, np.arange(1 + int(10 * share), dtype=np.uint64)))  # one per tenth reached
            same = float(np.mean(word[1:] == word[:-1]))
            mix.append(_mixed(8, np.arange(1 + int(10 * same), dtype=np.uint64)))
        ids = np.concatenate(mix)
        at = np.arange(len(ids))
        self.seen[ids] = at  # of equal ids the last to be written remains
        return ids[self.seen[ids] == at]


def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), 0x9E3779B97F4A7C15 * kind & (1 << 64) - 1, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    return (_hash(kind, *parts) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class NbSvm:
    """ratio: log-count ratio by n-gram id; weight: the machine's weights times the ratios."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        norm = float(np.sqrt(r @ r))
        return (float(self.weight[ids].sum()) / norm if norm else 0.0) + self.bias

    def score(self, ids: np.ndarray) -> float:
        return logistic(self.slope * self.margin(ids) + self.shift)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed counts of documents with each n-gram; 0 for those never seen."""
    counts = [np.full(1 << BITS, alpha) for _ in range(2)]
    for ids, label in zip(rows, y, strict=True):
        counts[int(label)][ids] += 1
    q, p = counts
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == alpha) & (q == alpha)] = 0
    return ratio


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge losses, by single dual variables in random order."""
    sign, rng = np.where(y > 0, 1.0, -1.0), np.random.default_rng(seed)
    share = {1.0: len(y) / 2 / max(1, (sign > 0).sum()), -1.0: len(y) / 2 / max(1, (sign < 0).sum())}
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    square = np.array([float(v @ v) + 1 for v in values])  # the bias is a feature of 1
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            top = cost * share[sign[i]]
            slack = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - slack / square[i], 0.0), top) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * sign[i] * values[i]
                bias += step * sign[i]
                most = max(most, abs(step))
        if most < tolerance:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps, on Platt's softened targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * b)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def fit(texts: list[str], y: list[int], cost: float = 1.0) -> NbSvm:
    """The model of a labelled sample; every fifth document serves for calibration only.

    With no documents at all, or one class only, every text gets that class's score (one half for none).
    """
    label = np.array(y)
    if len(set(y)) < 2:
        flat = np.zeros(1 << BITS)
        return NbSvm(flat, flat, 0.0, 1.0, 0.0 if not y else 4.0 if y[0] else -4.0)
    grams = Grams(1 << 15)
    rows = [grams.of(texts[i]) for i in range(len(texts))]
    del grams
    own = np.arange(len(rows)) % 5 != 4
    if len(set(label[own])) < 2 or len(set(label[~own])) < 2:
        own[:] = True
    fitted = [r for r, k in zip(rows, own, strict=True) if k]
    ratio = log_count_ratio(fitted, label[own])
    values = []
    for ids in fitted:
        r = ratio[ids]
        values.append((r / (np.sqrt(r @ r) or 1.0)).astype(np.float32))
    w, bias = dual_descent(fitted, values, label[own], cost)
    model = NbSvm(ratio, w * ratio, bias, 1.0, 0.0)
    rest = np.flatnonzero(~own) if not own.all() else np.arange(len(rows))
    model.slope, model.shift = calibrate(np.array([model.margin(rows[i]) for i in rest]), label[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", size: int = 6000, longest: int = 50_000, total: int = 1 << 26) -> NbSvm:
    """Fits on at most `size` labelled training documents of at most `longest` characters each and `total` together."""
    model = fit(*training_sample(docs, labels, label, size, longest, id_col, text_col, total))
    tidy()
    return model


def with_scores(docs: DataFrame, model: NbSvm, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with the score of every whole text, null texts counting as empty; a column of that name is replaced.

    Repeated rows get the same score; an empty table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        grams, m = Grams(), told.value
        return lambda text: (m.score(grams.of(text)),)

    return with_columns(docs, text_col, make, [(out, "double")])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Defined cases: null texts count as empty and get the model's score of an empty text;
    repeated rows come back as often as given; a null id is not held out; an empty table gives
    no rows; without usable labels every score is one half.
    """
    model = train(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = with_scores(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """The documents, all columns kept, whose score reaches the threshold.

    Defined cases are those of score; null ids are kept or dropped by their text like any others.
    """
    model, name = train(docs, labels, id_col, text_col, **how), free_name("score", docs)
    return with_scores(docs, model, text_col, name).filter(F.col(name) >= threshold).select(*docs.columns)
