"""Toxicity by multiple-instance learning: documents are bags of sentences.

Each sentence has a logistic score over its words; a document's score is their noisy-or, one
minus the chance that no sentence is toxic.  Only documents are labelled; the sentence model
is fitted through the noisy-or, and then tells which sentences offend.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, tidy
from .fold import logistic, training_sample, with_columns

_sentence = re.compile(r"[^.!?\n。！？]+")
_word = re.compile(r"\w+").findall


PREFIXES = range(4, 10)


def features(word: str) -> list[str]:
    """A word's features: itself, and its longer beginnings marked by a dash, all in lower case."""
    w = word.lower()
    return [w, *(w[:n] + "-" for n in PREFIXES if n < len(w))]


@dataclass
class MilModel:
    """Weights of the features that matter, and the bias of every sentence."""

    weights: dict[str, float]
    bias: float
    base: float = 0.5  # the score where nothing could be learnt

    def scorer(self, keep: int = 1 << 18):
        """Function of a text: (score, start and stop of the worst sentence, its own score, sentences at or over one half, their spans)."""
        weights, bias = self.weights, self.bias

        class Words(dict):
            def __missing__(self, word: str) -> float:
                if len(self) >= keep:
                    self.clear()
                self[word] = found = sum(weights.get(f, 0.0) for f in features(word))
                return found

        value = Words().__getitem__

        def score(text: str) -> tuple[float, int, int, float, int, str]:
            if not weights:
                return self.base, 0, 0, self.base, 0, ""
            clean, worst, at, bad = 0.0, -math.inf, (0, 0), []
            for m in _sentence.finditer(text):
                z = bias + math.fsum(map(value, set(_word(m[0]))))  # exact, so that the order of a set is no matter
                clean -= z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                if z >= 0:
                    bad.append(f"{m.start()}:{m.end()}")
                if z > worst:
                    worst, at = z, m.span()
            return -math.expm1(clean), *at, logistic(worst) if at[1] else 0.0, len(bad), ",".join(bad)

        return score


def choose(texts: list[str], label: np.ndarray, min_df: int, most: int) -> dict[str, int]:
    """Numbers, from 1, of the features of `min_df` toxic documents or more that tell the classes apart best by chi-square."""
    of = lambda t: {f for w in set(_word(t)) for f in features(w)}
    toxic: Counter[str] = Counter()
    for t, y in zip(texts, label, strict=True):
        if y > 0:
            toxic.update(of(t))
    toxic = Counter({f: n for f, n in toxic.items() if n >= min_df})
    clean: Counter[str] = Counter()
    for t, y in zip(texts, label, strict=True):
        if y <= 0:
            clean.update(of(t) & toxic.keys())
    n0, n1 = int((label <= 0).sum()), int((label > 0).sum())
    n, found = n0 + n1, []
    for f, a in toxic.items():
        b = clean[f]
        c, d = n1 - a, n0 - b
        found.append((-n * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * n1 * n0), f))
    return {f: i + 1 for i, (_, f) in enumerate(sorted(found)[:most])}


def bags(texts: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers by sentence, and where sentences and documents begin; number 0 opens every sentence, so none is empty."""
    ids, sentence, doc = [], [], []
    for t in texts:
        doc.append(len(sentence))
        for m in _sentence.findall(t) or [""]:
            sentence.append(len(ids))
            ids.append(0)
            ids += sorted(vocab[f] for w in set(_word(m)) for f in features(w) if f in vocab)
    return np.array(ids, np.int64), np.array(sentence, np.int64), np.array(doc, np.int64)


def fit(texts: list[str], y: list[int], min_df: int = 4, rounds: int = 250, rate: float = 0.2, sparse: float = 1e-4, most: int = 8000) -> MilModel:
    """Fits by Adam on the noisy-or's log-likelihood with a soft threshold on the weights.

    At each round half the features are left out at random, so that words which mostly stand
    beside stronger ones get their weight as well.
    Without both classes every score is that of the class, or one half for an empty sample.
    """
    label = np.array(y)
    if len(set(y)) < 2:
        return MilModel({}, 0.0, 0.5 if not y else 0.98 if y[0] else 0.02)
    vocab = choose(texts, label, min_df, most)
    ids, sentence, doc = bags(texts, vocab)
    n_ids = np.diff(np.r_[sentence, len(ids)])
    n_sentences = np.diff(np.r_[doc, len(sentence)])
    w, b, rng = np.zeros(len(vocab) + 1), -5.0, np.random.default_rng(17)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        last = t > rounds * 4 // 5  # at the end all features are there, and only the bias moves
        seen = np.ones(len(w)) if last else (rng.random(len(w)) < 0.5).astype(float)
        z = np.add.reduceat((w * seen)[ids], sentence) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        total = np.add.reduceat(np.logaddexp(0, z), doc)
        push = np.where(label > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0) / len(label)
        g = np.repeat(push, n_sentences) * p
        gb = float(g.sum())
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-4)
        if last:
            continue
        gw = np.bincount(ids, np.repeat(g, n_ids), len(w)) * seen
        gw[0] = 0
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        w = w - step * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
    return MilModel({f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 1e-3}, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", size: int = 8000, longest: int = 50_000, total: int = 1 << 26) -> MilModel:
    """Fits on at most `size` labelled training documents of at most `longest` characters each and `total` together."""
    model = fit(*training_sample(docs, labels, label, size, longest, id_col, text_col, total))
    tidy()
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_start, worst_stop, worst_score, n_toxic_sentences, toxic_spans) of every document.

    `toxic_spans` are start:stop of all sentences that offend by themselves, at one half or more,
    comma-joined in order.  Positions count code points, stops are exclusive.  Defined cases:
    null texts count as empty; a text without sentences scores 0; repeated rows come back as
    often as given; a null id is not held out; an empty table gives no rows; without usable
    labels every score is one half.
    """
    model = train(docs, labels, id_col, text_col, **how)
    told = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [("score", "double"), ("worst_start", "int"), ("worst_stop", "int"), ("worst_score", "double"), ("n_toxic_sentences", "int"), ("toxic_spans", "string")]
    scored = with_columns(rows, "text", lambda: told.value.scorer(), fields)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_stop", "worst_score", "n_toxic_sentences", "toxic_spans")
