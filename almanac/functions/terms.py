"""Greedy term matching: longest first, whole words, no overlaps, in order of place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C


_SEPARATORS = str.maketrans(",;|/", "    ")


class Matcher:
    """Finds any number of terms in one pass of a text, by an automaton of all of them.

    Longer terms claim their places first, then the smaller in order, from left to right; a
    term needs no letter or digit on either side.  Separators and runs of white space count as
    one space, capitals as small letters.
    """

    def __init__(self, vocabulary: dict[str, str]) -> None:
        import ahocorasick

        terms = {k.lower(): v for k, v in vocabulary.items() if k}
        ranks = {t: i for i, t in enumerate(sorted(terms, key=lambda t: (-len(t), t)))}
        self.names = terms
        self.automaton = ahocorasick.Automaton()
        for term, rank in ranks.items():
            self.automaton.add_word(term, (rank, term))
        if terms:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[str]:
        """Standard names of the terms in a text, in order of place."""
        low = " ".join((text or "").translate(_SEPARATORS).split()).lower()
        if not low or not self.names:
            return []
        n, claims = len(low), []
        for last, (rank, term) in self.automaton.iter(low):
            end, at = last + 1, last + 1 - len(term)
            if not (at and low[at - 1].isalnum()) and not (end < n and low[end].isalnum()):
                claims.append((rank, at, end, term))
        taken, found = bytearray(n), []
        for _, at, end, term in sorted(claims):
            if not any(taken[at:end]):
                taken[at:end] = b"\1" * (end - at)
                found.append((at, self.names[term]))
        return [name for _, name in sorted(found)]


def find(vocabulary: dict[str, str]) -> Callable[[Column], Column]:
    """An Arrow-batched function of a text column; the vocabulary maps terms to names, and its size doesn't matter to a text's time."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def matched(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = Matcher(vocabulary).find  # once a task
        for texts in batches:
            yield texts.map(match)

    return matched


def countries(names: dict[str, str] | None = None) -> Callable[[Column], Column]:
    """Country names in a text by their standard form (F6): the given ones and the usual aliases."""
    return find({**(names or {}), **{n.lower(): n for n in (names or {}).values()}, **C.COUNTRY_ALIASES})
