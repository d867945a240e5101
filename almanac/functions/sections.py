"""Managed sections of page texts: found between comment markers, and spliced from a new text into an existing one."""

from __future__ import annotations

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import scalars as S

MARKER = "managed-section"
_ID = r"([A-Za-z][A-Za-z0-9_-]*)"


def marks(section: str, marker: str = MARKER) -> tuple[str, str]:
    """A section's opening and closing marker; an id that isn't valid is an error."""
    if not re.fullmatch(_ID, section):
        raise ValueError(f"not a section id: {section!r}")
    return f"<!-- {marker} start: {section} -->", f"<!-- {marker} end: {section} -->"


def spans(text: str, marker: str = MARKER) -> list[tuple[int, int, str]]:
    """(start, stop, id) of the sections with both markers, in order of place.

    Of repeated markers the first counts; an end before its start, or either without the other,
    is passed over, as are sections that begin inside one that stands before them.
    """
    events: dict[str, dict[str, list[tuple[int, int]]]] = defaultdict(lambda: {"start": [], "end": []})
    pattern = rf"<!--\s*{re.escape(marker)}\s+(?:start:\s*{_ID}.*?|end:\s*{_ID}\s*)-->"
    for m in re.finditer(pattern, text, re.I | re.S):
        events[m[1] or m[2]]["start" if m[1] else "end"].append(m.span())
    found = []
    for section, at in events.items():
        if at["start"]:
            begin = at["start"][0][0]
            if stops := [stop for _, stop in at["end"] if stop > begin]:
                found.append((begin, stops[0], section))
    flat, reached = [], 0
    for span in sorted(found):
        if span[0] >= reached:
            flat.append(span)
            reached = span[1]
    return flat


def splice(existing: str, new: str, marker: str = MARKER) -> str:
    """The existing text with the new text's sections in their places, and new ones behind; all else stays."""
    fresh = {section: new[a:b] for a, b, section in spans(new, marker)}
    out, at = [], 0
    for a, b, section in spans(existing, marker):
        out += [existing[at:a], fresh.pop(section, existing[a:b])]
        at = b
    return "".join([*out, existing[at:], *(f"\n{text}" for text in fresh.values())])


def spliced(existing: Column, new: Column, marker: str = MARKER) -> Column:
    """The splice of two text columns, in Arrow batches; null texts count as empty."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([splice(x or "", y or "", marker) for x, y in zip(a, b, strict=True)])

    return run(existing, new)


def merge_pages(pages: DataFrame, marker: str = MARKER) -> DataFrame:
    """(title, content, action) for (title, existing, new, summary): U6 and K7.

    Pages that are empty, or whose last edit was a whole import, are rewritten; others are
    spliced, which may change nothing.  Only pages to be spliced reach Python.
    """
    whole = F.coalesce(S.strip("existing") == "", F.lit(True)) | S.own_edit("summary", merged=False)
    rewritten = pages.filter(whole).select("title", F.col("new").alias("content"), F.lit("clean_rewrite").alias("action"))
    merged = pages.filter(~whole).withColumn("content", spliced(F.col("existing"), F.col("new"), marker))
    return rewritten.unionByName(merged.select("title", "content", F.when(F.col("content") == F.col("existing"), "no_change").otherwise("surgical_merge").alias("action")))
