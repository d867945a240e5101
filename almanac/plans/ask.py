"""A small condition language over tables: [[Category:X]] [[Prop::Value]] |?Prop, translated to a DataFrame.

Conditions are conjunctive, values compare as text, a printout names a column; ten rows are
the language's own limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 10
_CONDITION = re.compile(r"\[\[\s*(?:(?i:Category):\s*(?P<category>[^\[\]:|]+?)|(?P<prop>[^\[\]:|]+?)\s*::\s*(?P<value>[^\[\]]+?))\s*\]\]")
_PRINTOUT = re.compile(r"\|\s*\?\s*(?P<prop>[^|\[\]=]+?)\s*(?:=\s*(?P<label>[^|\[\]]+?)\s*)?(?=\||\[\[|$)")


@dataclass
class Ask:
    categories: list[str] = field(default_factory=list)
    conditions: list[tuple[str, str]] = field(default_factory=list)
    printouts: list[tuple[str, str]] = field(default_factory=list)
    rest: str = ""

    @property
    def complete(self) -> bool:
        """At least one condition, and nothing outside conditions and printouts (L3)."""
        return bool(self.categories or self.conditions) and not self.rest


def parse(text: str) -> Ask:
    """Conditions, printouts and what is left of a query text (L1, L2)."""
    ask = Ask()
    for m in _CONDITION.finditer(text):
        if m["category"]:
            ask.categories.append(m["category"])
        else:
            ask.conditions.append((m["prop"], m["value"]))
    bare = _CONDITION.sub("", text)
    for m in _PRINTOUT.finditer(bare):
        ask.printouts.append((m["prop"], m["label"] or m["prop"]))
    ask.rest = _PRINTOUT.sub("", bare).strip()
    return ask


def serialize(ask: Ask) -> str:
    """The query text of an Ask."""
    return "".join([*(f"[[Category:{c}]]" for c in ask.categories), *(f"[[{p}::{v}]]" for p, v in ask.conditions), *(f"|?{p}" + (f"={label}" if label != p else "") for p, label in ask.printouts)])


def incomplete(text: str) -> dict[str, str] | None:
    """The stage of input that is unfinished, and its fragment as typed (L4); None where nothing is open.

    A printout counts at the very beginning; categories are told by the exact word.
    """
    if text.startswith("|?"):
        return {"stage": "printout", "fragment": re.split(r"[|\[\]]", text[2:], maxsplit=1)[0]}
    # Pairs of brackets close in turn, so what is left after the last closed pair decides.
    *closed, rest = re.split(r"\[\[(?s:.*?)\]\]", text)
    _, bracket, inner = rest.partition("[[")
    if not bracket:
        return None
    if inner.startswith("Category:"):
        return {"stage": "category", "fragment": inner.removeprefix("Category:")}
    prop, separator, value = inner.partition("::")
    return {"stage": "value", "property": prop, "fragment": value} if separator else {"stage": "property", "fragment": inner}


def _text(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    return F.array_join(F.col(column).cast("array<string>"), ", ") if isinstance(kind, T.ArrayType) else F.col(column).cast("string")


def _column(df: DataFrame, prop: str) -> str:
    key = prop.strip().lower().replace(" ", "_")
    found = [c for c in df.columns if c.lower() == key]
    if len(found) != 1:
        raise ValueError(f"no property {prop!r}")
    return found[0]


def execute(df: DataFrame, query: str | Ask, order: list[str], categories: str = "categories", limit: int | None = LIMIT) -> DataFrame:
    """Rows that meet all conditions, as texts, in a total order, `limit` at most.

    Filters and selected columns reach the scan; without printouts all columns are shown.
    """
    ask = parse(query) if isinstance(query, str) else query
    if not ask.complete:
        raise ValueError(f"incomplete query, left over: {ask.rest!r}")
    rows = df
    for c in ask.categories:
        rows = rows.filter(F.array_contains(categories, c) if isinstance(df.schema[categories].dataType, T.ArrayType) else F.col(categories) == c)
    for prop, value in ask.conditions:
        column = _column(df, prop)
        if isinstance(df.schema[column].dataType, T.ArrayType):
            rows = rows.filter(F.array_contains(F.col(column).cast("array<string>"), value))
        else:  # first in the column's own type, so that the scan can filter; then as text
            rows = rows.filter(F.col(column) == F.lit(value).try_cast(df.schema[column].dataType)).filter(F.col(column).cast("string") == value)
    rows = rows.orderBy(*order)
    rows = rows.limit(limit) if limit else rows
    shown = ask.printouts or [(c, c) for c in df.columns]
    return rows.select(*(_text(df, _column(df, p)).alias(label) for p, label in shown))


def suggest(df: DataFrame, column: str, fragment: str, limit: int = LIMIT, id_col: str | None = None) -> DataFrame:
    """Distinct values that begin with the fragment, or whose id does, in any case."""
    begins = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).startswith(fragment.lower()), F.lit(False))
    rows = df.filter(begins(column) | begins(id_col) if id_col else begins(column))
    return rows.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").limit(limit)


def search(df: DataFrame, fragment: str, *columns: str) -> DataFrame:
    """Rows with the fragment in one of the columns, in any case."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(fragment.lower())), F.lit(False))
    return df.filter(test)
