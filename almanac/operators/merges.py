"""Merging seasons, sets of rows and dictionaries under explicit precedence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import pick

LAST = ("current_squad", "current_jersey_number")
LAST_TRUTHY = ("birth_date", "birth_place", "nationality", "main_position", "name_hebrew")
ANY = ("homegrown", "retired")


def truthy(column: str, kind: T.DataType) -> Column:
    """Neither null nor the type's empty value."""
    c = F.col(column)
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def merge_seasons(df: DataFrame, key: str = "id", season: str = "season", ordinal: str = "ord", last: Sequence[str] = LAST, last_truthy: Sequence[str] = LAST_TRUTHY, any_of: Sequence[str] = ANY, latest: Sequence[str] = ()) -> DataFrame:
    """One row per key over all its seasons.

    Rows are ordered by season, then ordinal.  `last` columns take the last row's value, null
    or not; `last_truthy` the last that isn't empty, or the first row's where all are;
    `any_of` are true if ever; all others keep the first row's value.  seasons_active lists
    the distinct seasons in order.  `latest` moves columns to the last-truthy rule by choice.
    A single aggregate, combined before its shuffle.
    """
    at = F.struct(season, ordinal)
    kinds = {f.name: f.dataType for f in df.schema}

    def value(c: str) -> Column:
        first = F.min_by(F.struct(c), at)[c]
        if c in last:
            return F.max_by(F.struct(c), at)[c]
        if c in last_truthy or c in latest:
            good = truthy(c, kinds[c])
            found = F.max_by(F.when(good, F.struct(c)), F.when(good, at))
            return F.when(found.isNotNull(), found[c]).otherwise(first)
        if c in any_of:
            return F.coalesce(F.bool_or(c), F.lit(False))
        return first

    rest = [c for c in df.columns if c not in (key, season, ordinal)]
    return df.groupBy(key).agg(*(value(c).alias(c) for c in rest), F.array_sort(F.collect_set(season)).alias("seasons_active"))


def distinct_rows(*frames: DataFrame) -> DataFrame:
    """Union of frames by column name, each whole row once (A10, U1, U3); maps are compared as sorted entries."""
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.distinct()
    entries = df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps}).distinct()
    return entries.withColumns({c: F.map_from_entries(c) for c in maps})


def fill_missing(df: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, and those of `more` whose key is new; none is overwritten."""
    new = more.join(df.select(*keys), list(keys), "left_anti")
    return df.unionByName(pick(new, list(keys), [c for c in new.columns if c not in keys], last=False) if len(keys) < len(new.columns) else new.distinct(), allowMissingColumns=True)


def keyed_overlay(existing: DataFrame, new: DataFrame, page: str = "page", section: str = "section", order: str = "ord", text: str = "text") -> DataFrame:
    """Sections of pages: the existing order stays, equal ids take the new text, new ids follow in new order."""
    old = pick(existing, [page, section], [order], last=False).select(page, section, F.col(order).alias("_o"), F.col(text).alias("_old"))
    fresh = pick(new, [page, section], [order], last=False).select(page, section, F.col(order).alias("_n"), F.col(text).alias("_new"))
    both = old.join(fresh, [page, section], "full")
    return both.select(page, section, F.struct(F.col("_o").isNull().alias("added"), F.coalesce("_o", "_n").alias("at")).alias("place"), F.coalesce("_new", "_old").alias(text))
