"""Join operators of the archive: lookups with fallback, overlays, alias picks, routing.

No side is broadcast by hint unless its size is fixed; adaptive execution broadcasts small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import pick


def with_name(df: DataFrame, names: DataFrame, key: str, name: str, out: str = "name", unknown: str = "Unknown", order: Sequence[Column | str] = ()) -> DataFrame:
    """Left join to a name; unmatched and empty names fall back to the key, then to `unknown`.

    Of a repeated key the last name by `order` counts, without one the greatest.
    """
    rows = names.filter(F.col(key).isNotNull())
    best = F.max_by(F.struct(F.col(name)), F.struct(*order))[name] if order else F.max(name)
    side = rows.groupBy(F.col(key).alias("_k")).agg(best.alias("_n"))
    found = F.coalesce(F.when(F.col("_n") != "", F.col("_n")), F.col(key).cast("string"), F.lit(unknown))
    return df.join(side, F.col(key) == F.col("_k"), "left").withColumn(out, found).drop("_k", "_n")


def with_latest(df: DataFrame, other: DataFrame, key: str, order: Sequence[Column | str], where: Column | None = None, out: str = "stats") -> DataFrame:
    """Left join to one row per key, the last by order, as a struct; the other side is filtered first."""
    side = other if where is None else other.filter(where)
    best = pick(side, [key], list(order))
    rest = [c for c in best.columns if c != key]
    return df.join(best.select(key, F.struct(*rest).alias(out)), key, "left")


def nested(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], out: str, order: Sequence[str] | None = None) -> DataFrame:
    """Left join to all rows of a key as a sorted array of structs; keys without rows get an empty array."""
    item = F.struct(*(order or ()), *(c for c in columns if c not in (order or ())))
    lists = other.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(out))
    return df.join(lists, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(lists.schema[out].dataType)))


def overlay(base: DataFrame, top: DataFrame, key: str, graft: Sequence[str]) -> DataFrame:
    """Full outer join: non-empty `graft` columns of the top replace the base's, unmatched rows of either stay."""
    side = top.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in top.columns if c != key))
    joined = base.join(side, F.col(key) == F.col("_k"), "full")

    def merged(c: str) -> Column:
        if c not in top.columns:
            return F.col(c)
        new = F.when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}"))
        own = F.coalesce(F.col(c), F.when(F.col(key).isNull(), F.col(f"_{c}")))
        return (F.coalesce(new, own) if c in graft else own).alias(c)

    return joined.select(F.coalesce(key, "_k").alias(key), *(merged(c) for c in base.columns if c != key))


def translate(df: DataFrame, mapping: DataFrame, columns: dict[str, str], empty_is_missing: bool = True) -> DataFrame:
    """Values of scalar columns by dictionary (category, en, he); those without an entry stay as they are."""
    for column, category in columns.items():
        side = mapping.filter(F.col("category") == category).select(F.col("en").alias("_en"), F.col("he").alias("_he")).groupBy("_en").agg(F.max("_he").alias("_he"))
        found = F.when(F.col("_he") != "", F.col("_he")) if empty_is_missing else F.col("_he")
        df = df.join(side, F.col(column) == F.col("_en"), "left").withColumn(column, F.coalesce(found, F.col(column))).drop("_en", "_he")
    return df


def translate_array(df: DataFrame, mapping: DataFrame, column: str, category: str, key: Sequence[str]) -> DataFrame:
    """As translate, for the elements of an array, whose order stays; rows are told apart by `key`."""
    items = df.select(*key, F.posexplode(column).alias("_i", "_x"))
    done = translate(items, mapping, {"_x": category})
    lists = done.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_list"))
    return df.join(lists, list(key), "left").withColumn(column, F.coalesce("_list", F.col(column))).drop("_list")


def combined_names(mapping: DataFrame, players: DataFrame) -> DataFrame:
    """(en, he): dictionary names first, players' own fill the gaps; a key with an empty first entry is left out."""
    both = mapping.filter("category = 'names'").select("en", "he", F.lit(0).alias("p")).unionByName(players.select(F.col("name_english").alias("en"), F.col("name_hebrew").alias("he"), F.lit(1).alias("p")).filter("he IS NOT NULL AND he <> ''"))
    return pick(both, ["en"], ["p", "he"], last=False).filter("he <> ''").select("en", "he")


def alias_pick(wanted: DataFrame, rows: DataFrame, name: str, order: Sequence[Column | str]) -> DataFrame:
    """For (display, aliases) the row of the first alias that has one, last duplicate wins; others keep nulls."""
    by_name = pick(rows, [name], list(order))
    tried = wanted.select("display", F.posexplode("aliases").alias("_i", name))
    hit = tried.join(by_name, name)
    best = pick(hit, ["display"], ["_i"], last=False).drop("_i")
    return wanted.select("display").join(best, "display", "left")


def known(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other side has."""
    return df.join(other, list(keys), "left_semi")


def unknown(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key the other side lacks (J13, P11, U2); null keys are unknown."""
    return df.join(other, list(keys), "left_anti")


def fallback_chain(keys: DataFrame, backends: Sequence[tuple[str, DataFrame]], key: str = "en", value: str = "he") -> DataFrame:
    """(key, value, src): of each key the first backend with a value; backends are (name, (key, value))."""
    out = keys.select(key).distinct()
    for i, (_, table) in enumerate(backends):
        side = table.filter(F.col(value) != "").groupBy(key).agg(F.max(value).alias(f"_v{i}"))
        out = out.join(side, key, "left")
    named = [F.when(F.col(f"_v{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(backends)]
    return out.select(key, F.coalesce(*(f"_v{i}" for i in range(len(backends)))).alias(value), F.coalesce(*named).alias("src"))


def zip_lists(df: DataFrame, key: Sequence[str], left: str, right: str) -> DataFrame:
    """(key, name, value): two lists paired by position as far as the shorter goes; of equal names the last stays."""
    pairs = F.slice(F.arrays_zip(F.col(left).alias("name"), F.col(right).alias("value")), 1, F.least(F.size(left), F.size(right)))
    rows = df.filter(F.size(left) * F.size(right) > 0).select(*key, F.posexplode(pairs).alias("_i", "p")).select(*key, "_i", "p.name", "p.value")
    return pick(rows, [*key, "name"], ["_i"]).select(*key, "name", "value")


def delete_joined(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is left after deleting the rows that join."""
    return df.join(doomed, list(keys), "left_anti")


def not_in_related(recent: DataFrame, related: DataFrame, url: str = "url") -> DataFrame:
    """Recents that aren't among the related; rows without url stay."""
    return recent.join(related.select(url).filter(F.col(url).isNotNull()).distinct(), url, "left_anti").select(*recent.columns)
