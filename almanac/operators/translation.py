"""Dictionary translation of nested rows: match events, line-ups, names with their provenance.

Words of any number of columns, at any depth, are looked up by one join: the distinct words of a
row go to the dictionary once, come back as a map for each category, and each column is rewritten
from those maps in one pass by expressions.  Rows are never taken apart, so their arrays keep
order, length and nulls.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What is translated, and how.

    `path` names the words: fields by dots, `[]` for each element of an array and `{}` for each
    value of a map, as in `goals[].scorer` or `lineup{}[]`.  `category` is the dictionary's.
    With `first`, the path leads to structs, and of their fields only the first one changes
    whose word has another translation.  With `into`, a field beside the word gets the
    translation: a reviewer's entry wins over what is there, any other fills a blank.
    """

    path: str
    category: str
    first: tuple[str, ...] = ()
    into: str = ""


def entries(mapping: DataFrame, manual: str = "manual", order: Sequence[Column | str] = ()) -> DataFrame:
    """(category, en, he, manual): one entry a word of a dictionary (category, en, he, src).

    Of repeated words the last by `order` counts; without one a reviewer's before others, then
    the greatest.  Words without a text are left out, entries without one stay: they hide others.
    """
    told = F.struct(*(order or ((F.col("src").eqNullSafe(manual)).alias("_m"), F.coalesce("he", F.lit("")).alias("_h"))), F.coalesce("he", F.lit("")).alias("he"), F.col("src").eqNullSafe(manual).alias("manual"))
    return mapping.filter("en <> ''").groupBy("category", "en").agg(F.max(told).alias("x")).select("category", "en", F.when(F.col("x.he") != "", F.col("x.he")).alias("he"), "x.manual")


def with_players(dictionary: DataFrame, players: DataFrame, en: str = "name_english", he: str = "name_hebrew", category: str = "names") -> DataFrame:
    """The entries with players' own names where the dictionary doesn't know theirs; of repeated ones the greatest."""
    own = players.filter((F.col(en) != "") & (F.col(he) != "")).groupBy(F.col(en).alias("en")).agg(F.max(he).alias("he"))
    new = own.join(dictionary.filter(F.col("category") == category).select("en"), "en", "left_anti")
    return dictionary.unionByName(new.select(F.lit(category).alias("category"), "en", "he", F.lit(False).alias("manual")))


def _steps(path: str) -> list[str]:
    steps = re.findall(r"\[\]|\{\}|[^.\[\]{}]+", path)
    if not steps or re.sub(r"\.?(\[\]|\{\}|[^.\[\]{}]+)", "", path):
        raise ValueError(f"not a path: {path}")
    return steps


def _words(value: Column, steps: list[str], leaf: tuple[str, ...]) -> Column:
    """The words at the end of a path, as an array; its nulls and blanks find no entry.

    A field of an array's structs is taken as one array, which costs far less than a function for each element.
    """
    many = False
    for step in steps:
        if step not in ("[]", "{}"):
            value = value[step]
            continue
        if step == "{}":
            value = F.transform(value, F.map_values) if many else F.map_values(value)
        value, many = F.flatten(F.array_compact(value)) if many else value, True
    found = [value[c] for c in leaf] or [value]
    return F.coalesce(F.concat(*found), F.array().cast("array<string>")) if many else F.array(*found)


def _rewrite(value: Column, changes: list[tuple[list[str], Callable[[Column], Column]]]) -> Column:
    """The value with the changes at the ends of their paths, in order; paths that begin alike are walked once."""

    def kind(change) -> str:
        steps = change[0]
        return steps[0] if steps and steps[0] in ("[]", "{}") else "." if steps else ""

    for k, run in groupby(changes, kind):
        inner = [(steps[1:], change) if k != "." else (steps, change) for steps, change in run]
        if k == "":
            for _, change in inner:
                value = change(value)
        elif k == "[]":
            value = F.transform(value, lambda x: _rewrite(x, inner))  # noqa: B023
        elif k == "{}":
            value = F.transform_values(value, lambda _, x: _rewrite(x, inner))  # noqa: B023
        else:
            new = value
            for field in dict.fromkeys(steps[0] for steps, _ in inner):
                new = new.withField(field, _rewrite(value[field], [(steps[1:], change) for steps, change in inner if steps[0] == field]))
            value = F.when(value.isNotNull(), new)
    return value


def rewrite(df: DataFrame, dictionary: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows with every rule's words translated, in the rules' order; all look up the words as they were.

    `dictionary` is what `entries` gives.  Words without an entry, or whose entry is empty, stay.
    Null columns, arrays, elements and structs stay null.  Rows that repeat come back repeated.
    An `into` field must exist beside its word.
    """
    columns = list(df.columns)
    taken = {c.lower() for c in columns}
    name = lambda base: base if base not in taken else name(f"_{base}")
    key = name("_words_key")
    parsed = [(r, *_split(r)) for r in rules]
    categories = list(dict.fromkeys(r.category for r in rules))
    asked, maps_ = ({c: name(f"_words_{what}{i}") for i, c in enumerate(categories)} for what in ("asked", "map"))
    each = {c: [_words(F.col(f"`{column}`"), steps, leaf) for r, column, steps, leaf in parsed if r.category == c] for c in categories}
    marked = df.withColumns({asked[c]: F.sort_array(F.array_distinct(F.concat(*each[c]))) for c in categories}).withColumn(key, F.xxhash64(*asked.values()))
    # Rows of equal words share their maps; a clash of keys joins two rows' maps into one, which does no harm.
    sets = marked.select(F.col(key).alias("k"), *asked.values()).distinct()
    # Outer: for the other kind Spark adds a filter that gathers every row's words once more.
    listed = sets.select("k", F.explode_outer(F.create_map(*(x for c in categories for x in (F.lit(c), F.col(asked[c]))))).alias("category", "words"))
    words = listed.select("k", "category", F.explode_outer("words").alias("en"))
    found = words.join(dictionary.filter(F.col("he").isNotNull()), ["category", "en"])
    item = F.struct("en", F.struct("he", "manual"))
    maps = found.groupBy(F.col("k").alias(key)).agg(*(F.map_from_entries(F.collect_set(F.when(F.col("category") == c, item))).alias(maps_[c]) for c in categories))
    out = marked.join(maps, key, "left")
    entry = lambda c, w: F.try_element_at(F.col(maps_[c]), w)

    def plain(category: str):
        return lambda w: F.coalesce(entry(category, w)["he"], w)

    def first_of(category: str, fields: tuple[str, ...]):
        def change(s: Column) -> Column:
            done = s
            for f in reversed(fields):
                new = plain(category)(s[f])
                done = F.when((s[f] != "") & (new != s[f]), s.withField(f, new)).otherwise(done)
            return done

        return change

    def chosen(category: str, word: Column, there: Column) -> Column:
        e = entry(category, word)
        blank = F.coalesce(there == "", F.lit(True))
        return F.when(e["manual"], F.coalesce(e["he"], there)).otherwise(F.when(blank, F.coalesce(e["he"], there)).otherwise(there))

    changes = {c: [] for c in columns}
    for r, column, steps, _ in parsed:
        if r.into and steps:  # the word's struct holds both
            changes[column].append((steps[:-1], lambda s, r=r, f=steps[-1]: F.when(s.isNotNull(), s.withField(r.into, chosen(r.category, s[f], s[r.into])))))
        elif r.into:
            changes[r.into].append(([], lambda there, r=r, column=column: chosen(r.category, F.col(f"`{column}`"), there)))
        else:
            changes[column].append((steps, first_of(r.category, r.first) if r.first else plain(r.category)))
    return out.select(*(_rewrite(F.col(f"`{c}`"), changes[c]).alias(c) for c in columns))


def _split(rule: Rule) -> tuple[str, list[str], tuple[str, ...]]:
    column, *steps = _steps(rule.path)
    return column, steps, rule.first


#: The words of players, transfers and market values.
PLAYER = (Rule("main_position", "positions"), Rule("nationality[]", "nationalities"), Rule("name_english", "names", into="name_hebrew"), Rule("birth_place", "birth_places"), Rule("other_positions[]", "positions"))
TRANSFER = (Rule("from_club", "clubs"), Rule("to_club", "clubs"))
VALUE = (Rule("team", "clubs"),)
#: The words of matches; a line-up is a list of players, or names by position.
MATCH = (
    Rule("opponent", "clubs"), Rule("competition", "competitions"),
    *(Rule(f"goals[].{f}", "names") for f in ("scorer", "assist")), Rule("goals[].team", "clubs"),
    *(Rule(f"substitutions[].{f}", "names") for f in ("player_in", "player_out")), Rule("substitutions[].team", "clubs"),
    Rule("cards[].player", "names"), Rule("cards[].team", "clubs"),
    Rule("penalties[].player", "names"), Rule("penalties[].club", "clubs"), Rule("penalties[].team", "clubs"),
)
LISTED = ("name_hebrew", "name_english", "name")


def match_rules(df: DataFrame) -> list[Rule]:
    """The rules of those of a match table's columns and fields that it has, line-ups by their type."""
    from pyspark.sql import types as T

    def has(kind: T.DataType, steps: list[str]) -> bool:
        if not steps:
            return isinstance(kind, T.StringType)
        if steps[0] == "[]":
            return isinstance(kind, T.ArrayType) and has(kind.elementType, steps[1:])
        return isinstance(kind, T.StructType) and steps[0] in kind.names and has(kind[steps[0]].dataType, steps[1:])

    rules = [r for r in MATCH if has(df.schema, _steps(r.path))]
    for side in ("home_lineup", "away_lineup"):
        kind = df.schema[side].dataType if side in df.columns else None
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            rules.append(Rule(f"{side}[]", "names", first=tuple(f for f in LISTED if f in kind.elementType.names)))
        elif isinstance(kind, T.MapType):
            rules.append(Rule(f"{side}{{}}[]" if isinstance(kind.valueType, T.ArrayType) else f"{side}{{}}", "names"))
    return rules
