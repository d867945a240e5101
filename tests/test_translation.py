"""Nested translation, its order of precedence, and what stays as it is."""

import pytest
from pyspark.sql import functions as F

from almanac.operators import translation
from almanac.operators.translation import Rule


@pytest.fixture
def dictionary(spark):
    rows = [
        ("names", "Ann", "אן", "manual"), ("names", "Bob", "בוב", "auto"), ("names", "Bob", "", "auto"), ("names", "Cy", "", "manual"), ("names", "Di", None, None),
        ("names", "Eve", "zz", "auto"), ("names", "Eve", "aa", "manual"), ("clubs", "Ann", "מועדון", "auto"), ("clubs", "Reds", "אדומים", None), ("competitions", "Cup", "גביע", "auto"), ("names", "", "x", "manual"), ("names", None, "y", "auto"),
    ]
    return translation.entries(spark.createDataFrame(rows, "category string, en string, he string, src string"))


MATCHES = """id int, opponent string, competition string, goals array<struct<scorer:string,assist:string,team:string,minute:int>>,
    cards array<struct<player:string,team:string>>, home_lineup array<struct<name_hebrew:string,name_english:string,name:string,number:int>>, away_lineup map<string,array<string>>"""


def test_entries(spark, dictionary):
    got = {(r["category"], r["en"]): (r["he"], r["manual"]) for r in dictionary.collect()}
    assert got == {("names", "Ann"): ("אן", True), ("names", "Bob"): ("בוב", False), ("names", "Cy"): (None, True), ("names", "Di"): (None, False), ("names", "Eve"): ("aa", True), ("clubs", "Ann"): ("מועדון", False), ("clubs", "Reds"): ("אדומים", False), ("competitions", "Cup"): ("גביע", False)}
    both = translation.with_players(dictionary, spark.createDataFrame([("Di", "own"), ("Fay", "b"), ("Fay", "a"), ("Gus", ""), (None, "n")], "name_english string, name_hebrew string"))
    assert {r["en"]: r["he"] for r in both.filter("category = 'names'").collect()} == {"Ann": "אן", "Bob": "בוב", "Cy": None, "Di": None, "Eve": "aa", "Fay": "b"}


def test_matches(spark, dictionary):
    rows = [
        (1, "Ann", None, [("Ann", "Nobody", "Ann", 5), (None, "", "Reds", None), None], [], [("Ann", "Bob", "Eve", 1), ("x", "Bob", "Eve", 2), (None, "", "Eve", 3), None], {"gk": ["Ann", None, "Zed"], "df": [], "mf": None}),
        (2, "Reds", "Cup", None, [("Cy", "Nobody")], None, None),
        (2, "Reds", "Cup", None, [("Cy", "Nobody")], None, None),
        (3, "", "None", [], None, [], {}),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, MATCHES)
    rules = translation.match_rules(df)
    assert {r.path for r in rules} == {"opponent", "competition", "goals[].scorer", "goals[].assist", "goals[].team", "cards[].player", "cards[].team", "home_lineup[]", "away_lineup{}[]"}
    out = translation.rewrite(df, dictionary, rules)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = sorted((r.asDict(recursive=True) for r in out.collect()), key=lambda r: r["id"] or 0)
    plain = lambda r: (r["opponent"], r["competition"], [tuple(g.values()) if g else None for g in r["goals"]] if r["goals"] is not None else None)
    assert plain(got[1]) == ("מועדון", None, [("אן", "Nobody", "מועדון", 5), (None, "", "אדומים", None), None])
    assert [tuple(p.values()) if p else None for p in got[1]["home_lineup"]] == [("אן", "Bob", "Eve", 1), ("x", "בוב", "Eve", 2), (None, "", "aa", 3), None]
    assert got[1]["away_lineup"] == {"gk": ["אן", None, "Zed"], "df": [], "mf": None}
    assert got[2] == got[3] and plain(got[2]) == ("אדומים", "גביע", None) and got[2]["cards"] == [{"player": "Cy", "team": "Nobody"}]
    assert plain(got[4]) == ("", "None", []) and got[4]["away_lineup"] == {} and set(got[0].values()) == {None}


def test_provenance(spark, dictionary):
    """A reviewer's name beats an existing one, an empty reviewer's entry changes nothing, others fill blanks only."""
    rows = [("Ann", "old"), ("Ann", None), ("Bob", "old"), ("Bob", ""), ("Bob", None), ("Cy", "old"), ("Cy", ""), ("Di", None), ("Eve", None), ("Zed", "old"), (None, "old"), ("", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name_english string, name_hebrew string")
    want = ["אן", "אן", "old", "בוב", "בוב", "old", "", None, "aa", "old", "old", None]
    rule = Rule("name_english", "names", into="name_hebrew")
    assert [r["name_hebrew"] for r in translation.rewrite(df, dictionary, [rule]).orderBy("i").collect()] == want
    inside = df.select("i", F.array(F.struct("name_english", "name_hebrew"), F.lit(None)).alias("squad"), F.lit("x").alias("_words_key"))
    out = translation.rewrite(inside, dictionary, [Rule("squad[].name_english", "names", into="name_hebrew")]).orderBy("i").collect()
    assert [r["squad"][0]["name_hebrew"] for r in out] == want and all(r["squad"][1] is None and r["_words_key"] == "x" for r in out)


def test_one_join_for_all_paths(spark, dictionary):
    df = spark.createDataFrame([], MATCHES)
    out = translation.rewrite(df, dictionary, translation.match_rules(df))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and out.count() == 0  # to the dictionary, and of the maps to their rows
    with pytest.raises(ValueError):
        translation.rewrite(df, dictionary, [Rule("goals[].", "names")])


def test_words_are_gathered_once_and_columns_walked_once(spark, dictionary):
    df = spark.createDataFrame([], MATCHES)
    plan = translation.rewrite(df, dictionary, translation.match_rules(df))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "array_distinct" in line]  # the words of each row, only to see if there are any
    assert "transform(transform(" not in plan.replace("flatten(", "")  # goals have three rules, cards two


def test_deeper_paths(spark, dictionary):
    kind = "i int, a array<struct<m:map<string,string>,l:array<struct<c:string>>>>, g array<array<string>>, s struct<b:array<struct<c:string,d:string>>>, h array<map<string,array<string>>>"
    rows = [
        (1, [({"x": "Ann", "y": None, "z": ""}, [("Reds",), None, (None,)]), None, (None, None)], [["Ann", None], None, [], ["Zed"]], ([("Ann", "Ann"), None, ("Reds", "Eve")],), [{"p": ["Bob", None], "q": None}, None]),
        (2, None, None, None, None),
        (3, [], [], (None,), []),
    ]
    rules = [Rule("a[].m{}", "names"), Rule("a[].l[].c", "clubs"), Rule("g[][]", "names"), Rule("s.b[].c", "clubs"), Rule("s.b[].c", "names", into="d"), Rule("h[]{}[]", "names")]
    df = spark.createDataFrame(rows, kind)
    out = translation.rewrite(df, dictionary, rules)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = sorted((r.asDict(recursive=True) for r in out.collect()), key=lambda r: r["i"])
    assert got[0]["a"] == [{"m": {"x": "אן", "y": None, "z": ""}, "l": [{"c": "אדומים"}, None, {"c": None}]}, None, {"m": None, "l": None}]
    assert got[0]["g"] == [["אן", None], None, [], ["Zed"]] and got[0]["h"] == [{"p": ["בוב", None], "q": None}, None]
    assert got[0]["s"] == {"b": [{"c": "מועדון", "d": "Ann"}, None, {"c": "אדומים", "d": "Eve"}]}
    assert got[1:] == [r.asDict(recursive=True) for r in df.filter("i > 1").orderBy("i").collect()]


def test_clashing_keys(spark, dictionary, monkeypatch):
    """All rows share one key: their maps are joined into one, and each row still finds its own words."""
    rows = [(1, "Ann", "Ann", None), (2, "Ann", "Reds", "Bob"), (3, "Eve", "Reds", ""), (4, None, None, None), (5, "Zed", "", "Ann")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    rules = [Rule("a", "names"), Rule("b", "clubs"), Rule("c", "names")]
    want = translation.rewrite(df, dictionary, rules).orderBy("id").collect()
    monkeypatch.setattr(translation.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert translation.rewrite(df, dictionary, rules).orderBy("id").collect() == want
    assert [tuple(r)[1:] for r in want[:3]] == [("אן", "מועדון", None), ("אן", "אדומים", "בוב"), ("aa", "אדומים", "")]
