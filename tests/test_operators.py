"""Joins, merges and ordered operators on small cases with known answers."""

import os

import pytest

from pyspark.sql import functions as F

from almanac.functions import sections
from almanac.operators import joins, merges, ordered, wiki
from almanac.plans import ask, marts, schemas
from almanac.sources import files
from almanac.streaming import state


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_merge_rules(spark):
    schema = "season string, ord int, id string, name_english string, current_squad boolean, current_jersey_number int, birth_date string, nationality array<string>, homegrown boolean, retired boolean"
    data = [
        ("2023", 0, "1", "Old Name", True, 7, "1999-01-05", ["Israel"], False, None),
        ("2024", 0, "1", "New Name", True, 8, "", [], True, False),
        ("2024", 1, "1", "Newer", False, None, None, None, False, False),
        ("2024", 0, "2", "Only", True, 1, None, [], False, None),
    ]
    out = merges.merge_seasons(spark.createDataFrame(data, schema), last_truthy=["birth_date", "nationality"])
    assert rows(out, "id") == [("1", "Old Name", False, None, "1999-01-05", ["Israel"], True, False, ["2023", "2024"]), ("2", "Only", True, 1, None, [], False, False, ["2024"])]


def test_distinct_rows_with_maps(spark):
    a = spark.createDataFrame([(1, {"x": "1", "y": "2"})], "k int, m map<string,string>")
    b = spark.createDataFrame([(1, {"y": "2", "x": "1"}), (1, {"x": "2"})], "k int, m map<string,string>")
    assert merges.distinct_rows(a, b).count() == 2


def test_top_before_and_after(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 5), (4, 0)], "k int, v int")
    assert rows(ordered.top_k(df, "v", 3, ["k"]), "rank") == [(2, 5, 1), (3, 5, 2)]
    assert rows(ordered.top_k(df, "v", 3, ["k"], positive="after"), "rank") == [(2, 5, 1), (3, 5, 2)]
    assert ordered.top_k(df, "v", 3, ["k"], positive="no").count() == 3
    assert ordered.top_k(df.filter("v > 9"), "v", 3, ["k"]).count() == 0


def test_pick_keeps_nulls_of_the_picked_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "k string, o int, v string")
    assert rows(ordered.pick(df, ["k"], ["o"])) == [("a", 2, None)]
    assert rows(ordered.pick(df, ["k"], ["o"], last=False)) == [("a", 1, "x")]


def test_populated_prefix(spark):
    df = spark.createDataFrame([(2021, 20), (2022, 30), (2023, 4), (2024, 29)], "y int, n int")
    assert rows(ordered.populated_prefix(df, "y", "n", 15)) == [(2021, 20), (2022, 30)]
    assert ordered.populated_prefix(df, "y", "n", 1).count() == 4
    assert ordered.populated_prefix(df, "y", "n", 50).count() == 0


def test_overlay(spark):
    base = spark.createDataFrame([("1", "A", "old"), ("2", "B", "kept")], "id string, name string, role string")
    top = spark.createDataFrame([("1", "X", "new"), ("2", "Y", ""), ("3", "C", "staff")], "id string, name string, role string")
    assert rows(joins.overlay(base, top, "id", ["role"])) == [("1", "A", "new"), ("2", "B", "kept"), ("3", "C", "staff")]


def test_names_fall_back(spark):
    df = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "id string")
    names = spark.createDataFrame([("1", "A"), ("2", ""), ("1", "A")], "id string, n string")
    assert rows(joins.with_name(df, names, "id", "n")) == [(None, "Unknown"), ("1", "A"), ("2", "2"), ("3", "3")]


def test_translate_arrays_keep_order(spark):
    df = spark.createDataFrame([(1, ["b", "a", "z", "b"]), (2, [])], "k int, xs array<string>")
    mapping = spark.createDataFrame([("c", "a", "A"), ("c", "b", "B"), ("d", "z", "Z"), ("c", "z", "")], "category string, en string, he string")
    assert rows(joins.translate_array(df, mapping, "xs", "c", ["k"])) == [(1, ["B", "A", "z", "B"]), (2, [])]


def test_zip_lists(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"], ["1", "2", "3"]), (2, [], ["1"])], "k int, l array<string>, r array<string>")
    assert rows(joins.zip_lists(df, ["k"], "l", "r")) == [(1, "a", "3"), (1, "b", "2")]


def test_combined_names_and_chain(spark):
    mapping = spark.createDataFrame([("names", "A", "א"), ("names", "B", "")], "category string, en string, he string")
    players = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "ג"), ("D", None)], "name_english string, name_hebrew string")
    assert rows(joins.combined_names(mapping, players)) == [("A", "א"), ("C", "ג")]
    keys = spark.createDataFrame([("A",), ("B",), ("C",)], "en string")
    first = spark.createDataFrame([("A", "1"), ("B", "")], "en string, he string")
    second = spark.createDataFrame([("A", "9"), ("B", "2")], "en string, he string")
    assert rows(joins.fallback_chain(keys, [("m", first), ("w", second)])) == [("A", "1", "m"), ("B", "2", "w"), ("C", None, None)]


def test_anti_joins(spark):
    recent = spark.createDataFrame([("u1", 1), (None, 2), ("u2", 3)], "url string, k int")
    related = spark.createDataFrame([("u1",), (None,)], "url string")
    assert sorted(r["k"] for r in joins.not_in_related(recent, related).collect()) == [2, 3]


def test_fill_and_sections(spark):
    have = spark.createDataFrame([("a", "1")], "k string, v string")
    more = spark.createDataFrame([("a", "2"), ("b", "4"), ("b", "3")], "k string, v string")
    assert rows(merges.fill_missing(have, more, ["k"])) == [("a", "1"), ("b", "3")]
    old = spark.createDataFrame([("p", "x", 0, "x1"), ("p", "y", 1, "y1")], "page string, section string, ord int, text string")
    new = spark.createDataFrame([("p", "z", 0, "z2"), ("p", "y", 1, "y2")], "page string, section string, ord int, text string")
    got = [(r["section"], r["text"]) for r in merges.keyed_overlay(old, new).orderBy("place").collect()]
    assert got == [("x", "x1"), ("y", "y2"), ("z", "z2")]


def test_coaches(spark):
    standings = spark.createDataFrame([("2015", "26280", "B", "18", "8", "7"), ("2016", "26280", "B", "20", "x", "5"), ("2017", "1", "C", "1", "1", "1"), ("2018", "", "D", "1", "1", "1")], "season string, manager_id string, manager_name string, wins string, draws string, losses string")
    honours = spark.createDataFrame([("Champion", ["15/16", "16/17", "xx"]), ("Cup", ["2016/17"])], "competition string, seasons array<string>")
    staff = spark.createDataFrame([("1", "C2", "Manager", "", "2026", "1.5"), ("9", "S", "Assistant", "a", "", "")], "id string, name string, role string, tenure_start string, tenure_end string, ppm string")
    got = {r["id"]: r for r in marts.coaches(standings, honours, staff).collect()}
    assert got["26280"]["played"] == 58 and got["26280"]["wins"] == 38
    assert got["26280"]["trophies"] == ["Champion 2015/16", "Champion 2016/17", "Cup 2016/17"]
    assert (got["1"]["name"], got["1"]["role"], got["1"]["tenure_end"], got["1"]["trophies"]) == ("C", "Manager", "2026", [])
    assert (got["9"]["name"], got["9"]["role"], got["9"]["tenure_seasons"]) == ("S", "Assistant", [])


def test_dictionaries(spark):
    merged = files.dictionary(spark, "clubs:\n  A: {he: a, src: manual}\n  B: {he: b, src: auto-llm}\n  C: plain\n")
    cycles = files.dictionary(spark, "clubs:\n  A: {he: x, src: wikidata}\n  B: {he: y, src: wikidata}\n  C: {he: z}\n  D: {he: d}\n").selectExpr("*", "'2024' as cycle")
    got = {r["en"]: r["he"] for r in marts.merged_dictionary(merged, cycles).collect()}
    assert got == {"A": "a", "B": "y", "C": "plain", "D": "d"}
    assert files.dictionary(spark, files.dictionary_text(merged)).exceptAll(merged).isEmpty()
    filled = marts.filled_dictionary(files.dictionary(spark, "names:\n  A: {he: ''}\n  Dan: {he: ''}\n  E: {he: e, src: manual}\n"), [("wikidata", spark.createDataFrame([("names", "A", "אא"), ("names", "E", "no")], "category string, en string, he string"))])
    assert {r["en"]: (r["he"], r["src"]) for r in filled.collect()} == {"A": ("אא", "wikidata"), "Dan": ("דאנ", "auto-translit"), "E": ("e", "manual")}


def test_derbies_and_campaigns(spark):
    table = spark.createDataFrame([("M. Tel Aviv", "1", 10, 5), ("Other", "2", 30, 3), ("Zero", "3", 0, 0)], "opponent string, opponent_tm_id string, played int, wins int")
    rivals, others = marts.derbies(table)
    assert {r["display"]: r["played"] for r in rivals.collect()}["מכבי תל אביב"] == 10 and rivals.count() == 4
    assert [(r["opponent"], r["win_pct"]) for r in others.collect()] == [("Other", 10.0), ("Zero", None)]
    fixtures = spark.createDataFrame([("2016", "Europa League"), ("2016", " Europa League "), ("2017", "Europa League"), ("2017", "Cup"), ("2017", None)], "season string, competition string")
    assert rows(marts.campaigns(fixtures)) == [(None, None, 3, 2), ("Europa League", None, 3, 2), ("Europa League", "2016", 2, 1), ("Europa League", "2017", 1, 1)]
    assert marts.campaigns(fixtures.filter("season = '2020'")).count() == 0


def test_schemas_refuse_reserved_names():
    for t in schemas.TABLES.values():
        assert t.ddl().startswith("CREATE TABLE")
    with pytest.raises(ValueError, match="reserved"):
        schemas.Table("x", "matches int").ddl()


def test_ask_language(spark):
    df = spark.createDataFrame([(1, ["Players"], "GK", ["a", "b"]), (2, ["Players", "Old"], "DF", []), (3, [], "GK", ["c"])], "id int, categories array<string>, position string, tags array<string>")
    assert rows(ask.execute(df, "[[Category:Players]][[Position::GK]]|?id|?tags=T", ["id"])) == [("1", "a, b")]
    assert ask.execute(df, "[[tags::c]]", ["id"]).count() == 1
    for bad in ("", "|?id", "[[Category:A]] words"):
        with pytest.raises(ValueError):
            ask.execute(df, bad, ["id"])
    assert ask.serialize(ask.parse("[[Category:A]] [[P::v]] |?x |?y=z")) == "[[Category:A]][[P::v]]|?x|?y=z"
    assert ask.incomplete("[[Pos::G") == {"stage": "value", "property": "Pos", "fragment": "G"}
    assert ask.incomplete("[[cat") == {"stage": "property", "fragment": "cat"}
    assert ask.incomplete("[[Category:Pl") == {"stage": "category", "fragment": "Pl"}
    assert ask.incomplete("|?na") == {"stage": "printout", "fragment": "na"} and ask.incomplete("|?n|?m") == {"stage": "printout", "fragment": "n"}
    assert ask.incomplete("[[A::b]]|?na") is None and ask.incomplete("") is None
    assert ask.incomplete("[[category:Pl") == {"stage": "property", "fragment": "category:Pl"}
    assert ask.incomplete("[[A::b]] [[C:: d ") == {"stage": "value", "property": "C", "fragment": " d "}
    assert ask.incomplete("[[a [[b]] [[c") == {"stage": "property", "fragment": "c"}
    assert ask.incomplete("[[A::b]]") is None
    assert [r[0] for r in ask.suggest(df, "position", "g").collect()] == ["GK"]
    assert ask.search(df, "gk", "id", "position").count() == 2


def _section(name, body):
    start, end = sections.marks(name)
    return f"{start}{body}{end}"


def test_sections_are_spliced():
    old = "top " + _section("a", "1") + " mid " + _section("b", "2") + " end"
    new = _section("b", "22") + _section("c", "3") + "ignored"
    assert sections.splice(old, new) == "top " + _section("a", "1") + " mid " + _section("b", "22") + " end\n" + _section("c", "3")
    assert sections.splice(sections.splice(old, new), new) == sections.splice(old, new)
    start, end = sections.marks("a")
    assert sections.spans(start) == [] and sections.spans(end + start) == [] and sections.spans(end) == []
    twice = start + "x" + end + start + "y" + end
    assert [twice[a:b] for a, b, _ in sections.spans(twice)] == [start + "x" + end]
    with pytest.raises(ValueError):
        sections.marks("1 x")


def test_page_merging(spark):
    old = "note " + _section("a", "1")
    rows = [("p", old, _section("a", "2"), "fixed a typo"), ("q", old, "all new", "Auto-import: x"), ("r", None, "first", None), ("s", old, _section("a", "1"), "Auto-merge: y"), ("t", " ", "blank", "by hand")]
    got = {r["title"]: (r["content"], r["action"]) for r in sections.merge_pages(spark.createDataFrame(rows, "title string, existing string, new string, summary string")).collect()}
    assert got == {"p": ("note " + _section("a", "2"), "surgical_merge"), "q": ("all new", "clean_rewrite"), "r": ("first", "clean_rewrite"), "s": (old, "no_change"), "t": ("blank", "clean_rewrite")}


def test_seed_pages(spark):
    seeds = spark.createDataFrame([("a",), ("b",), ("c",)], "title string")
    there = spark.createDataFrame([("b", "Auto-import: content update"), ("c", "by hand")], "title string, summary string")
    plan = lambda forced: {r["title"]: r["action"] for r in state.seed_plan(seeds, there, forced).collect()}
    assert plan(True) == {"a": "created", "b": "updated", "c": "preserved"}
    assert plan(False) == {"a": "created", "b": "skipped", "c": "skipped"}


def test_seeds_of_one_title(spark):
    """Every seed gives one row, whatever repeats, and pages of one title are told apart by another key."""
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (None, "b")], "id long, title string")
    there = spark.createDataFrame([(1, "Auto-import: x"), (3, "by hand"), (3, "Auto-import: x"), (None, "by hand")], "id long, summary string")
    plan = lambda forced: sorted((r["title"] or "", r["action"]) for r in state.seed_plan(seeds, there, forced, key="id").collect())
    assert plan(True) == [("", "created"), ("", "preserved"), ("a", "created"), ("a", "updated"), ("b", "created")]
    assert plan(False) == [("", "created"), ("", "skipped"), ("a", "created"), ("a", "skipped"), ("b", "created")]
    by_title = spark.createDataFrame([("a", "by hand"), ("a", "Auto-import: x")], "title string, summary string")
    assert sorted(r["action"] for r in state.seed_plan(seeds, by_title, True).collect()) == ["created", "created", "created", "preserved", "preserved"]


def test_vendors_of_one_name(spark, tmp_path):
    from almanac.plans import shop
    from almanac.plans.registry import oracle_sql
    from tests.oracle import check

    rows = [(i, name, 1, 0.0) for i, name in [(0, "x"), (1, "x"), (2, "x"), (3, "x"), (4, None), (6, None), (None, "y"), (5, "y")]]
    spark.createDataFrame(rows, "vendor_id long, name string, nation_id int, balance double").write.parquet(f"{tmp_path}/vendors.parquet")
    for t in [t for t in os.listdir("/root/testdata/sf0.001") if t != "vendors.parquet"]:
        os.symlink(f"/root/testdata/sf0.001/{t}", f"{tmp_path}/{t}")
    check(spark, str(tmp_path), shop.seeds_again, oracle_sql()["seeds_again"])


def test_entity_types(spark):
    rows = [(["Q5"], ["Q2736"], ""), (["Q5"], [], "Israeli footballer"), (["Q5"], [], "painter"), ([], [], "football"), (None, None, None), (["Q11410"], [], "")]
    df = spark.createDataFrame(rows, "c array<string>, s array<string>, d string")
    kinds = {k: [r[0] for r in df.select(wiki.is_of_type(F.col("c"), F.col("s"), F.col("d"), k)).collect()] for k in ("player", "club", "competition")}
    assert kinds == {"player": [True, True, False, False, False, False], "club": [False] * 5 + [True], "competition": [False, True, False, False, False, False]}


def test_newest_populated(spark):
    from almanac.operators import ordered

    df = spark.createDataFrame([(2020, 20), (2021, 19), (2022, 1), (2023, 30)], "season int, n int")
    assert ordered.newest_populated(df, "season", "n", 10) == 2021
    with pytest.raises(ValueError):
        ordered.newest_populated(df, "season", "n", 25)


def test_formats(spark):
    from almanac.functions import scalars as S

    df = spark.createDataFrame([(1, 3, 1234567, ["a", None, "b"]), (0, 0, None, [])], "w int, p int, n long, xs array<string>")
    assert [tuple(r) for r in df.select(S.percent_text("w", "p"), S.thousands("n"), S.listed("xs")).collect()] == [("33.3%", "1,234,567", "a, b"), ("—%", None, "")]


def test_total_rank_over_many_tasks(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1009).alias("v"), "id", F.when(F.col("id") % 9 == 0, None).otherwise(1).alias("_id"))
    ranked = ordered.total_rank(df.repartition(7), [F.desc("v"), "id"], "place")
    assert ranked.columns == ["v", "id", "_id", "place"]
    want = sorted(((r["v"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["v"], r["id"]) for r in ranked.orderBy("place").collect()] == want
    assert sorted(r["place"] for r in ranked.collect()) == list(range(1, 3001))
    assert ordered.total_rank(df.limit(0), ["id"]).count() == 0
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_as_of_hands_rows_on_between_tasks(spark, hot):
    import random

    rng = random.Random(3)
    key = lambda: "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
    time = lambda: rng.choice([None, *range(40)])
    left = [(i, key(), time()) for i in range(600)]
    right = [(i, key(), time(), rng.choice([None, f"v{i}"])) for i in range(150)]
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "n int, k string, t int, v string")
    got = {x["i"]: (x["v"], x["n"], x["since"]) for x in ordered.as_of(l.repartition(5), r, "k", "t", "t", ["v", "n"], ["n"], time="since").collect()}
    want = {}
    for i, k, t in left:
        found = max(((u, n, v) for n, j, u, v in right if k is not None and j == k and t is not None and u is not None and u <= t), default=None, key=lambda x: x[:2])
        want[i] = (found[2], found[1], found[0]) if found else (None, None, None)
    assert got == want
    assert ordered.as_of(l, r.limit(0), "k", "t", "t", ["v"], ["n"]).filter("v IS NULL").count() == 600 and ordered.as_of(l.limit(0), r, "k", "t", "t", ["v"], ["n"]).count() == 0
