"""The archive's derived tables on small seasons with known answers."""

import datetime
import json

import pytest

from almanac.operators import merges
from almanac.plans import marts, schemas
from almanac.sources import files


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    data = [
        {
            "name_english": "A B", "profile_url": "/a-b/profil/spieler/1", "number": "7", "season": "2024", "loaned": False,
            "facts": {"Name in home country": "אב", "Foot": "Right", "Height": "1,80 m", "Date of birth/Age": "Jan 5, 1999 (25)", "Citizenship": "Israel  Cote d'Ivoire", "Contract expires": ""},
            "positions": {"main": "Centre-Back", "other": ["Left-Back", ""]},
            "market_value_history": [{"date": "2019-01-01", "value": "€1m", "team": "T"}, {"date": "2020-01-01", "value": "€2m", "team": "U"}],
            "transfers": [{"season": "24/25", "date": "2024-01-01", "from": "H. B. Sheva U19", "to": "Hapoel Beer Sheva", "fee": "loan transfer"}, {"season": "25/26", "date": "2025-07-01", "from": "Hapoel Beer Sheva", "to": "Retired", "fee": None}],
        },
        {"name_english": "C D", "profile_url": "/c-d/profil/spieler/x2", "number": "-", "season": "2024", "loaned": True, "facts": {"Name in home country": "Latin"}, "positions": {"main": None, "others": ["lost"]}, "market_value_history": [], "transfers": None},
    ]
    path = tmp_path_factory.mktemp("raw") / "players.json"
    path.write_text(json.dumps(data))
    return files.read_document(spark, str(path), schemas.RAW_PLAYER).cache()


@pytest.fixture(scope="module")
def stats(spark):
    rows = [("1", "2024", 3, 2, 1), ("1", "2023", 5, 0, 0), ("9", "2024", 1, 2, 0), ("8", "2024", 4, 0, None)]
    return marts.stats(spark.createDataFrame(rows, "player_id string, season string, appearances int, goals int, assists int"))


def test_players(raw):
    a, c = marts.players(raw, {"israel": "Israel"}).orderBy("id").collect()
    assert (a["id"], a["name_hebrew"], a["birth_date"], a["nationality"], a["current_jersey_number"]) == ("1", "אב", datetime.date(1999, 1, 5), ["Israel", "Côte d'Ivoire"], 7)
    assert (a["homegrown"], a["retired"], a["preferred_foot"], a["height_cm"], a["contract_expires"], a["current_market_value"], a["other_positions"]) == (True, True, "right", 180, None, "€2m", ["Left-Back"])
    assert (c["id"], c["name_hebrew"], c["current_squad"], c["current_jersey_number"], c["current_market_value"], c["other_positions"], c["homegrown"]) == ("x2", None, False, None, None, [], False)
    schemas.conform(marts.players(raw), "players").collect()


def test_unnested(raw):
    assert [(r["player_id"], r["season"], r["loan"]) for r in marts.transfers(raw).orderBy("season").collect()] == [("1", "24/25", True), ("1", "25/26", False)]
    assert [r["value"] for r in marts.market_values(raw).orderBy("value_date").collect()] == ["€1m", "€2m"]


def test_squad(raw, stats):
    players = marts.players(raw)
    rows = {r["id"]: r for r in marts.squad(players, stats, "2024").collect()}
    assert rows["1"]["line"] == "DF" and rows["1"]["stats"]["goals"] == 2 and rows["x2"]["line"] == "OTHER" and rows["x2"]["stats"] is None
    seasons = merges.merge_seasons(marts.players(raw).selectExpr("*", "0 as ord"))
    assert marts.squad(seasons, stats, "2024").count() == 2 and marts.squad(seasons, stats, "1999").count() == 0


def test_transfer_page(raw):
    page = lambda season: [(r["direction"], r["player_name"]) for r in marts.transfer_page(marts.transfers(raw), marts.players(raw), season).collect()]
    assert page("2024") == [("in", "אב")] and page("2025") == [("out", "אב")] and page("2030") == []


def test_season_and_leaders(raw, stats):
    players = marts.players(raw)
    assert marts.season_totals(stats, "2024").first()["goals"] == 4 and marts.season_totals(stats, "1999").first()["goals"] == 0
    assert [(r["rank"], r["player_id"], r["name"], r["goals"]) for r in marts.season_top(stats, players, "2024", "goals").orderBy("rank").collect()] == [(1, "1", "אב", 2), (2, "9", "9", 2)]
    assert [(r["player_id"], r["appearances"]) for r in marts.leaderboard(stats, players, "appearances").orderBy("rank").collect()] == [("1", 8), ("8", 4), ("9", 1)]


def test_attendance_and_pages(spark):
    rows = [("2023", 0, "Cup", "10,001", "A", "H", "2:1", "2024-01-01"), ("2023", 1, "Cup", "-", "B", "A", "2:1", None), ("2023", 2, " ", "0", "C", "H", "", None), ("2024", 0, "Unknown", None, "D", "H", "1:1", None)]
    fixtures = spark.createDataFrame(rows, "season string, ord int, competition string, attendance string, opponent string, venue string, result string, date string")
    assert [tuple(r) for r in marts.attendance(fixtures).collect()] == [("2023", 2, 10001, 5000, 10001, 0)]
    (page,) = marts.competition_pages(fixtures).collect()
    assert page["n"] == 2 and [r["outcome"] for r in page["rows"]] == ["win", "loss"] and page["rows"][0]["title"] == "01/01/2024 נגד A (Cup)"


def test_player_pages(raw, stats):
    (a,) = [r for r in marts.player_pages(marts.players(raw), marts.transfers(raw), stats, marts.market_values(raw)).collect() if r["id"] == "1"]
    assert len(a["youth_transfers"]) == 1 and a["youth_transfers"][0]["fee"] == "השאלה" and a["youth_transfers"][0]["day"] == "01/01/2024"
    assert [r["to_club"] for r in a["senior_transfers"]] == ["Retired"] and [r["season"] for r in a["stats"]] == ["2023", "2024"]
    assert a["total"]["appearances"] == 8 and [v["value"] for v in a["values"]] == ["€1m", "€2m"]
    (c,) = [r for r in marts.player_pages(marts.players(raw), marts.transfers(raw), stats, marts.market_values(raw)).collect() if r["id"] == "x2"]
    assert c["stats"] == [] and c["total"]["goals"] == 0


def test_lineups_of_either_shape(spark):
    m = spark.sql("""select 1 as k, parse_json('[{"name_english":"X","number":"9","captain":true}]') as l union all select 2, parse_json('{"gk":"Y","df":[{"name_english":"Z","tm_player_id":"5"},"W"],"manager":{"name_english":"M"}}') union all select 3, null""")
    got = sorted((r["k"], r["name"], r["position"] or "", r["captain"]) for r in marts.lineup_entries(m, ["k"], "l", "home").collect())
    assert got == [(1, "X", "", True), (2, "M", "manager", False), (2, "W", "df", False), (2, "Y", "gk", False), (2, "Z", "df", False)]


def test_dictionary_growth(spark, raw):
    players, transfers, values = marts.players(raw, {"israel": "Israel"}), marts.transfers(raw), marts.market_values(raw)
    fixtures = spark.createDataFrame([("Opp", "Cup"), ("Opp", "Unknown"), (None, None)], "opponent string, competition string")
    mapping = files.dictionary(spark, "clubs:\n  T: {he: ט, src: manual, confidence: low}\n")
    stub = marts.dictionary_stub(players, transfers, values, fixtures, spark.createDataFrame([("E F",), ("A B",)], "en string"), mapping)
    got = {(r["category"], r["en"]): r["he"] for r in stub.collect()}
    assert got[("clubs", "T")] == "ט" and got[("names", "E F")] is None and ("competitions", "Unknown") not in got
    assert {e for c, e in got if c == "clubs"} == {"T", "U", "Opp", "H. B. Sheva U19", "Hapoel Beer Sheva", "Retired"}
    assert {e for c, e in got if c == "names"} == {"A B", "C D", "E F"} and {e for c, e in got if c == "nationalities"} == {"Israel", "Côte d'Ivoire"}
    assert {(r["category"], r["n"]) for r in marts.flagged(stub).collect()} == {("clubs", 1), (None, 1)}


def test_records_and_matches(spark):
    records = spark.createDataFrame([("c", 1, "B", "2", "€1m"), ("c", 0, "A", "1", "€2m")], "category string, ord int, player_name string, player_id string, value string")
    assert [x["player_name"] for x in marts.grouped_records(records).first()["rows"]] == ["A", "B"]
    m = spark.createDataFrame([("1:0", "A", "2024-05-01", "X", "Cup")], "result string, venue string, date string, opponent string, competition string")
    assert marts.match_rows(m).first()[-3:] == ("loss", "01/05/2024 נגד X (Cup)", "01/05/2024")


def test_season_overview_names_what_is_missing(spark, raw, stats):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    fixtures, standings, squad = empty("season string, competition string"), empty("season string, competition string, points int"), empty("season string")
    r = marts.season_overview(stats, marts.players(raw), fixtures, standings, squad, "1950").first()
    assert r["missing"] == ["standings", "stats", "squad", "fixtures"] and r["goals"] == 0 and r["top_goals"] == [] and r["display"] == "1950/51"
    standings = spark.createDataFrame([("2024", "B", 1), ("2024", "A", 9)], "season string, competition string, points int")
    fixtures = spark.createDataFrame([("2024", "Cup"), ("2024", None), ("2024", "Cup")], "season string, competition string")
    r = marts.season_overview(stats, marts.players(raw), fixtures, standings, spark.createDataFrame([("2024",)], "season string"), "2024").first()
    assert r["missing"] == [] and r["standing"]["points"] == 9 and [(x["competition"], x["n"]) for x in r["fixtures"]] == [("Cup", 2), ("Unknown", 1)]


def test_match_names(spark):
    rows = [([("A", None), ("B", "A")], [("C", "")], None)]
    m = spark.createDataFrame(rows, "goals array<struct<scorer:string,assist:string>>, substitutions array<struct<player_in:string,player_out:string>>, cards array<struct<player:string>>")
    m = m.selectExpr("*", """parse_json('[{"name_english":"L"}]') AS home_lineup""", """parse_json('{"gk":"K","df":[{"name_short":"S"}]}') AS away_lineup""")
    assert sorted(r["en"] for r in marts.match_names(m).collect()) == ["A", "B", "C", "K", "L", "S"]
    assert marts.match_names(m.select("cards")).count() == 0


def test_honours_and_stadium(spark):
    honours = spark.createDataFrame([(1, "Cup", "Winner", ["19/20", "75/76"]), (0, "League", "Winner", None)], "ord int, competition string, achievement string, seasons array<string>")
    assert [tuple(r) for r in marts.honours_list(honours).orderBy("ord").collect()] == [(0, "League", "Winner", "", 0), (1, "Cup", "Winner", "19/20, 75/76", 2)]
    stadium = spark.createDataFrame([(1, "late", 5), (0, "", 4)], "ord int, name string, capacity int")
    assert tuple(marts.stadium_row(stadium).first()) == ("Stadium", 4)
