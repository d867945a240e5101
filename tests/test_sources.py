"""Readers, page extractors and state."""

import json

import pytest

from almanac.sources import files, pages
from almanac.streaming import state


def page(spark, kind, html, season="2024", base="https://x.test/"):
    df = spark.createDataFrame([(html, season, base)], "html string, season string, url string")
    return [r.asDict(recursive=True) for r in pages.extract(df, kind, "html", "season", "url").orderBy("ord").collect()]


def test_json_readers(spark, tmp_path):
    schema = "a int, b string"
    (tmp_path / "l.jsonl").write_text('{"a":1}\n\n{"a":2,"b":"x"}\n')
    (tmp_path / "arr.json").write_text('[{"a":1},{"a":2}]')
    (tmp_path / "one.json").write_text('{"a":1}')
    (tmp_path / "cat.json").write_text('[{"a":1}]\n[{"a":2},{"a":3}] [ {"a":4} ]{"a":5}')
    assert files.read_lines(spark, f"{tmp_path}/l.jsonl", schema).count() == 2
    assert files.read_document(spark, f"{tmp_path}/arr.json", schema).count() == 2
    assert files.read_document(spark, f"{tmp_path}/one.json", schema).count() == 1
    assert files.read_document(spark, f"{tmp_path}/no.json", schema).count() == 0
    assert sorted(r["a"] for r in files.read_concatenated(spark, f"{tmp_path}/cat.json", schema).collect()) == [1, 2, 3, 4, 5]
    assert files.read_lines(spark, f"{tmp_path}/no", schema).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_lines(spark, f"{tmp_path}/no", schema, missing="error")


def test_seasons_from_folders(spark, tmp_path):
    for s in ("2023", "2024"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "p.jsonl").write_text("".join(json.dumps({"id": str(i), "season": "wrong"}) + "\n" for i in range(2)))
    got = files.read_seasons(spark, str(tmp_path), "p.jsonl", "id string, season string", ["2024", "2030"])
    assert [(r["id"], r["season"]) for r in got.orderBy("ord").collect()] == [("0", "2024"), ("1", "2024")]
    assert files.read_seasons(spark, str(tmp_path), "p.jsonl", "id string").count() == 4
    with pytest.raises(FileNotFoundError):
        files.read_seasons(spark, str(tmp_path), "p.jsonl", "id string", ["1990"])
    assert files.season_list("2019-2021, 2024") == ["2019", "2020", "2021", "2024"]
    assert files.purge(spark, str(tmp_path), ["2023", "1999"]) == 1
    assert files.has_rows(spark, f"{tmp_path}/2024/p.jsonl") and not files.has_rows(spark, f"{tmp_path}/2023/p.jsonl")


def test_fixture_results(spark):
    cells = "".join(f"<td>{x}</td>" for x in ("1", "Sun 25/08/24", "20:00", "H", "", "", '<a href="/c">Opp</a>', "4-4-2", "13.000"))
    row = lambda result: f"<tr>{cells}<td>{result}</td></tr>"
    html = "<div class=box><div class=responsive-table><table><tbody><tr><td class=extrarow><a>League</a></td></tr>" + row('<a href="/r/1"><span>2:1</span></a>') + row("<a><span>5:4</span><span>on pens</span></a>") + row(" 1:1 ") + row("") + "<tr><td>short</td></tr></tbody></table></div></div>"
    got = page(spark, "fixtures", html)
    assert [r["result"] for r in got] == ["2:1", "5:4 (penalties)", "1:1", ""]
    assert {r["competition"] for r in got} == {"League"} and got[0]["match_report_url"] == "https://x.test/r/1" and got[0]["opponent"] == "Opp"


def test_squad_and_profile(spark):
    html = '<table class="items"><tbody><tr><td><div class="rn_nummer">7</div></td><td class="hauptlink"><a href="/a-b/profil/spieler/1"> A B </a></td></tr><tr><td class="hauptlink"><a>no link</a></td></tr></tbody></table>'
    assert page(spark, "squad", html) == [{"ord": 0, "name_english": "A B", "profile_url": "https://x.test/a-b/profil/spieler/1", "number": "7", "season": "2024", "loaned": False, "is_captain": False}]
    facts = '<div class="spielerdatenundfakten"><span class="info-table__content--regular">Foot:</span><span class="info-table__content--bold">right</span></div><div class="detail-position__box"><dl><dd class="detail-position__position">GK</dd></dl></div>'
    assert page(spark, "profile", facts)[0]["facts"] == {"Foot": "right"}
    assert page(spark, "profile", facts)[0]["positions"] == {"main": "GK", "other": []}


def test_json_pages(spark):
    values = json.dumps({"list": [{"datum_mw": "Dec 1, 2020", "mw": "€2m", "verein": "B"}, {"datum_mw": "01/01/2019", "mw": "€1m", "verein": "A"}, {"datum_mw": "?", "mw": "x", "verein": "C"}]})
    assert [r["date"] for r in page(spark, "market_values", values)] == ["2019-01-01", "2020-12-01"]
    assert page(spark, "market_values", "not json") == []
    moves = json.dumps({"transfers": [{"season": "24/25", "dateUnformatted": "2024-01-01", "from": {"clubName": "A"}, "to": {"clubName": "B"}, "fee": "?"}, {"dateUnformatted": None}]})
    assert [r["from"] for r in page(spark, "transfer_history", moves)] == [None, "A"]


def test_stats_by_header(spark):
    head = "<thead><tr><th colspan=2>x</th><th><a><span title='Goals'>&nbsp;</span></a></th><th title='Appearances'></th></tr></thead>"
    body = "<tbody><tr><td>1</td><td class=hauptlink><a href='/p/5'>P</a></td><td>-</td><td>1.234</td></tr><tr><td>1</td><td class=hauptlink><a href='/p/6'>Q</a></td><td colspan=2>Not used during this season</td></tr></tbody>"
    got = page(spark, "stats", f"<table class=items>{head}{body}</table>")
    assert [(r["player_id"], r["goals"], r["appearances"], r["assists"]) for r in got] == [("5", 0, 1234, 0)]


def test_tables_of_the_club(spark):
    cells = ["25/26", "", "<a>Ligat</a>", "First Tier", "10", "5", "3", "30:12", "", "35", "<b>2</b>", "<a href='/m/profil/trainer/9'>Coach</a>"]
    row = "".join(f"<td>{c}</td>" for c in cells)
    r = page(spark, "standings", f"<table class=items><tbody><tr>{row}</tr><tr><td>x</td></tr></tbody></table>")[0]
    assert (r["season"], r["tier"], r["played"], r["goals_for"], r["final_position"], r["manager_id"]) == ("2025", 1, 18, 30, 2, "9")
    cells = ["<a title='Opp' href='/o/verein/12'>O</a>", "", "<a>20</a>", "10", "-", "5", "", "", "", "12.345"]
    row = "".join(f"<td>{c}</td>" for c in cells)
    r = page(spark, "head_to_head", f"<table class=items><tbody><tr>{row}</tr></tbody></table>")[0]
    assert (r["opponent"], r["opponent_tm_id"], r["played"], r["draws"], r["avg_attendance"]) == ("Opp", "12", 20, 0, 12345)
    r = page(spark, "honours", "<div class=erfolg_bild_box><img title='Cup'></div><div class=erfolg_infotext_box>19/20,&nbsp; 75/76 ,</div><div class=erfolg_bild_box><img title='Lost'></div>")
    assert [(x["competition"], x["seasons"]) for x in r] == [("Cup", ["19/20", "75/76"])]
    r = page(spark, "stadium", "<table class=profilheader><tr><th>Name of stadium:</th><td>T</td></tr><tr><th>Total capacity:</th><td>16.126 seats</td></tr><tr><th>Address:</th><td>T</td></tr><tr><th></th><td>Street 1</td></tr></table>")[0]
    assert (r["name"], r["capacity"], r["address"]) == ("T", 16126, "Street 1")
    r = page(spark, "club_transfers", "<div class=box><h2>Arrivals 24/25</h2><table><tbody><tr><td class=hauptlink><a href='/p/profil/spieler/3'>P</a></td><td class='no-border-rechts'><img title='From FC'></td><td class=rechts>loan transfer</td></tr></tbody></table></div><div class=box><h2>Arrivals 23/24</h2></div>")
    assert [(x["player_id"], x["from_club"], x["loan"], x["direction"]) for x in r] == [("3", "From FC", True, "in")]
    r = page(spark, "records", "<title>Club - Record arrivals | X</title><table class=items><tbody><tr class=odd><td class=hauptlink><a href='/p/profil/spieler/4'>P</a></td><td class=rechts>€1m</td></tr><tr><td>y</td></tr></tbody></table>")
    assert [(x["category"], x["player_id"], x["value"]) for x in r] == [("Record arrivals", "4", "€1m")]
    r = page(spark, "coaches", "<div class=responsive-table><table><tbody><tr><td><table><tr><td class=hauptlink><a href='/c/profil/trainer/8'>C</a></td></tr><tr><td>Manager</td></tr></table></td><td class=zentriert>45</td><td class=zentriert>Jul 1, 2024</td><td class=zentriert>-</td></tr></tbody></table></div>")
    assert (r[0]["id"], r[0]["role"], r[0]["tenure_start"], r[0]["tenure_end"]) == ("8", "Manager", "Jul 1, 2024", "")


def test_match_report(spark):
    link = lambda slug, i: f"<a href='/{slug}/profil/spieler/{i}'>Short</a>"
    html = f"""<div class=sb-endstand><div class=sb-halbzeit>(1:0)</div></div><div class=sb-zusatzinfos><a href='/x/stadion/1'>Ground</a><a href='/y/schiedsrichter/2' title='Ref'></a></div>
    <div class=box><div class='large-6 columns'><div class=aufstellung-unterueberschrift-mannschaft><a>Home</a></div><div class=formation-player-container><span class=tm-shirt-number>9</span><span class=formation-number-name>{link('niv-e', 5)}</span><i class=kapitaenicon-formation></i></div></div></div>
    <div id=sb-tore><ul><li class=sb-aktion-heim><div class=sb-aktion-uhr><span style='background-position:-0px -324px'>+2</span></div><div class=sb-aktion-spielstand><b>1:0</b></div><div class=sb-aktion-aktion>{link('a-a', 1)}, Header {link('b-b', 2)}</div></li></ul></div>
    <div id=sb-karten><ul><li><div class=sb-aktion-spielstand><span class='sb-sprite sb-gelbrot'></span></div><div class=sb-aktion-aktion>{link('c-c', 3)} , Foul</div></li></ul></div>"""
    r = page(spark, "match", html)[0]
    assert (r["halftime_score"], r["aet"], r["stadium"], r["referee"], r["penalties"]) == ("1:0", True, "Ground", "Ref", None)
    assert r["home_lineup"][0]["name_english"] == "Niv E" and r["home_lineup"][0]["captain"] and r["away_lineup"] is None
    g = r["goals"][0]
    assert (g["minute"], g["extra_time"], g["scorer_tm_id"], g["assist_tm_id"], g["score"]) == (91, 2, "1", "2", "1:0")
    assert (r["cards"][0]["card"], r["cards"][0]["reason"], r["cards"][0]["team"]) == ("second_yellow", "Foul", "away")
    assert page(spark, "match", "")[0]["goals"] == []


def test_change_gate_and_state(spark):
    old = spark.createDataFrame([("a", "1", None, None), ("b", "2", None, None), ("z", "9", None, None)], "key string, fingerprint string, last_checked timestamp, last_changed timestamp")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4"), ("z", None)], "key string, fingerprint string")
    gate = state.change_gate(now, old)
    assert {r["key"]: r["status"] for r in gate.collect()} == {"a": "same", "b": "changed", "c": "new", "z": "error"}
    new = {r["key"]: r for r in state.next_state(gate, old, "2024-01-01 00:00:00").collect()}
    assert new["a"]["last_checked"] is not None and new["a"]["last_changed"] is None and new["b"]["fingerprint"] == "3"
    assert new["z"]["fingerprint"] == "9" and new["z"]["last_checked"] is None


def test_upsert_leaves_equal_rows(spark):
    old = spark.createDataFrame([("1", "X", 0, None), ("2", "Y", 3000, None)], "tm_id string, he_title string, namespace int, last_seen timestamp")
    rows = spark.createDataFrame([("1", "X", 0, 0), ("2", "Draft:Z", 3000, 0), ("3", "N", 0, 0), ("3", "M", 0, 1)], "tm_id string, he_title string, namespace int, ord int")
    got = {r["tm_id"]: r for r in state.upsert(old, rows, "2024-01-01").collect()}
    assert got["1"]["last_seen"] is None and got["2"]["he_title"] == "Z" and got["3"]["he_title"] == "M"


def test_routing(spark):
    want = spark.createDataFrame([(str(i), t, 3000) for i, t in enumerate("ABCDEFG")], "tm_id string, want_title string, want_namespace int")
    old = spark.createDataFrame([("2", "C", 3000), ("3", "Old", 3000), ("4", "Old2", 0), ("5", "Gone", 3000), ("6", "Both", 3000)], "tm_id string, he_title string, namespace int")
    there = spark.createDataFrame([("A", "Main A"), ("Draft:B", None), ("Draft:C", "Draft:C2"), ("Draft:Old", None), ("Old2", None), ("Draft:Both", None), ("Draft:G", None)], "title string, redirect string")
    got = {r["tm_id"]: (r["title"], r["action"], r["namespace"]) for r in state.route(want, old, there).collect()}
    assert got == {
        "0": ("Main A", "update", 0), "1": ("Draft:B", "update", 3000), "2": ("Draft:C2", "update", 3000), "3": ("Draft:D", "moved", 3000),
        "4": ("E", "moved", 0), "5": ("Draft:F", "stranded", 3000), "6": ("Draft:G", "update", 3000),
    }


def test_stream_state_survives_a_second_run(spark, tmp_path):
    source, schema = tmp_path / "in", "k string, o int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(str(source))
    run = lambda: state.stream_merge(spark.readStream.schema(schema).parquet(str(source)), f"{tmp_path}/s", f"{tmp_path}/c", "k", ["o"])
    run()
    spark.createDataFrame([("a", 2, "z"), ("b", 0, "late")], schema).write.mode("append").parquet(str(source))
    run()
    assert sorted(tuple(r) for r in state.read_state(spark, f"{tmp_path}/s").collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_counters_and_digest(spark):
    df = spark.createDataFrame([("s", "created"), ("s", "created"), ("t", "failed")], "step string, action string")
    assert {(r["step"], r["action"]): r["n"] for r in files.counters(df).collect()}[(None, None)] == 3
    a, b = (spark.createDataFrame([(x,) for x in p], "text string") for p in ("ab", "ba"))
    assert files.seed_digest(a).first() == files.seed_digest(b).first()
    assert json.loads(files.write_pretty(a.orderBy("text"))) == [{"text": "a"}, {"text": "b"}]
    with pytest.raises(ValueError):
        files.write_pretty(a, limit=1)


def test_a_state_can_be_stopped_anywhere(spark, tmp_path):
    """Whatever a stop leaves beside the last complete version, the next batch goes on from that one."""
    path, source, schema = f"{tmp_path}/state", tmp_path / "in", "k int, o int, v string"
    run = lambda: state.stream_merge(spark.readStream.schema(schema).parquet(str(source)), path, f"{tmp_path}/log", "k", ["o"])
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
    told = lambda: sorted(map(tuple, state.read_state(spark, path).collect()))
    assert state.read_state(spark, path) is None
    (tmp_path / "state" / "version=0").mkdir(parents=True)  # stopped before anything was written
    put([(1, 1, "a"), (2, 1, "a")])
    run()
    assert told() == [(1, 1, "a"), (2, 1, "a")]
    spark.createDataFrame([(9, 9, "half")], schema).write.parquet(f"{path}/version=1")
    (tmp_path / "state" / "version=1" / "_SUCCESS").unlink()  # stopped while it was written
    assert told() == [(1, 1, "a"), (2, 1, "a")]
    for i in range(2, 5):
        put([(1, i, "b"), (2, 0, "late")])
        run()
        assert told() == [(1, i, "b"), (2, 1, "a")]
    assert len(list((tmp_path / "state").iterdir())) == 2


def test_missing_seasons(spark, tmp_path, caplog):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "p.jsonl").write_text('{"id":"1"}\n')
    assert files.missing_seasons(spark, str(tmp_path), "p.jsonl", ["2025", "2024", "2023"]) == ["2023", "2025"]
    with caplog.at_level("WARNING"):
        assert files.read_seasons(spark, str(tmp_path), "p.jsonl", "id string", ["2023", "2024"]).count() == 1
    assert "2023" in caplog.text


def test_dictionary_text_in_order(spark):
    rows = files.dictionary(spark, "clubs:\n  Z: {he: a, src: manual}\n  B: b\n")
    assert files.dictionary_text(rows).index("B:") < files.dictionary_text(rows).index("Z:")
    text = files.dictionary_text(rows, order=[rows["he"]])
    assert text.index("Z:") < text.index("B:") and sorted(map(tuple, files.dictionary(spark, text).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        files.dictionary_text(rows, limit=1)


def test_batches_are_split_and_tried_again(spark):
    from almanac.sources import backends

    asked = []

    def ask(batch):
        asked.append(len(batch))
        if len(batch) > 2 or "long" in batch:
            raise backends.Truncated
        return [x.upper() for x in batch]

    assert backends.answered(["a", "b", "c", "long", "d"], ask) == ["A", "B", "C", None, "D"]
    assert asked[0] == 5 and max(asked[1:]) < 5 and backends.answered([], ask) == []
    left = [2]

    def flaky(batch):
        if left[0]:
            left[0] -= 1
            raise OSError("busy")
        return batch[::-1]

    assert backends.answered(["x", "y"], flaky, wait=0) == ["y", "x"]
    left[0] = 9
    with pytest.raises(OSError):
        backends.answered(["x"], flaky, attempts=2, wait=0)
    keys = spark.createDataFrame([(f"k{i % 7}",) for i in range(20)] + [(None,)], "en string")
    got = backends.translated(keys, lambda: lambda batch: [x + "!" for x in batch], size=3)
    assert sorted(tuple(r) for r in got.collect()) == [(f"k{i}", f"k{i}!") for i in range(7)]
