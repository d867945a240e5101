"""Randomized rows against plain restatements of the rules."""

import random

from almanac.operators import joins, merges, ordered
from almanac.streaming import windows

FIELDS = "season string, ord int, id string, name_english string, current_squad boolean, current_jersey_number int, birth_date string, birth_place string, nationality array<string>, main_position string, name_hebrew string, homegrown boolean, retired boolean"


def test_merge_on_random_seasons(spark):
    rnd = random.Random(11)
    text = lambda: rnd.choice([None, "", "a", "b", "c"])
    rows = [
        (str(rnd.randint(2000, 2004)), i, rnd.choice("pqrst"), text(), rnd.choice([True, False, None]), rnd.choice([None, 1, 2]), text(), text(), rnd.choice([None, [], ["x"], ["y"]]), text(), text(), rnd.choice([True, False, None]), rnd.choice([False, None]))
        for i in range(120)
    ]
    rnd.shuffle(rows)
    names = [x.split()[0] for x in FIELDS.split(", ")]
    want = {}
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        r = dict(zip(names, row, strict=True))
        have = want.setdefault(r["id"], {**r, "homegrown": False, "retired": False, "seasons_active": []})
        for f in merges.LAST:
            have[f] = r[f]
        for f in merges.LAST_TRUTHY:
            have[f] = r[f] or have[f]
        for f in merges.ANY:
            have[f] = have[f] or bool(r[f])
        if r["season"] not in have["seasons_active"]:
            have["seasons_active"].append(r["season"])
    got = {r["id"]: r.asDict() for r in merges.merge_seasons(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {k: {f: v for f, v in r.items() if f not in ("season", "ord")} for k, r in want.items()}


def test_picks_and_fills_on_random_rows(spark):
    rnd = random.Random(12)
    rows = [(rnd.randint(0, 9), i, rnd.choice([None, 1, 2, 3])) for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v int")
    by = {k: sorted((o, v) for x, o, v in rows if x == k) for k in {r[0] for r in rows}}
    assert {(r["k"], r["o"], r["v"]) for r in ordered.pick(df, ["k"], ["o"]).collect()} == {(k, *xs[-1]) for k, xs in by.items()}
    filled = {(r["k"], r["o"]): r["f"] for r in ordered.forward_fill(df, ["k"], ["o"], "v", "f").collect()}
    for k, xs in by.items():
        last = None
        for o, v in xs:
            last = last if v is None else v
            assert filled[(k, o)] == last


def test_overlay_on_random_tables(spark):
    rnd = random.Random(13)
    make = lambda n: {str(i): (rnd.choice([None, "", "a", "b"]), rnd.choice([None, "", "x", "y"])) for i in rnd.sample(range(40), n)}
    base, top = make(25), make(25)
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "id string, name string, role string")
    want = set()
    for k in base.keys() | top.keys():
        if k not in base:
            want.add((k, top[k][0], top[k][1] or (top[k][1] if top[k][1] is None else "")))
        else:
            want.add((k, base[k][0], (top[k][1] or base[k][1]) if k in top else base[k][1]))
    got = {(r["id"], r["name"], r["role"]) for r in joins.overlay(frame(base), frame(top), "id", ["role"]).collect()}
    assert {(k, n, r or None) for k, n, r in got} == {(k, n, r or None) for k, n, r in want}


def test_alarms_on_random_periods(spark):
    rnd = random.Random(14)
    values = {i: rnd.randint(0, 9) for i in range(400) if rnd.random() < 0.9}
    df = spark.createDataFrame([(i * 300, v) for i, v in values.items()], "s long, v int").selectExpr("timestamp_seconds(s) AS start", "v")
    got = {r["n"] for r in windows.alarms(df, "start", "v", 4, 5).selectExpr("unix_timestamp(start) div 300 AS n").collect()}
    assert got == {i for i in values if all(values.get(i - j, 0) > 4 for j in range(3))}
