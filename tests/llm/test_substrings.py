"""Removal of repeated word sequences against SQL and brute force."""

import hashlib
import random

import pytest

from almanac.llm import common, queries, substrings
from tests.oracle import check


def test_sql(spark, small):
    check(spark, small, queries.op13_substrings, substrings.SQL)


def brute(rows, width=20):
    """Rows are (id, text), ids in order and unique."""
    seen, out = set(), []
    for i, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for p in range(len(words) - width + 1):
            w = tuple(words[p : p + width])
            if w in seen:
                gone.update(range(p, p + width))
            seen.add(w)
        kept = [x for k, x in enumerate(words) if k not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def made(rng):
    pool = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [rng.choice([rng.choice(pool), " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 40))), "same word " * rng.randrange(0, 40), pool[0][10:90]]) for _ in range(rng.randrange(0, 6))]
        rows.append((i * 3 - 30, rng.choice([" ", "\n", "\t  "]).join(parts)))
    return [*rows, (900, ""), (901, None), (902, rows[40][1]), (903, "é " * 25), (904, "é x " * 25), (905, "w " * 19), (906, "long " * 3000)]


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("seed", [5, 20, 1])
def test_brute_force(spark, bits, seed):
    """With names of three bits nearly all paths are mistaken for others, and the words set that right."""
    if bits == 3 and seed != 5:
        return
    rows = made(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, name string, start int").repartition(3)
    got = sorted(tuple(r) for r in substrings.removed(df, bits=bits, seed=seed).collect())
    assert got == brute(rows)


def test_other_widths(spark):
    rows = made(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.removed(df, width=7, seed=3).collect()) == brute(rows, 7)


def test_defined_cases(spark):
    text = " ".join(map(str, range(30)))
    empty = hashlib.sha256(b"").hexdigest()
    rows = [(1, text), (1, text), (None, text), (2, text + " more"), (None, None)]
    got = sorted((tuple(r) for r in substrings.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    whole = hashlib.sha256(text.encode()).hexdigest()
    assert got == sorted([(1, 30, 0, whole), (1, 30, 0, whole), (2, 31, 30, hashlib.sha256(b"more").hexdigest()), (None, 30, 30, empty), (None, 0, 0, empty)], key=str)
    assert substrings.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_tell_their_sources(spark):
    text = " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, "head " + text), (2, text + " tail"), (3, "x " + text[: text.index(" 40")])], "doc_id long, text string")
    found = substrings.repeats(substrings._documents(df, "doc_id", "text"), 20, 5, common.Scratch(spark))
    got = sorted((r["id"], r["start"], r["stop"], r["source"]["id"], r["source"]["start"]) for r in substrings.spans(found, 20).collect())
    assert got == [(2, 0, 60, 1, 1), (3, 1, 41, 1, 1)]
