"""Rolling medians against SQL and brute force."""

import datetime as dt
import random

import numpy as np
import pytest

from almanac.llm import queries, rolling_median
from tests.oracle import check


def test_sql(spark, small):
    check(spark, small, queries.op12_rolling_median, rolling_median.SQL)


@pytest.mark.parametrize("weighted", [False, True])
def test_trie_against_sorting(weighted):
    rng = np.random.default_rng(3)
    values = rng.integers(-900, 900, 300) * rng.integers(1, 5, 300)
    weights = rng.integers(1, 4, 300) if weighted else None
    trie = rolling_median.Trie(values, weights)
    a = rng.integers(0, 290, 200)
    b = a + rng.integers(0, 10, 200)
    full = [np.sort(np.repeat(values[x:y], weights[x:y] if weighted else 1)) for x, y in zip(a, b, strict=True)]
    n, median2, mad4 = rolling_median.medians(trie, a, b)
    for i, v in enumerate(full):
        assert n[i] == len(v)
        if len(v):
            m = v[(len(v) - 1) // 2] + v[len(v) // 2]
            d = np.sort(np.abs(2 * v - m))
            assert (median2[i], mad4[i]) == (m, d[(len(d) - 1) // 2] + d[len(d) // 2])
    for bound in (-10_000, -3, 0, 7, 10_000):
        assert trie.below(a, b, np.full(len(a), bound)).tolist() == [int((v < bound).sum()) for v in full]


def brute(rows, minutes=60):
    """Rows are (id, time in microseconds, kind, cents), one an id."""
    out = {}
    for i, t, k, c in rows:
        w = sorted(x[3] for x in rows if x[2] == k and t - minutes * 60_000_000 < x[1] <= t and x[3] is not None)
        n, m, d = len(w), None, None
        if n > 1:
            m = w[(n - 1) // 2] + w[n // 2]
            e = sorted(abs(2 * x - m) for x in w)
            d = e[(n - 1) // 2] + e[n // 2]
        out[i] = (k, n, m, d, None if m is None or c is None else 2 * abs(2 * c - m) > 3 * d)
    return out


def made(spark, rows, extra=""):
    base = dt.datetime(2024, 3, 31)
    data = [(i, None if t is None else base + dt.timedelta(microseconds=t), k, v, "x", 1) for i, t, k, v in rows]
    return spark.createDataFrame(data, "click_id long, ts timestamp_ntz, kind string, value double, part string, own int")


@pytest.mark.parametrize("most", [10**6, 40])
def test_brute_force_with_dense_chunks(spark, most):
    """Half of the clicks lie within minutes, so with a small bound parts are shorter than the window."""
    rng = random.Random(5)
    rows = []
    for i in range(500):
        t = rng.randrange(0, 9 * 3_600_000_000, 60_000_000) + rng.choice((0, 0, 1)) if i % 2 else 5 * 3_600_000_000 + rng.randrange(0, 900_000_000, 500_000)
        rows.append((i, t, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, -5.0, 0.01, 3.0, 3.0, rng.uniform(-90, 4000), 1e9])))
    base = int(dt.datetime(2024, 3, 31, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    want = brute([(i, base + t, k, None if v is None else int(np.floor(v * 100 + 0.5))) for i, t, k, v in rows])
    got = rolling_median.rolling(made(spark, rows), most=most, rows=60).collect()
    assert {r["click_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


def test_defined_cases(spark):
    rows = [(1, 0, "a", 1.0), (1, 0, "a", 1.0), (2, 0, "a", float("nan")), (3, None, "a", 5.0), (4, 0, "a", 2.0), (None, 5, "a", 3.0), (5, 0, None, 1.0), (6, 3_600_000_000, "a", 9.0), (7, -1, None, float("inf"))]
    got = {r["click_id"]: tuple(r)[1:] for r in rolling_median.rolling(made(spark, rows)).collect()}
    assert got == {
        1: ("a", 2, 300, 200, False), 2: ("a", 2, 300, 200, None), 4: ("a", 2, 300, 200, False), None: ("a", 3, 400, 400, False),
        5: (None, 1, None, None, None), 6: ("a", 2, 1200, 1200, False), 7: (None, 0, None, None, None),
    }
    assert rolling_median.rolling(made(spark, [])).count() == 0
