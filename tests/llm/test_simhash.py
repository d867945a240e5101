"""Fingerprints and groups against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from almanac.llm import common, simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, ids, budget=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= budget:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints():
    rnd = random.Random(5)
    texts = [None, "", " \n", "One", "one two", "A b\tC\x0bd", "\xa0 x\x1cy", "é 漢 🎉 é"] + [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    texts.append(" ".join(str(i % 97) for i in range(40_000)))  # more shingles than are counted at once
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def test_trie_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 8, 1500).astype(np.uint64))
    v = np.unique(np.concatenate([base, near]))
    for budget in (0, 1, 2, 3):
        got = {(int(a), int(b)) for i, j in simhash.trie_pairs(v, np.array([0, len(v)]), np.array([0]), budget, frontier=500) for a, b in zip(i, j, strict=True)}
        want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= budget}
        assert got == want


def test_groups_with_hot_buckets(spark):
    rng = np.random.default_rng(2)
    values = set(rng.integers(-(1 << 62), 1 << 62, 60).tolist())
    for center in rng.integers(-(1 << 62), 1 << 62, 3).tolist():
        for _ in range(150):
            v = center & (1 << 64) - 1
            for b in rng.integers(0, 64, 3):
                v ^= 1 << int(b)
            values.add(v - (1 << 64) if v >> 63 else v)
    values |= {0, -1, 1, -(1 << 63)}
    order = sorted(values)
    fps = spark.createDataFrame([(v,) for v in order], "fp long")
    unsigned = [v & (1 << 64) - 1 for v in order]
    want = brute_groups(unsigned, order)
    for hot in (4, 10_000):  # buckets split three times, or not at all
        parts = {r["node"]: r["component"] for r in common.connected_components(simhash.near_edges(fps, hot=hot)).collect()}
        assert [parts.get(v, v) for v in order] == want


def test_children_keep_what_they_turn(spark):
    values = [0, -1, 1, -(1 << 63), 0x0123456789ABCDEF, -0x123456789ABCDEF]
    rows = spark.createDataFrame([(7, f, v, v) for v in values for f in (0, 16, 35)], "path long, fixed int, v long, fp long")
    for n in (3, 4):
        for r in simhash._children(rows, n).collect():
            i, parent = (r["path"] - 1) % n, (r["path"] - 1) // n
            fixed = next(f for f in (0, 16, 35) if f + (64 - f) * (i + 1) // n - (64 - f) * i // n == r["fixed"] and r["fixed"] > f)
            bits = f"{r['fp'] & (1 << 64) - 1:064b}"
            low = bits[fixed:]
            at = i * (64 - fixed) // n
            assert parent == 7 and f"{r['v'] & (1 << 64) - 1:064b}" == bits[:fixed] + low[at:] + low[:at]


def test_documents(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(120)) for _ in range(12)]
    texts += [texts[0] + " end", texts[0].upper(), texts[1], None, "", "  "]
    ids = [*range(10, 10 + len(texts) - 1), None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)] + [(10, texts[0], "again")], "doc_id long, text string, component_id string")
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    texts, ids = [*texts, texts[0]], [*ids, 10]
    prints = [brute_print(t) for t in texts]
    want = sorted((str(i), f"{p:016x}", str(c)) for i, p, c in zip(ids, prints, brute_groups(prints, ids), strict=True))
    assert got == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c in brute_groups(prints, ids)})
    unnamed = df.unionByName(spark.createDataFrame([(None, "no id here at all", "a"), (None, "no id here at all", "b"), (None, texts[0], "c")], df.schema))
    assert sorted(str(r["doc_id"]) for r in simhash.keep_one(unnamed).collect()) == sorted(["None", *map(str, {c for c in brute_groups(prints, ids)})])
    assert simhash.near_duplicates(df.filter("doc_id < 0")).count() == 0


def test_rows_of_one_id_and_unlike_texts_stay(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choice("abcdefghijk") + str(rnd.randrange(50)) for _ in range(80)) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (0, texts[2]), (2, texts[2]), (2, texts[3]), (None, texts[3])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], texts.index(r["text"])) for r in kept) == [(0, 2), (1, 0), (1, 1), (2, 3)]


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, x) for x in range(201, 260)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.connected_components(chain).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and got[101] == 100 and {got[i] for i in range(200, 260)} == {200} and len(got) == 122
    assert common.connected_components(chain.filter(F.col("a") < 0)).count() == 0
    spread = {r["node"]: r["component"] for r in common.connected_components(chain, hot=5).collect()}  # the star's centre is dealt
    assert spread == got


def test_spread_join(spark):
    many = spark.createDataFrame([(i % 3 if i % 2 else 7, i) for i in range(3000)], "k int, v int")
    one = spark.createDataFrame([(0, "a"), (7, "h"), (9, "n")], "k int, name string")
    want = sorted(tuple(r) for r in many.join(one, "k").select("k", "v", "name").collect())
    assert sorted(tuple(r) for r in common.spread_join(many, one, "k", "v", hot=100).select("k", "v", "name").collect()) == want
    assert common.spread_join(many, one, "k", "v", "left_semi", hot=100).count() == len(want)
    assert common.spread_join(many.filter("v < 0"), one, "k", "v").count() == 0
