"""Near copies by exact similarity against brute force, and the pipeline's stage over them."""

import random

import numpy as np

import corpus_pipeline
from almanac.llm import shingles, simhash


def brute_sets(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(rows, similarity=(4, 5)):
    sets = [brute_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if similarity[1] * len(a & sets[j]) >= similarity[0] * len(a | sets[j]) and bool(a) == bool(sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def edited(rnd, words, n):
    out = list(words)
    for i in rnd.sample(range(len(out)), n):
        out[i] = f"new{rnd.random()}"
    return out


def corpus():
    rnd = random.Random(12)
    rows = []
    for _ in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(40, 300))]
        rows.append(base)
        rows += [edited(rnd, base, rnd.randint(1, max(1, len(base) // 40))) for _ in range(3)]
    chain = [f"c{i}" for i in range(120)]
    for _ in range(30):  # neighbours are near, ends are not
        rows.append(chain)
        chain = edited(rnd, chain, 2)
    rnd.shuffle(rows)
    texts = [" ".join(r) for r in rows]
    out = list(enumerate(texts, 10))
    return [*out, (3, texts[0].upper()), (None, texts[1]), (None, "no id at all"), (None, "no id at all"), (4, None), (5, " \n"), (6, "a b"), (7, "A\tb"), (8, "a b c"), (9, "one text"), (9, "another text"), (9, "one text")]


def test_shingles_of_a_text():
    of = shingles.shingler()
    for text in (None, "", "a", "a b c d", "a b c d e", "A b c d e f", "x y " * 40):
        assert len(of(text)) == len(brute_sets(text))
    assert len(np.intersect1d(of("p q r s t u"), of("q r s t u v"))) == 1 and of("a b").tolist() != of("b a").tolist()


def test_keep_one_is_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component string")
    out = simhash.keep_one(df, width=5, budget=3, similarity=0.8)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == brute_kept(rows)
    assert simhash.keep_one(df.filter("doc_id < 0"), width=5, budget=3, similarity=0.8).count() == 0


def test_stage_finds_copies_of_the_stated_similarity(spark, small):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rnd, base, 5)))]
    pairs = [(brute_sets(a[1]), brute_sets(b[1])) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in pairs)
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), small).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 120, 2))


def test_large_families_in_small_cells(spark, monkeypatch):
    """Bands of more members than a cell holds: one family of near copies, and others that share its bands."""
    monkeypatch.setattr(shingles.across, "__defaults__", (4,))
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(edited(rnd, base, 1)) for _ in range(40)] + [" ".join(edited(rnd, base, 7)) for _ in range(25)]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(df, width=5, budget=3, similarity=0.8).collect()
    assert sorted((False, r["doc_id"]) for r in got) == brute_kept(rows)


def test_unlinked_families_send_no_sets(spark, monkeypatch):
    """Texts that share bands but are never near: sketches rule them out, and many cells hold their family."""
    monkeypatch.setattr(shingles.across, "__defaults__", (8,))
    asked, of_nodes = [], shingles.of_nodes

    def counted(texts, keys, nodes):
        asked.append(nodes.select("node").distinct().count())
        return of_nodes(texts, keys, nodes)

    monkeypatch.setattr(shingles, "of_nodes", counted)
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    rows = [(i, " ".join([*passage, *(f"own{rnd.random()}" for _ in range(90))])) for i in range(90)]
    rows += [(1000 + i, " ".join(edited(rnd, [f"f{j}" for j in range(150)], 4))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(df, width=5, budget=3, similarity=0.8).collect()
    assert sorted((False, r["doc_id"]) for r in got) == brute_kept(rows)
    assert asked[0] > 40 and asked[1] <= 40  # pivots are checked first; of what is left only likely partners are asked for


def test_sketches_estimate_similarity():
    rnd = random.Random(5)
    of, low = shingles.shingler(), shingles.sketcher()
    base = [f"w{i}" for i in range(400)]
    for n in (0, 5, 20):
        a, b = of(" ".join(base)), of(" ".join(edited(rnd, base, n)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((low(a) == low(b)).mean() - true) < 0.16
    assert len(low(of(""))) == shingles.BANDS * shingles.ROWS
