"""Classifiers by held-out accuracy, neighbour graphs by brute force, and the pipeline stage by stage."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from almanac.llm import nn_descent, quality_model, toxicity
from almanac.llm.common import documents, labels


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(spark, kind):
    rnd = random.Random(8)
    plain = lambda n: " ".join(rnd.choice(["rain", "river", "stone", "cloud", "field", "sings", "over"]) for _ in range(n))
    docs, marks = [], []
    for i in range(400):
        bad = rnd.random() < 0.3
        if kind == "toxic":
            sentences = [plain(rnd.randint(4, 9)) for _ in range(rnd.randint(2, 8))]
            if bad:
                sentences[rnd.randrange(len(sentences))] += " you " + rnd.choice(["grobble", "snark"])
            docs.append((i, ". ".join(sentences) + "."))
        else:
            docs.append((i, " ".join(w + "###" for w in plain(60).split()) if bad else plain(rnd.randint(20, 90))))
        marks.append((i, int(bad if kind == "toxic" else not bad)))
    docs += [(1000, None), (1001, ""), (None, plain(30)), (1002, plain(20_000)), (3, docs[3][1])]
    name = "toxic" if kind == "toxic" else "quality"
    return spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, score string"), spark.createDataFrame([*marks, (1003, None), (None, 1)], f"doc_id long, {name} int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, kind):
    docs, marks = corpus(spark, kind)
    module = toxicity if kind == "toxic" else quality_model
    rows = module.score(docs, marks).collect()
    assert len(rows) == 405 and all(0 <= r["score"] <= 1 for r in rows)
    truth = {r[0]: r[1] for r in marks.collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(400), 1000, 1001, 1002] if fold(i)}
    hits = [r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert sum(hits) >= 0.97 * len(hits)
    assert rows and len({r["score"] for r in rows if r["doc_id"] in (1000, 1001)}) == 1
    again = {(r["doc_id"], r["score"]) for r in module.score(docs, marks).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_labels_of_the_tables(spark, kind):
    sf_dir = "/root/testdata/sf0.01"
    module = toxicity if kind == "toxic" else quality_model
    truth = {r["doc_id"]: r[kind] for r in labels(spark, sf_dir).collect() if r[kind] is not None}
    held = [r for r in module.score(documents(spark, sf_dir), labels(spark, sf_dir)).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 20 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_scores_are_the_noisy_or_of_sentences():
    model = toxicity.MilModel({"bad": 4.0, "worse": 7.0, "fine": -2.0}, -3.0)
    text = "All fine here. A bad thing! Worse and bad\nfine, but bad and bad again."
    sentences = [("All fine here", -5.0), (" A bad thing", 1.0), (" Worse and bad", 8.0), ("fine, but bad and bad again", -1.0)]
    score, start, stop, worst, n, spans = model.scorer()(text)
    assert score == pytest.approx(1 - np.prod([1 - 1 / (1 + np.exp(-z)) for _, z in sentences]))
    places = [(text.index(s), text.index(s) + len(s)) for s, z in sentences if z >= 0]
    assert spans == ",".join(f"{a}:{b}" for a, b in places) and n == 2
    assert (start, stop) == places[1] and worst == pytest.approx(1 / (1 + np.exp(-8)))
    assert model.scorer()("") == (0.0, 0, 0, 0.0, 0, "")


def test_dual_descent_reaches_the_least_objective():
    rng = np.random.default_rng(4)
    y = np.array([1, 0] * 30)
    rows = [np.sort(rng.choice(8, 3, replace=False)) + (4 if t else 0) for t in y]
    values = [rng.random(3) + 0.5 for _ in rows]
    w, b = quality_model.dual_descent(rows, values, y, epochs=2000, tolerance=1e-7)
    sign = np.where(y > 0, 1.0, -1.0)

    def objective(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - s * (w[r] @ v + b)) for r, v, s in zip(rows, values, sign, strict=True))

    best = objective(w, b)
    for _ in range(300):
        step = np.zeros_like(w)
        step[:16] = rng.standard_normal(16) * rng.choice([1e-1, 1e-2, 1e-3])
        assert objective(w + step, b + rng.standard_normal() * 1e-2) >= best - 1e-6


def test_samples_are_bounded_by_their_characters(spark):
    from almanac.llm.fold import training_sample

    docs = spark.createDataFrame([(i, "x" * 10) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    assert len(training_sample(docs, marks, "quality", 1000, 100, total=75)[0]) == 7


def test_offending_sentences_are_found(spark):
    docs, marks = corpus(spark, "toxic")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, marks).collect():
        spans = [tuple(map(int, x.split(":"))) for x in r["toxic_spans"].split(",") if x]
        assert len(spans) == r["n_toxic_sentences"]
        if r["doc_id"] is not None:
            assert all("grobble" in texts[r["doc_id"]][a:b] or "snark" in texts[r["doc_id"]][a:b] for a, b in spans)
        if r["predicted"] and r["doc_id"] is not None:
            worst = texts[r["doc_id"]][r["worst_start"] : r["worst_stop"]]
            assert "grobble" in worst or "snark" in worst


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_without_labels(spark, module):
    docs, marks = corpus(spark, "toxic" if module is toxicity else "quality")
    assert {r["score"] for r in module.score(docs, marks.filter("doc_id < 0")).collect()} == {0.5}
    assert module.score(docs.filter("doc_id = 5000"), marks).count() == 0


def test_long_words_are_read_to_their_end(spark):
    grams = quality_model.Grams()
    common = "ab1" * 20
    plain, odd = (set(grams.of(common + tail).tolist()) for tail in ("cd" * 200, "#1" * 200))
    assert len(odd - plain) > 3 and set(grams.of(common + "#" + "1#" * 200 + " end").tolist()) & (odd - plain)
    assert quality_model.shape("ab1" * 20 + "#") != quality_model.shape("ab1" * 20)
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("漢字かな") for _ in range(40)) + "".join(rnd.choice("漢字かな" if i % 2 else "#$%7") for _ in range(300))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [r for r in quality_model.score(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")).collect() if r["held_out"]]
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.97 * len(held)


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.array([0, 1, 2 + int(rng.integers(3))]) if y else np.array([10, 11, 12 + int(rng.integers(3))]) for y in (1, 0) * 40]
    y = np.array([1, 0] * 40)
    w, b = quality_model.dual_descent(rows, [np.ones(3) for _ in rows], y)
    assert all((w[r].sum() + b > 0) == (t == 1) for r, t in zip(rows, y, strict=True))


def test_sampled_labels_leave_out_the_held_out_fold(spark):
    from almanac.llm.fold import training_sample

    docs = spark.createDataFrame([(i, str(i)) for i in range(300)], "doc_id long, text string")
    texts, _ = training_sample(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int"), "quality", 1000, 100)
    assert sorted(map(int, texts)) == [i for i in range(300) if not fold(i)]
    assert len(training_sample(docs, spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int"), "quality", 20, 100)[0]) == 20


def brute_links(rows, threshold=0.98):
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    units = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if k else None for r, k in zip(rows, ok, strict=True)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(str(r[0]), links[i], str(least.get(find(i))), r[0] is not None and r[0] == least[find(i)]) for i, r in enumerate(rows)]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = []

    def add(v, label):
        rows.append((len(rows) + 100, [float(np.float32(x)) for x in v], label))

    for _ in range(300):
        add(rng.standard_normal(16), int(rng.integers(3)))
    for size in (2, 3, 90):  # the last saturates its lists
        center = rng.standard_normal(16)
        for _ in range(size):
            add(center + 0.12 * rng.standard_normal(16), 1)
        add(center, 2)
    rows += [(1, rows[0][1], rows[0][2]), (2, rows[0][1], rows[0][2]), (3, None, 1), (4, [0.0] * 16, 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] + [1.0] * 15, 1), (7, [None] + [1.0] * 15, 1), (8, rows[0][1], None), (9, [], 1), (10, [1.0, 0.0], 1), (11, [2.0, 0.0], 1), (None, rows[5][1], rows[5][2]), (2, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in nn_descent.near_duplicates(df, size=32, k=4).collect())
    assert got == sorted(brute_links(rows))
    assert nn_descent.near_duplicates(df.filter("vec_id = -1")).count() == 0


def directions(rng, n, d=16):
    x = rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def beside(rng, x, degrees):
    """A unit vector at an angle to another."""
    y = directions(rng, 1, len(x))[0]
    y -= (y @ x) * x
    t = np.radians(degrees)
    return np.cos(t) * x + np.sin(t) * y / np.linalg.norm(y)


def embedded(spark, vectors):
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_saturated_groups_are_joined(spark):
    """Groups that fill each other's lists, linked by a few members on their rims."""
    rng, vectors = np.random.default_rng(6), []
    for center in directions(rng, 40):
        for c in (center, beside(rng, center, 14)):
            vectors += [beside(rng, c, 3) for _ in range(12)]
    rows, df = embedded(spark, vectors)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in nn_descent.near_duplicates(df, size=8, k=4, tables=1, rounds=1).collect())
    assert got == sorted(brute_links(rows))


@pytest.mark.parametrize("most", [8192, 4])
def test_lost_pairs_are_found_beside_a_large_component(spark, monkeypatch, most):
    rng = np.random.default_rng(7)
    center, vectors = directions(rng, 1)[0], []
    vectors += [beside(rng, center, 3) for _ in range(150)]
    for x in directions(rng, 150):
        vectors += [x, beside(rng, x, 11.3)]
    rows, df = embedded(spark, vectors)
    monkeypatch.setattr(nn_descent.audit, "__defaults__", (most,))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in nn_descent.near_duplicates(df, size=8, k=4, tables=1, turns=1, rounds=1, asked=64).collect())
    assert got == sorted(brute_links(rows))


def test_samples_without_links_are_no_evidence(spark):
    rng = np.random.default_rng(8)
    _, df = embedded(spark, directions(rng, 400, 32))
    _, nodes = nn_descent.classes_of(df, "vec_id", "embedding", "label")
    none = spark.createDataFrame([], "node long, component long")
    assert not nn_descent.audit(nodes, none, 0.98, 10, 1, 0.999, 20) and nn_descent.audit(nodes, none, 0.98, 10, 1, 0.999)


def test_embeddings_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in nn_descent.near_duplicates(df).collect())
    assert got == sorted(brute_links(rows))


def test_pipeline_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = documents(spark, sf_dir)
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == documents(spark, sf_dir).columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[1] == seen[2] and seen[3] == seen[4] and seen[4]
    good = {r["doc_id"] for r in labels(spark, sf_dir).filter("quality = 1").collect()}
    assert good <= seen[0]
    bad = {r["doc_id"] for r in labels(spark, sf_dir).filter("quality = 0").collect()}
    assert len(bad & seen[0]) <= 0.1 * len(bad)


def test_pipeline_runs(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "n_tokens", "ids"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_tables(spark, small, i):
    """Nulls everywhere, repeated rows, clashing extra columns, very long texts, and no rows."""
    stage = corpus_pipeline.STAGES[i][1]
    long = "river stone cloud field over rain " * 20_000
    rows = [(1, "a few plain words", "en", "s", 17, "x", 0.5, 1), (1, "a few plain words", "en", "s", 17, "x", 0.5, 1), (None, None, None, None, None, None, None, None), (2, None, "en", None, None, "y", None, 2), (3, "", None, "s", 0, None, 0.1, 3), (4, long, "en", "s", len(long), "z", 0.2, 4), (None, "without an id", "en", "s", 13, "z", 0.2, 4), (5, "user=al token = " + "k1" * 10, "en", "s", 1, "q", 0.0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, fp int")
    out = stage(spark, df, small)
    got = out.collect()
    assert len(got) <= len(rows)
    if i < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == df.columns and out.dtypes == df.dtypes
        by_id = {r[0]: r for r in rows}
        assert all(r["doc_id"] in by_id for r in got)
    if i in (2, 4):
        assert len(got) == len(rows)
    if i == 1:
        assert len(got) == 5  # the empty ones, the repeated ones, and the others by themselves
    if i == 2:
        assert [r["text"] for r in got if r["doc_id"] == 5] == ["user=al [SECRET]"]
    assert stage(spark, df.filter("doc_id = 99"), small).count() == 0
