"""Quality classifier, language identification, near-duplicate vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.awkward import clash, texts
from tests.llm.brute import Groups
from trailmesh.llm import langid, projection, quality

FOLDER = "/root/testdata/sf0.01"


def test_quality_of_awkward_rows(spark):
    docs = clash(spark.createDataFrame([(i, t, "a", None) for i, t in texts()], "doc_id long, text string, source string, lang string"))
    labels = clash(spark.createDataFrame([(1, 1), (2, 1), (16, 0), (16, 0), (16, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    rows = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(rows) == len(texts()) and all(0 < r.score < 1 and r.kept == (r.score >= 0.5) for r in rows)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.classify(docs, labels, F.col("source"), F.col("lang")).collect()
    assert [r.evidence for r in rows] == [0.0, 0.0] and all(r.kept for r in rows)
    assert quality.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).collect() == []


def test_sparse_sites_are_shrunk(spark):
    """A bad host lowers a borderline document; a site with one document stays at the corpus rate."""
    rows, labels = [], []
    for h in range(20):
        for k in range(40):
            rows.append((h * 100 + k, "same plain words in all of them", f"host{h}", "p"))
            labels.append((h * 100 + k, int(k % 10 != 0 if h % 2 else k % 10 == 0)))
    rows += [(9001, "same plain words in all of them", "host1", "p"), (9002, "same plain words in all of them", "host2", "p"),
             (9003, "same plain words in all of them", "new", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(docs, marks, F.col("source"), F.col("lang")).collect()}
    assert found[9001].path_rate > 0.8 and found[9001].kept
    assert found[9002].path_rate < 0.2 and not found[9002].kept
    assert abs(found[9003].path_rate - 0.5) < 0.05
    assert found[101].path_rate < found[100].path_rate  # its own share is left out


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.classify(docs, labels.filter("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    held = scored.join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (held.kept == (held.quality == 1)).mean() > 0.97


def test_ratios_need_both_kinds():
    counts = {("word_length", 0, 3, 1): 5, ("word_length", 0, 3, 0): 5}
    from collections import Counter
    found = quality.ratios(Counter(counts))
    assert abs(found["word_length"][3]) < 1e-12 and all(math.isfinite(x) for v in found.values() for x in v)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = langid.fold(F.col("doc_id")) == 1
    found = langid.identify(docs, langid.fit(docs.filter(~held)))
    joined = found.join(docs.filter(held).select("doc_id", "lang"), "doc_id").toPandas()
    assert (joined.lang == joined.lang_pred).mean() > 0.98
    assert joined.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    docs = clash(spark.createDataFrame([(1, "alpha beta alpha", "x"), (2, "gamma delta", "y"), (3, None, "x"), (4, "1 2 3", "z"),
                                        (5, "zeta", None), (None, "alphas", "x"), (7, "ooo", "x"), (7, "ooo", "x")],
                                       "doc_id long, text string, lang string"))
    model = langid.fit(docs)
    assert model.languages == ["x", "y"]  # no word was counted for z
    rows = [(r.doc_id, r.lang_pred) for r in langid.identify(docs, model).collect()]
    assert rows[:4] == [(1, "x"), (2, "y"), (3, "und"), (4, "und")] and rows[5:] == [(None, "x"), (7, "x"), (7, "x")]
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_unseen_words_use_the_longest_known_grams():
    grams = {g: k for k, g in enumerate(["_ab", "b", "_abc"])}
    scores = np.array([[-1, -9], [-9, -1], [-2, -3]], np.float32)
    model = langid.Model(["x", "y"], {}, np.zeros((0, 2), np.float32), grams, scores)
    assert model.unseen("abcd").tolist() == [-2, -3] and model.unseen("ab").tolist() == [-1, -9]
    assert model.unseen("qb").tolist() == [-9, -1] and model.unseen("q").tolist() == [0, 0]


def test_most_frequent_is_bounded(spark):
    counts = spark.createDataFrame([("x", f"w{k}", k + 1) for k in range(100)], "lang string, piece string, n long")
    kept = [r.n for r in langid._most_frequent(counts, 30).collect()]
    assert 0 < len(kept) <= 30 and min(kept) > 100 - 31


def vectors_of(groups=12, seed=3):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for g in range(groups):
        centre = rng.standard_normal(16)
        for m in range(int(rng.integers(1, 40))):
            v = centre + rng.standard_normal(16) * (0.03 + 0.01 * (g % 9))
            rows.append((k, [float(x) for x in v], f"l{g % 3}"))
            k += 1
    rows += [(k + j, rows[0][1], rows[0][2]) for j in range(30)]  # exact copies
    rows += [(900, None, "l0"), (901, [0.0] * 16, "l0"), (902, rows[0][1], None), (903, [float("nan")] * 16, "l0"),
             (904, [None] + rows[0][1][1:], "l0"), (905, [], "l0"), (906, rows[0][1][:8], "l0"), (907, [float("inf")] * 16, "l0"),
             (908, [x * 1e200 for x in rows[0][1]], "l0"), (None, rows[0][1], "l0"), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.mark.parametrize(("window", "block"), [(64, 2048), (8, 7)])
def test_vectors_equal_all_pairs(spark, window, block):
    rows = vectors_of()
    good = {}
    for n, (i, v, label) in enumerate(rows):
        if i is not None and v and label and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            good[n] = (i, label, x / np.linalg.norm(x))
    groups, links = Groups(), dict.fromkeys(range(len(rows)), 0)
    for a in good:
        for b in good:
            (i, l, x), (j, m, y) = good[a], good[b]
            if a != b and l == m and len(x) == len(y) and x @ y >= 0.98:
                links[a] += 1
                groups.join(i, j)
    want = sorted(((i is None, i or 0), links[n], i if i is None else groups.find(i)) for n, (i, _, _) in enumerate(rows))
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    got = projection.near_duplicates(df, window=window, block=block).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def around_a_centre(n, pairs, mutual, cosine=0.981, size=64, seed=9):
    """Unit vectors of about the cosine ``mutual``; vector 2k + 1 stands at ``cosine`` to vector 2k for the first pairs."""
    rng = np.random.default_rng(seed)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    x = unit(np.sqrt(mutual) * unit(rng.standard_normal(size)) + np.sqrt(1 - mutual) * unit(rng.standard_normal((n, size))))
    a, away = x[0:2 * pairs:2], rng.standard_normal((pairs, size))
    away = unit(away - (away * a).sum(axis=1, keepdims=True) * a)
    x[1:2 * pairs:2] = cosine * a + np.sqrt(1 - cosine ** 2) * away
    return x


@pytest.mark.parametrize("mutual", [0.0, 0.9])
def test_pairs_are_found_around_a_centre(spark, mutual):
    x = around_a_centre(6000, 500, mutual)
    df = spark.createDataFrame([(k, v.tolist(), "one") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection.near_duplicates(df).collect()}
    links = x @ x.T >= 0.98
    groups = Groups()
    for a, b in np.argwhere(links).tolist():
        groups.join(a, b)
    assert got == {k: (int(links[k].sum()) - 1, groups.find(k)) for k in range(len(x))}


def test_window_reaches_over_partitions_of_few_rows(spark):
    """One pass over partitions far smaller than the window compares the same rows as over one partition."""
    x = around_a_centre(400, 100, 0.5)
    df = spark.createDataFrame([(k, v.tolist(), "one") for k, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions in (1, 60):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got.append(sorted(map(tuple, projection.near_duplicates(df, window=40, most_passes=1).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and 0 < sum(not r[3] for r in got[0]) < 100


def test_passes_grow_with_size_and_density():
    def passes(n, mutual):
        x = around_a_centre(256, 0, mutual)
        return projection.passes_for(x, x.mean(axis=0), n, 512, 0.98, 1e-6, 10_000)

    assert passes(500, 0.9) == 1 < passes(5_000, 0.0) < passes(10 ** 8, 0.0)
    assert passes(50_000, 0.0) < passes(50_000, 0.8) < passes(50_000, 0.9)


def test_vectors_that_share_an_id_are_apart(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.999, 0.01]
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, [0.0, 0.0, 1.0], "x")]
    got = projection.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projection.near_duplicates(df).collect() == []


def test_needed_links_connect_the_same_rows():
    rng = np.random.default_rng(5)
    for _ in range(50):
        hit = np.tril(rng.random((20, 20)) < 0.3, -1)
        full, few = Groups(), Groups()
        for g, (r, c) in ((full, np.nonzero(hit)), (few, projection.needed(hit.copy()))):
            for a, b in zip(r.tolist(), c.tolist(), strict=True):
                assert hit[a, b]
                g.join(a, b)
        assert [full.find(k) for k in range(20)] == [few.find(k) for k in range(20)]


def test_no_word_is_left_out_of_the_language_model(spark):
    """What is held in memory makes no difference; words seen once count, and rare n-grams back unseen words."""
    rng = np.random.default_rng(11)
    letters = {"x": "abcdefg", "y": "efghijk", "z": "ghijkab"}
    rows = []
    for k in range(90):
        lang = "xyz"[k % 3] if k % 9 else "x"
        words = ["".join(rng.choice(list(letters[lang]), int(rng.integers(1, 7)))) for _ in range(12)]
        rows.append((k, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train, asked = docs.filter("doc_id < 60"), docs.drop("lang")
    whole, few = langid.fit(train), langid.fit(train, max_words=20, max_grams=15)
    assert len(few.words) <= 20 < len(whole.words) and len(few.grams) <= 15 < len(whole.grams)
    plain = {}
    for i, text, _ in rows:
        total = np.zeros(3)
        for word in langid.words_of(text):
            row = whole.words.get(word)
            total += whole.unseen(word) if row is None else whole.word_scores[row]
        plain[i] = (whole.languages[int(np.argmax(total))], 1 / np.exp(total - total.max()).sum())
    for model in (whole, few, langid.fit(train, max_words=0, max_grams=0)):
        found = langid.identify(asked, model).collect()
        assert [r.doc_id for r in found] == list(range(90))
        assert [r.lang_pred for r in found] == [plain[k][0] for k in range(90)]
        assert np.allclose([r.score for r in found], [plain[k][1] for k in range(90)], atol=1e-4)


def test_rim_of_a_crowded_group_is_linked(spark):
    """Thousands of near copies crowd each other out of any window; every link among them counts."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(48)
    x = base / np.linalg.norm(base) + 0.03 * rng.standard_normal((2500, 48))
    rows = [(i, v.tolist(), "one") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.98
    np.fill_diagonal(hit, False)
    root = np.arange(len(x))
    while True:
        now = np.minimum(root, np.where(hit, root, len(x)).min(axis=1))
        if (now == root).all():
            break
        root = now
    got = {r.vec_id: (r.n_links, r.component_id) for r in projection.near_duplicates(df, window=8, block=300).collect()}
    assert 0 < hit.sum() and got == {i: (int(hit[i].sum()), int(root[i])) for i in range(len(x))}


def test_connected_is_the_first_column_reached():
    hit = np.zeros((4, 6), bool)
    hit[[0, 0, 1, 1, 2], [2, 4, 4, 5, 1]] = True
    rows, columns = projection.connected(hit)
    assert rows.tolist() == [2, 2, 1, 6]
    assert columns.tolist() == [0, 1, 2, 3, 2, 2]
