"""Exact search against brute force, approximate search by recall."""

import re

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from bookfeel.cluster import work_path
from bookfeel.operators import neighbours as nb
from bookfeel.operators import scaling, topics


def vectors(spark, matrix):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, embedding array<float>")


def brute(matrix, k, metric):
    m = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    if metric == "dot":
        cost = -(m @ m.T)
    else:
        cost = np.sqrt(np.maximum(((m[:, None] - m[None]) ** 2).sum(-1), 0))
    cost = np.round(cost, 6)
    out = {}
    for i in range(len(m)):
        order = sorted((cost[i, j], j) for j in range(len(m)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def clustered(seed, n=240, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (6, dims))
    m = centres[rng.integers(0, 6, n)] + rng.normal(0, 0.3, (n, dims))
    m[10] = 0.0
    m[20:24] = m[30]  # copies
    return m


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_exact_search_prunes_without_loss(spark, metric):
    m = clustered(1)
    found = nb.knn_exact(vectors(spark, m), 5, metric, leaf=20)
    assert lists(found) == brute(m, 5, metric)


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
@pytest.mark.parametrize("scale", [1e-6, 1e6])
def test_ranks_do_not_depend_on_scale(spark, metric, scale):
    m = np.random.default_rng(4).normal(0, 1, (200, 8)) * scale
    data = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<double>")
    cost = -(m @ m.T) if metric == "dot" else ((m[:, None] - m[None]) ** 2).sum(-1)
    np.fill_diagonal(cost, np.inf)
    want = {i: list(np.argsort(cost[i])[:5]) for i in range(len(m))}
    assert lists(nb.knn_exact(data, 5, metric, leaf=20)) == want
    assert lists(nb.knn_ivf(data, 5, leaf=20, probe=1.0, metric=metric)) == want


def test_probing_gives_k_rows_and_recall(spark):
    m = clustered(7)
    found = nb.knn_ivf(vectors(spark, m), 30, leaf=4, probe=0.001, metric="euclidean")
    assert all(len(x) == 30 for x in lists(found).values())
    want, got = brute(m, 5, "euclidean"), lists(nb.knn_ivf(vectors(spark, m), 5, leaf=20, probe=0.3, metric="euclidean"))
    assert np.mean([len(set(want[i]) & set(got[i])) / 5 for i in want]) > 0.9


@pytest.mark.parametrize("model", ["mixed", "exact"])
def test_stored_lists_of_features_and_of_either_metric(spark, model):
    draw = np.random.default_rng(1)
    rows = [(i, float(draw.normal()), float(draw.normal()), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "book_id long, x double, y double, c string")
    root = work_path(spark, "similar")
    if model == "mixed":
        stored = nb.build_similarity(df, root, model, nb.knn_mixed, "book_id", numeric=["x", "y"], categories=["c"], k=7)
    else:
        data = df.selectExpr("book_id AS id", "array(x, y) AS embedding")
        stored = nb.build_similarity(data, root, model, k=7)
    assert stored.count() == 60 and stored.selectExpr("size(similar_books) AS n").distinct().collect()[0]["n"] == 7
    vectors_ = df.selectExpr("book_id AS id", "array(x, y) AS embedding")
    ten = nb.similar_books(spark, 3, model, [root], vectors_, 10)  # the stored list is too short
    m = np.array([r[1:3] for r in rows])
    cost = -(m @ m[3]) if model == "exact" else ((m - m[3]) ** 2).sum(1)
    assert [r["neighbour"] for r in ten.orderBy("rank").collect()] == [int(i) for i in np.argsort(cost) if i != 3][:10]


def test_topics_read_the_weights_of_tfidf(spark, monkeypatch):
    texts = [(i, " ".join(f"word{(i * k) % 7}" for k in range(30))) for i in range(12)]
    df = spark.createDataFrame(texts, "id long, text string")
    seen = {}
    real = topics.written
    monkeypatch.setattr(topics, "written", lambda d, name, *a: seen.setdefault(name, real(d, name, *a)))
    mixtures, fitted = topics.topics(df, n=1, min_df=1, iterations=3)
    monkeypatch.undo()
    weights = {(r["id"], r["term"]): r["weight"] for r in topics.tfidf(df, n=1, min_df=1).collect()}
    for r in seen["features"].collect():
        for i, w in zip(r["terms"], r["counts"]):
            assert weights.pop((r["id"], fitted.terms[i])) == pytest.approx(w)
    assert not weights and mixtures.count() == 12
    assert topics.topics(df, n=3, min_df=50)[0].first()["mixture"] == pytest.approx([1 / 3] * 3)


def test_pruning_skips_cells(spark):
    m = clustered(2)
    points = nb._points(vectors(spark, m), "id", "embedding", None)
    space = nb._Space("euclidean", 0.0)
    pivots = nb._pivots(points, 12)
    rows = nb._assign(points, space, pivots).toPandas()
    near, far = np.full(12, np.inf), np.full(12, -np.inf)
    for cell, away in rows.groupby("cell")["away"]:
        near[cell], far[cell] = away.min(), away.max()
    parts = spark.createDataFrame([(int(c), 1) for c in set(rows["cell"])], "cell bigint, parts bigint")
    blocks = nb._pack(nb._assign(points, space, pivots), parts)
    probes = nb._probes(blocks, space, pivots, (near, far, np.full(12, 20)), 3, None).toPandas()
    asked = sum(len(ids) for ids in probes["q_ids"])
    assert len(m) <= asked < len(m) * len(set(rows["cell"])) / 2


def test_fewer_rows_than_neighbours(spark):
    got = lists(nb.knn_exact(vectors(spark, [[1, 0], [0, 1], [1, 1]]), 10))
    assert {k: len(v) for k, v in got.items()} == {0: 2, 1: 2, 2: 2}


def test_category_differences_count_as_one_hot(spark):
    rng = np.random.default_rng(5)
    num, cat = rng.normal(size=(90, 2)), rng.integers(0, 3, (90, 2))
    df = spark.createDataFrame(
        [(i, *map(float, num[i]), *map(str, cat[i])) for i in range(90)], "book_id long, a double, b double, c string, d string")
    z = (num - num.mean(0)) / num.std(0)
    onehot = np.concatenate([(cat[:, [j]] == np.arange(3)).astype(float) for j in range(2)], axis=1)
    full = np.concatenate([z, onehot], axis=1)
    cost = np.round(np.sqrt(((full[:, None] - full[None]) ** 2).sum(-1)), 6)
    want = {i: [j for _, j in sorted((cost[i, j], j) for j in range(90) if j != i)[:4]] for i in range(90)}
    assert lists(nb.knn_mixed(df, ["a", "b"], ["c", "d"], 4)) == want


def test_probing_recall(spark):
    m = clustered(7, 400, 8)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    exact, close = brute(m, 10, "dot"), lists(nb.knn_ivf(vectors(spark, m), 10, leaf=40, probe=0.3))
    hits = [len(set(exact[i]) & set(close.get(i, []))) / 10 for i in exact if i != 10]
    assert np.mean(hits) >= 0.8


def test_new_rows_are_added_to_stored_lists(spark):
    m, root = clustered(3, 60), work_path(spark, "similar")
    first = nb.build_similarity(vectors(spark, m).filter("id < 50"), root, "m", k=3)
    assert first.count() == 50
    second = nb.build_similarity(vectors(spark, m), root, "m", k=3)
    assert second.count() == 60
    exact = brute(m, 3, "dot")
    added = {r["book_id"]: r["similar_books"] for r in second.filter("book_id >= 50").collect()}
    assert added == {i: exact[i] for i in range(50, 60)}
    assert nb.build_similarity(vectors(spark, m), root, "m", k=3).count() == 60


def test_hybrid_vectors_have_unit_length(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "Y", "red sea"), (2, None, "N", None), (3, 5.0, "y", "blue")], "book_id int, n double, is_series string, t string")
    rows = scaling.hybrid_vectors(df, ["n"], ["is_series", "t"], scaling.hashing_embedder(16)).collect()
    assert [round(sum(x * x for x in r["embedding"]), 6) for r in rows] == [1.0] * 3
    assert len(rows[0]["embedding"]) == 18

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    own = scaling.hybrid_vectors(df, ["n"], ["is_series", "t"], scaling.model_embedder(load, 2), scaler="robust").collect()
    assert [round(sum(x * x for x in r["embedding"]), 6) for r in own] == [1.0] * 3


def test_zero_vector_stays(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(scaling.unit(F.col("v"))).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_ngrams(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("The cat, a big cat",), ("one",), ("",)], "t string")
    assert [r[0] for r in df.select(topics.ngrams(F.col("t"), 2)).collect()] == [["the cat", "cat big", "big cat"], [], []]
    assert [r[0] for r in df.select(topics.ngrams(F.col("t"))).collect()] == [["the", "cat", "big", "cat"], ["one"], [""][:0]]


def test_categories_beyond_the_slots_stay_apart(spark):
    rows = [(i, f"author{i // 2}", f"shelf{i % 7}", 1.0) for i in range(3000)]  # 1,500 authors, two books each
    df = spark.createDataFrame(rows, "book_id long, author string, shelf string, pages double")
    found = nb.projected_categories(df, ["author", "shelf"], "v").orderBy("book_id").collect()
    v = np.array([r["v"].toArray() for r in found])
    got = (v * v).sum(1)[:, None] + (v * v).sum(1) - 2 * v @ v.T
    author, shelf = np.arange(3000) // 2, np.arange(3000) % 7
    true = 2.0 * (author[:, None] != author) + 2.0 * (shelf[:, None] != shelf)
    rest = ~np.eye(3000, dtype=bool)
    assert np.abs(got[true == 0]).max() < 1e-9
    assert got[(true > 0) & rest].min() > 0.8
    assert np.abs(got - true)[true > 0].mean() < 0.1 * 4
    # The other book of the author is the nearest, and no stranger is as near.
    near = nb.knn_compressed(df, ["pages"], ["author"], 2).collect()
    one = {r["id"]: r for r in near if r["rank"] == 1}
    two = {r["id"]: r for r in near if r["rank"] == 2}
    assert all(one[i]["neighbour"] == i ^ 1 for i in range(3000)) and min(r["score"] for r in two.values()) > 1e-3


def test_topics_are_fitted_on_normalised_texts(spark, monkeypatch):
    from bookfeel.checks import models
    from bookfeel.functions import text as tx

    animals, ships = "The %d cats, were chasing happy children!", "An %d old ship - sank under the northern stars."
    rows = [(i, " ".join([animals if i % 2 else ships] * (1 + i % 3)) % ((i,) * (1 + i % 3)), int(i > 23)) for i in range(30)]
    table = spark.createDataFrame([*rows, (30, None, 0), (31, "7, 8!", 0)], "id long, text string, target int")
    monkeypatch.setattr(models.d, "labelled_texts", lambda spark, sf: table)
    low = table.filter("target = 0")
    want = {r[0]: r[1] for r in low.select("id", tx.normalize_text_full(F.col("text"))).collect()}
    assert {r["id"]: r["text"] for r in models.low_rated(spark, SMALL).collect()} == want
    shares = models.topic_shares(spark, SMALL).collect()
    assert sorted(r["id"] for r in shares) == sorted(want)
    for r in shares:
        assert min(r[1:]) >= 0 and sum(r[1:]) == pytest.approx(1)
        assert r["id"] < 30 or list(r[1:]) == pytest.approx([1 / 3] * 3)
    held = {i: w for i, w in ((i, (x or "").split()) for i, x in want.items())}
    known = {" ".join(w[k:k + 3]) for w in held.values() for k in range(len(w) - 2)}
    terms = models.top_terms(spark, SMALL).collect()
    for t in range(3):
        mine = sorted((r for r in terms if r["topic"] == t), key=lambda r: r["rank"])
        weights = [r["weight"] for r in mine]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and {r["term"] for r in mine} <= known
        assert 5 < len(mine) <= 10
        assert weights == sorted(weights, reverse=True) and min(weights) > 0
    assert not any(re.search(r"[0-9]|\b(the|an)\b", r["term"]) for r in terms)


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_tiles_in_many_parts_without_shuffled_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(nb, "BLOCK", 16)
    monkeypatch.setattr(nb, "PART_BYTES", 4000)
    monkeypatch.setattr(nb, "TILES", 2)
    m = clustered(3)
    m[100:160] = m[40]  # more copies than neighbours, in several tiles
    found = nb.knn_exact(vectors(spark, m), 5, metric, leaf=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "hashpartitioning(cell" not in plan
    assert lists(found) == brute(m, 5, metric)
    assert lists(nb.knn_ivf(vectors(spark, m), 5, leaf=20, probe=1.0, metric=metric)) == brute(m, 5, metric)


def test_best_rows_are_kept_while_more_come():
    draw = np.random.default_rng(6)
    keys = draw.integers(0, 20, (7, 300)).astype(float)
    best = nb._Best(7, 4)
    for low in range(0, 300, 25):
        row, col = nb._smallest(keys[:, low:low + 25], 4, best.most)
        best.add(row, low + col, keys[row, low + col] * 2, keys[row, low + col])
        assert best.size <= 4 * 4 * 7 + 7 * 25
    row, ids, score, key = best.settle()
    for i in range(7):
        assert list(ids[row == i]) == sorted(range(300), key=lambda j: (keys[i, j], j))[:4]
    assert (score == 2 * key).all()


def test_whole_vectors_are_made_once(spark, monkeypatch):
    kept, real = [], nb.written
    monkeypatch.setattr(nb, "written", lambda df, name, *rest: kept.append((name, real(df, name, *rest))) or kept[-1][1])
    df = spark.createDataFrame([(i, float(i % 7), f"a{i % 5}") for i in range(60)], "book_id long, pages double, author string")
    found = nb.compressed_vectors(df, ["pages"], ["author"], 3, 32)
    assert [name for name, _ in kept] == ["whole-vectors"] and kept[0][1].columns == ["book_id", "_all"]
    assert "HashingTF" not in found._jdf.queryExecution().optimizedPlan().toString() and found.inputFiles() == kept[0][1].inputFiles()
    assert {r["id"]: len(r["embedding"]) for r in found.collect()} == {i: 3 for i in range(60)}
