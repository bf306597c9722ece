"""Word vectors and their label scores against plain numpy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookfeel.cluster import work_path
from bookfeel.operators import enrich, word_vectors as wv

THEMES = {
    "war": "battle soldier army fight cannon fortress siege general".split(),
    "love": "kiss heart wedding romance darling tender couple embrace".split(),
    "sea": "ship sail captain harbour storm wave island anchor".split(),
}
FILLER = "the a of and it was then there with on".split()


def stories(n=400, seed=1):
    draw, rows = random.Random(seed), []
    for i in range(n):
        theme = list(THEMES)[i % 3]
        words = [draw.choice(THEMES[theme] + [theme]) if draw.random() < 0.5 else draw.choice(FILLER) for _ in range(60)]
        rows.append((i, theme, " ".join(words)))
    return rows


def dense(df, size):
    out = np.zeros((size, size))
    for r in df.collect():
        out[r[0], r[1]] += r[2]
    return out


def test_pairs_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(wv, "CODES", 64)  # many pieces
    rows = stories(30) + [(90, "", "one"), (91, "", None), (92, "", "ship ship, ship! and a ship")]
    df = spark.createDataFrame(rows, "id int, theme string, text string").repartition(3)
    words = [r["word"] for r in wv.vocabulary(df, "text", 12, 5).collect()]
    want = Counter()
    for _, _, text in rows:
        w = [x.strip(",!") for x in (text or "").split()]
        for i, a in enumerate(w):
            want.update((words.index(a), words.index(b)) for b in w[i + 1:i + 4] if a in words and b in words)
    got = {(r["a"], r["b"]): r["n"] for r in wv.pairs(df, "text", words, 3).collect()}
    assert got == want and len(words) == 12


def test_texts_are_cut_once_and_a_product_is_one_job(spark, monkeypatch):
    df = spark.createDataFrame(stories(60), "id int, theme string, text string").repartition(5)
    cut, tokens = [], wv.tx.tokens
    monkeypatch.setattr(wv.tx, "tokens", lambda c: cut.append(1) or tokens(c))
    wv.fit(df, "text", 20, 4)
    assert len(cut) == 1
    rows = [(i, i * 7 % 20, float(i)) for i in range(20)] + [(3, 3, 0.5)]
    matrix = spark.createDataFrame(rows, "a int, b int, value double").repartition(6)
    tall = np.random.default_rng(0).normal(size=(20, 3))
    want = np.zeros((20, 20))
    for a, b, value in rows:
        want[a, b] += value
    spark.sparkContext.setJobGroup("product", "product")
    try:
        assert np.allclose(wv.product(matrix, tall), want @ tall)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("product")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(wv.product(matrix, tall, True), want.T @ tall)
    assert not wv.product(matrix.limit(0), tall).any()


def test_information_and_singular_vectors(spark):
    df = spark.createDataFrame(stories(), "id int, theme string, text string")
    words = [r["word"] for r in wv.vocabulary(df, "text").collect()]
    counts = wv.pairs(df, "text", words)
    n = dense(counts, len(words))
    n = n + n.T
    context = n.sum(0)**0.75 / (n.sum(0)**0.75).sum()
    with np.errstate(divide="ignore"):
        want = np.maximum(np.log(n / (n.sum(1)[:, None] * context[None, :])), 0)
    matrix = wv.information(counts, len(words))
    assert dense(matrix, len(words)) == pytest.approx(want)
    x = np.random.default_rng(0).normal(size=(len(words), 5))
    assert wv.product(matrix, x) == pytest.approx(want @ x)
    assert wv.product(matrix, x, True) == pytest.approx(want.T @ x)
    u, s, _ = np.linalg.svd(want)
    got = wv.singular(matrix, matrix, len(words), 6)
    assert got @ got.T == pytest.approx((u[:, :6] * s[:6]) @ u[:, :6].T, abs=1e-3 * s[0])


def test_labels_follow_the_corpus(spark):
    rows = stories()
    df = spark.createDataFrame(rows + [(998, "", None), (999, "", "zzz qqq")], "id int, theme string, text string")
    model = wv.fit(df, "text", dims=12)
    again = wv.WordVectors.of(model.params())
    assert np.array_equal(again.vectors, model.vectors) and again.words == model.words
    for multi in (False, True):
        task = {"theme_is": wv.Task(list(THEMES), "The topic of this book is about {}.", multi)}
        found = {r["id"]: r["theme_is"] for r in wv.score_tasks(df, ["id"], F.col("text"), again, task).collect()}
        right = sum(found[i][0]["label"] == theme for i, theme, _ in rows)
        assert right > 0.97 * len(rows)
        for i in (998, 999):
            assert [e["label"] for e in found[i]] == sorted(THEMES) and len({e["score"] for e in found[i]}) == 1
        for i, _, text in rows[:20]:  # the same in plain numpy
            def mean(words):
                share = model.counts / model.counts.sum()
                known = [model.words.index(w) for w in words if w in model.words]
                weights = [wv.RARE / (wv.RARE + share[k]) for k in known]
                return sum(x * model.vectors[k] for x, k in zip(weights, known)) / sum(weights) if known else np.zeros(12)

            def one(v):
                return v / np.linalg.norm(v)

            bare = "the topic of this book is about "
            labels = np.array([one(one(mean((bare + x).split())) - one(mean(bare.split()))) for x in THEMES])
            t = one(mean(text.split())) - model.centre
            cosine = labels @ t / np.linalg.norm(t)
            score = 1 / (1 + np.exp(-cosine / 0.1)) if multi else np.exp(cosine / 0.1) / np.exp(cosine / 0.1).sum()
            assert {e["label"]: pytest.approx(e["score"], abs=1e-9) for e in found[i]} == dict(zip(THEMES, score))


def test_enrichment_by_corpus(spark):
    """The built-in enrichment learns from the books, stores its vectors and scores later books by them."""
    text = {"war": "war and conflict of armies, battle and torture", "love": "love and romantic relationships, joy and a wedding"}
    rows = [(i, f"{text['war' if i % 2 else 'love']} in chapter {i}. " * 5) for i in range(60)]
    df = spark.createDataFrame(rows + [(60, None)], "book_id int, description string")
    root = work_path(spark, "enriched")
    first = {r["book_id"]: r for r in enrich.enrich(df.where("book_id < 40"), root).collect()}
    both = {r["book_id"]: r for r in enrich.enrich(df, root).collect()}
    assert len(first) == 40 and len(both) == 61 and all(both[i] == first[i] for i in first)
    assert all(both[i]["main_themes"][0] == ("war and conflict" if i % 2 else "love and romantic relationships") for i in range(60))
    assert both[60]["main_themes"] == [] and both[60]["emotions"] == ["anger"]  # all alike: the first by name


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "book_id int, description string")
    model = wv.fit(df, "description")
    assert model.words == [] and enrich.default_features(df, model).count() == 0
    one = spark.createDataFrame([(1, "text")], "book_id int, description string")
    assert enrich.default_features(one, model).first()["sentiment"] == "negative"
