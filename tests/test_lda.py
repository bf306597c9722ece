"""The topic model against one text after another in plain numpy."""

import math
import random

import numpy as np
import pytest
from conftest import SMALL

from bookfeel.operators import lda, partials, topics


def psi(x: float) -> float:
    h = 1e-5
    return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)


def plain(texts, terms, k, rounds, seed):
    """``texts``: [[(term, weight)]]. The textbook algorithm, no sharing of work."""
    prior, lam = 1 / k, lda.start_weights(terms, k, seed)

    def beta(lam):
        return np.array([[math.exp(psi(x) - psi(row.sum())) for x in row] for row in lam])

    def one(text, b):
        gamma = np.ones(k)
        if not text:
            return np.full(k, prior), gamma * 0
        for _ in range(100):
            e = np.array([math.exp(psi(g) - psi(gamma.sum())) for g in gamma])
            new = np.full(k, prior)
            for t, w in text:
                phi = e * b[:, t]
                new += w * phi / (phi.sum() + lda.TINY)
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved < 1e-3:
                break
        return gamma, np.array([math.exp(psi(g) - psi(gamma.sum())) for g in gamma])

    for _ in range(rounds):
        b, add = beta(lam), np.zeros_like(lam)
        for text in texts:
            _, e = one(text, b)
            for t, w in text:
                phi = e * b[:, t]
                add[:, t] += w * phi / (phi.sum() + lda.TINY)
        old, lam = lam / lam.sum(1)[:, None], prior + add
        part = lam / lam.sum(1)[:, None]
        if np.abs(part - old).max() < 1e-4 * part.max():
            break
    gammas = np.array([one(text, beta(lam))[0] for text in texts])
    return lam, gammas / gammas.sum(1)[:, None]


def test_digamma():
    x = np.array([0.05, 0.3, 1.0, 2.5, 10.0, 400.0])
    assert lda.digamma(x) == pytest.approx([psi(v) for v in x], abs=1e-6)
    assert lda.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


@pytest.mark.parametrize("k", [2, 3])
def test_against_plain_numpy(spark, k):
    draw = random.Random(k)
    terms = [f"t{i}" for i in range(14)]
    texts = [[(t, draw.random() + 0.1) for t in sorted(draw.sample(range(7) if i % 2 else range(5, 14), draw.randrange(0, 6)))]
             for i in range(40)]
    df = spark.createDataFrame(
        [(i, [t for t, _ in x], [w for _, w in x]) for i, x in enumerate(texts)], "id long, terms array<int>, counts array<double>")
    lam, want = plain(texts, terms, k, 12, 3)
    for parts in (1, 7):  # the same fit whatever the partitions
        fitted = lda.fit(df.repartition(parts), terms, k, 12, 3)
        assert fitted.weights == pytest.approx(lam, abs=1e-6)
        got = {r["id"]: r["mixture"] for r in lda.mixtures(df, fitted).collect()}
        assert np.array([got[i] for i in range(40)]) == pytest.approx(want, abs=1e-6)
    assert [r[1] for r in fitted.top(3)] == [1, 2, 3] * k


def test_blocks_of_terms(spark, monkeypatch):
    monkeypatch.setattr(partials, "BLOCK", 4)
    df = spark.createDataFrame([(i, [i % 9, 9], [1.0, 0.5]) for i in range(30)], "id long, terms array<int>, counts array<double>")
    table = lda.expectations(lda.start_weights([str(i) for i in range(10)], 3, 0))
    added = lda._added(df.repartition(4), table, 1 / 3)
    assert added.sum(0) == pytest.approx([4.0] * 3 + [3.0] * 6 + [15.0])  # every weight goes to some topic


def test_topics_part(spark):
    """Two kinds of texts part into two topics; texts without known terms have equal shares."""
    a, b = "red green blue yellow", "cat dog bird fish"
    rows = [(i, " ".join([a if i % 2 else b] * 3)) for i in range(20)] + [(20, ""), (21, None), (22, "unknown")]
    mixtures, fitted = topics.topics(spark.createDataFrame(rows, "id long, text string"), k=2, n=1, min_df=2)
    got = {r["id"]: r["mixture"] for r in mixtures.collect()}
    side = int(np.argmax(got[0]))
    assert all(got[i][side if i % 2 == 0 else 1 - side] > 0.8 for i in range(20))
    assert all(got[i] == pytest.approx([0.5, 0.5]) for i in (20, 21, 22))
    words = {r["term"] for r in topics.top_words(spark, fitted, 4).where(f"topic = {side}").collect()}
    assert words == set(b.split())


def test_shares_of_every_text(spark):
    from bookfeel.checks import models

    rows = models.topic_shares(spark, SMALL).collect()
    assert rows and all(sum(r[1:]) == pytest.approx(1) for r in rows)
