"""The stored vector index against all pairs."""

import numpy as np
import pytest

from bookfeel.cluster import work_path
from bookfeel.operators import vector_index as vi


def clustered(n, dims=16, groups=40, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dims)) * 2
    return centres[draw.integers(0, groups, n)] + draw.normal(size=(n, dims))


def frame(spark, rows, first=0):
    return spark.createDataFrame([(first + i, r.tolist()) for i, r in enumerate(rows)], "id long, embedding array<double>")


def truth(rows, asked, k, metric):
    score = asked @ rows.T if metric == "dot" else -vi.distances(asked, rows)
    return score


def recall(found, rows, asked_ids, k, metric):
    score = truth(rows, rows[asked_ids], k, metric)
    score[np.arange(len(asked_ids)), asked_ids] = -np.inf
    want = np.argsort(-score, axis=1)[:, :k]
    got = {}
    for r in found:
        got.setdefault(r["id"], []).append(r["neighbour"])
    return np.mean([len(set(got[q]) & set(w.tolist())) / k for q, w in zip(asked_ids, want)])


@pytest.mark.parametrize("metric", ["dot", "euclidean"])
def test_recall_and_exact_search(spark, metric):
    rows = clustered(6000)
    df = frame(spark, rows)
    index = vi.build(df, leaf=40, metric=metric, parts=8)
    cells = index._table("cells").count()
    assert 6000 / 40 / 1.5 < cells < 6000 / 40 * 1.6 and 6 < len(index.roots) < 30  # they follow the rows
    assert index._table("lists").select("id").distinct().count() == 6000 == index._table("lists").count()
    asked = list(range(0, 6000, 20))
    some = df.where("id % 20 = 0")
    found = index.search(some, 10, probes=24).collect()
    assert recall(found, rows, asked, 10, metric) >= 0.9
    assert all(len([r for r in found if r["id"] == i]) == 10 for i in asked[:20])
    exact = index.search(some, 10, share=1.0, shortlist=None).collect()
    assert recall(exact, rows, asked, 10, metric) == 1.0
    r = next(x for x in exact if x["id"] == 40 and x["rank"] == 1)
    score = truth(rows, rows[[40]], 1, metric)[0, r["neighbour"]]
    assert r["score"] == pytest.approx(score if metric == "dot" else (-score) ** 0.5)


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_exact_search_meets_by_tiles(spark, monkeypatch, share):
    """Small tiles and a list in parts: the rows of the probed cells as by brute force, and with all
    cells no table with a row per query and cell."""
    monkeypatch.setattr(vi, "TILE", 150)
    monkeypatch.setattr(vi, "PART", 16)
    rows = clustered(900, seed=5)
    index = vi.build(frame(spark, rows), leaf=10, parts=4)
    sizes, real = [], vi.written
    monkeypatch.setattr(vi, "written", lambda df, name: sizes.append(real(df, name).count()) or real(df, name))
    some = frame(spark, rows).where("id % 9 = 0")
    found = {}
    for r in index.search(some, 5, share=share, shortlist=None).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    held, wanted = index._wanted(None, share)
    assert share < 1.0 or (wanted == held.sum() and sizes == [100, 0])
    cell_of = {r["id"]: r["cell"] for r in index._table("lists").collect()}
    looked = {}
    for r in index._probed(index._lifted(vi._points(some, "id", "embedding"), query=True), None, share).collect():
        looked.setdefault(r["id"], set()).add(r["cell"])
    for q in range(0, 900, 9):
        assert len(looked[q]) == wanted
        score = rows @ rows[q]
        score[[i for i in range(900) if i == q or cell_of[i] not in looked[q]]] = -np.inf
        assert [n for _, n in sorted(found[q])] == np.argsort(-score, kind="stable")[:5].tolist()


def test_adding_rows(spark):
    rows = clustered(3000, seed=3)
    path = work_path(spark, "index")
    vi.build(frame(spark, rows[:1000]), path, leaf=30, parts=8)
    index = vi.load(spark, path)
    before = index._table("cells").count()
    index.add(frame(spark, rows[900:], 900))  # 100 rows are stored already
    assert index._table("lists").count() == 3000 and index._table("cells").count() > 2 * before
    asked = list(range(0, 3000, 25))
    found = vi.load(spark, path).search(frame(spark, rows).where("id % 25 = 0"), 10, probes=40).collect()
    assert recall(found, rows, asked, 10, "dot") >= 0.9


def test_odd_rows(spark):
    """Equal rows, one row, nulls, a hot list in parts, repeated queries' own ids."""
    rows = np.concatenate([np.zeros((500, 4)), clustered(60, 4, 3)])
    df = frame(spark, rows).unionByName(spark.createDataFrame([(None, [1.0] * 4), (9999, None)], "id long, embedding array<double>"))
    old, vi.PART = vi.PART, 64
    try:
        index = vi.build(df, leaf=20, metric="euclidean", parts=2)
        found = index.search(df, 3, share=1.0, shortlist=None).collect()
        near = index.search(df, 3, probes=8, shortlist=20, itself=True).collect()
    finally:
        vi.PART = old
    assert {r["id"] for r in found} == set(range(560)) and len(found) == 3 * 560
    assert [(r["neighbour"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["id"] == 1] == [(0, 0.0), (2, 0.0), (3, 0.0)]
    assert {r["id"] for r in near} == set(range(560))
    one = vi.build(frame(spark, rows[:1]), metric="euclidean")
    assert one.search(frame(spark, rows[:1])).count() == 0
    assert [tuple(r) for r in one.search(frame(spark, rows[:1]), itself=True).collect()] == [(0, 1, 0, 0.0)]
    with pytest.raises(ValueError):
        vi.build(df.limit(0))


def test_code_books():
    rows = clustered(2000, 10)
    books = vi.CodeBooks.fit(rows, 4)
    codes = books.encode(rows)
    assert codes.shape == (2000, 4) and books.decode(codes).shape == rows.shape
    nearest = [vi.distances(rows[:50, a:b], w).argmin(1) for a, b, w in zip(books.edges, books.edges[1:], books.books)]
    assert np.array_equal(codes[:50], np.stack(nearest, 1))
    assert vi.distances(rows, books.decode(codes)).diagonal().mean() < 0.35 * rows.var(0).sum()
