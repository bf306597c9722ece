"""The trained bottleneck: slopes, error against principal components, categories."""

import numpy as np
import pytest

from bookfeel.operators import bottleneck as bn
from bookfeel.operators import neighbours as nb
from bookfeel.operators import partials


def test_slopes_numerically(monkeypatch):
    monkeypatch.setattr(bn, "SLOTS", 5)
    monkeypatch.setattr(bn, "UNITS", (7, 6))
    draw = np.random.default_rng(0)
    net = bn.Network.start(3, 2, 4, 1)
    flat = net.flat() + draw.normal(size=len(net.flat())) * 0.3  # away from the corners at 0
    net = net.filled(flat)
    x, s = draw.normal(size=(6, 3)), np.array([[0, 3, 5, 9], [1, 1, 6, 8], [2, 4, 7, 7], [0, 1, 5, 6], [3, 3, 9, 9], [4, 0, 8, 5]])
    _, slopes, vectors = net.gradients(x, s)
    table = np.zeros_like(net.table)
    np.add.at(table, s.ravel(), np.repeat(vectors.reshape(6, 2, bn.WIDTH), 2, axis=1).reshape(-1, bn.WIDTH))
    own = np.concatenate([table.ravel(), *[g.ravel() for pair in slopes for g in pair]])
    for i in draw.choice(len(flat), 150, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (net.filled(up).gradients(x, s)[0] - net.filled(down).gradients(x, s)[0]) / 2e-6
        assert own[i] == pytest.approx(slope, abs=1e-5)


def curve(spark, n=3000):
    """Six numbers that follow one hidden number round a curve, and a category of it."""
    t = np.random.default_rng(3).uniform(-1, 1, n)
    columns = [np.sin(3 * t), np.cos(3 * t), t**2, np.sin(6 * t), np.cos(5 * t), t**3]
    rows = [(i, *map(float, r), f"part{int((x + 1) * 4)}") for i, (r, x) in enumerate(zip(np.stack(columns, 1), t))]
    return spark.createDataFrame(rows, "book_id long, a double, b double, c double, d double, e double, f double, part string")


def test_error_below_principal_components(spark):
    names = list("abcdef")
    df = curve(spark).repartition(4)
    rows = bn.written(bn._rows(df, names, ["part"]), "rows")
    start = bn.error(rows, bn.Network.start(6, 1, 2))
    net = bn.fit(rows, 6, 1, dims=2, rounds=15)
    z = np.array([r["numbers"] for r in rows.collect()])
    left = np.linalg.svd(z - z.mean(0), compute_uv=False)[2:]
    assert bn.error(rows, net) < min(0.5 * (left**2).sum() / z.size, 0.3 * start)
    vectors = {r["id"]: r["embedding"] for r in bn.encode(rows, net).collect()}
    assert len(vectors) == 3000 and all(len(v) == 2 and min(v) >= 0 for v in vectors.values())


def test_categories_are_learnt(spark):
    """Numbers without noise that only the category tells: the bottleneck must carry it."""
    rows = [(i, float((i * 7 % 13) % 5), f"v{i * 7 % 13}") for i in range(2000)]
    df = spark.createDataFrame(rows, "book_id long, n double, kind string")
    found = nb.knn_compressed(df.limit(200), ["n"], ["kind"], 3, dims=8, trained=True).collect()
    assert len(found) == 600
    empty = bn.network_vectors(df.limit(0), ["n"], ["kind"], rounds=2)
    assert empty.count() == 0
    alone = bn.network_vectors(df.limit(40), ["n"], [], dims=4, rounds=2).collect()
    assert len(alone) == 40 and all(len(r["embedding"]) == 4 for r in alone)


def test_sums_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(partials, "BLOCK", 3)
    df = spark.range(100).repartition(7)

    def part(batches):
        out = np.zeros(8)
        for batch in batches:
            np.add.at(out, np.asarray(batch.column("id")) % 8, 1.0)
        return out

    assert partials.summed(df, 8, part).tolist() == [13.0] * 4 + [12.0] * 4
    assert partials.summed(df.limit(0), 8, lambda batches: None).tolist() == [0.0] * 8
