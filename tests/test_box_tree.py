"""The tree of the exact search: nothing within reach is left out, little else is computed."""

import numpy as np
import pytest

from bookfeel.operators import box_tree as bt
from bookfeel.operators import neighbours as nb


def mixed(seed, n=4000, dims=4, columns=5, scale=1.0):
    draw = np.random.default_rng(seed)
    kind = draw.integers(0, 8, n)
    vec = (draw.normal(0, 3, (8, dims))[kind] + draw.normal(0, 0.4, (n, dims))) * scale
    codes = np.stack([draw.integers(0, 3, n) + 7 * kind * (j < 3) for j in range(columns)], 1) * 0x9E3779B97F4A7C1
    vec[100:140], codes[100:140] = vec[7], codes[7]  # copies
    return draw.permutation(10 * n)[:n], vec, codes


def in_tiles(space, ids, vec, codes, leaves=64):
    cell = bt.Tree.of(space.points(vec[::2]), codes[::2], leaves).place(space.points(vec), codes)
    order = np.argsort(cell, kind="stable")
    ids, vec, codes = ids[order], vec[order], codes[order]
    return bt.Rows(ids, vec, codes, space.points(vec), bt.edges(cell[order], 100))


def all_squared(space, rows):
    return space.squared(rows.vec, rows.codes, rows.vec, rows.codes)


@pytest.mark.parametrize("metric,scale", [("euclidean", 1.0), ("euclidean", 1e-4), ("dot", 1e5), ("dot", 1.0)])
def test_tiles_find_every_pair_within_reach_and_boxes_none_too_far(metric, scale):
    ids, vec, codes = mixed(1, 1500, scale=scale)
    if metric == "dot":
        codes = codes[:, :0]
    space = nb._Space(metric, float(np.sqrt((vec * vec).sum(1).max())))
    rows = in_tiles(space, ids, vec, codes)
    true, asked = all_squared(space, rows), space.asked(rows.vec)
    reach = np.partition(true, 15, axis=1)[:, 15] + 1e-9 * space.longest**2  # as wide as a tie
    boxes, told, held = bt.Boxes.of(rows.points, rows.codes, rows.starts), 0, 0
    for i, run in enumerate(rows.runs()):
        own = slice(*run)
        assert run[1] - run[0] <= 100
        assert (boxes.points_away(i, asked, bt.bits(rows.codes)) <= true[:, own].min(1) * (1 + 1e-9) + 1e-9 * space.longest**2).all()
        found = bt.Tile(rows, run, space.longest**2).within(asked, bt.small(rows.codes), reach)
        want = np.argwhere(true[:, own] <= reach[:, None] - 1e-12 * space.longest**2)
        if found is not None:
            told += len(found[0])
            assert {tuple(x) for x in want.tolist()} <= set(zip(found[0].tolist(), found[1].tolist()))
        held += len(want)
    assert held and told < true.size / 4


def test_search_meets_few_pairs_and_leaves_none_out(monkeypatch):
    ids, vec, codes = mixed(2)
    space = nb._Space("euclidean", float(np.sqrt((vec * vec).sum(1).max())))
    rows = in_tiles(space, ids, vec, codes)
    met, real = [], bt.Tile.within
    monkeypatch.setattr(bt.Tile, "within", lambda tile, q, small, reach: met.append(len(q) * len(tile.ids)) or real(tile, q, small, reach))
    true = all_squared(space, rows)
    score, key = space.score(rows.vec, rows.vec, true)
    key[rows.ids[:, None] == rows.ids[None, :]] = np.inf
    chunk = nb._Chunk(space, rows)
    for low, high in rows.runs():
        best = nb._Best(high - low, 6)
        nb._meet(space, 6, rows, (low, high), chunk, best, np.full(high - low, np.inf))
        row, found, got, _ = best.settle()
        for i in range(high - low):
            want = np.lexsort((rows.ids, key[low + i]))[:6]
            assert found[row == i].tolist() == rows.ids[want].tolist()
            assert got[row == i] == pytest.approx(score[low + i, want], abs=1e-6)
    assert sum(met) < len(ids) ** 2 / 8


def test_odd_rows_in_the_tree():
    vec = np.array([[np.nan, 1.0], [0.0, 0.0], [0.0, 0.0], [1.0, np.nan], [5.0, 5.0]])
    none = np.empty((5, 0), np.int64)
    tree = bt.Tree.of(vec, none, 4, least=1)
    assert 1 < tree.leaves <= 4 and set(tree.place(vec, none).tolist()) <= set(range(tree.leaves))
    assert bt.Tree.of(vec[1:3], none[1:3], 4, least=1).leaves == 1  # equal rows can't be halved
    assert bt.edges(np.array([3, 3, 3, 3, 3, 8]), 2).tolist() == [0, 2, 4, 5]
