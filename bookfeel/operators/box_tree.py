"""Exact neighbours among rows that a tree has dealt into tiles.

The tree halves a drawn sample again and again, along the coordinate or category that varies most.
The sample decides on the layout only: what a tile can hold is read off its own rows, the range
of each coordinate and the values of each category (as 64 bits). A row meets a tile unless that
box lies beyond the row's k-th best row so far.

Where they meet, single precision says which pairs may lie within that distance, its rounding
errors added; these pairs are then computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

UNIT32 = 2.0**-24  # rounding of single precision
MANY, TOLD = 128, 512  # rows of a node whose split is weighed by all columns, and rows that tell
DENSE = 16  # more than one pair in so many within reach: the whole block is computed instead


@dataclass
class Tree:
    """``feature[i]``: the coordinate that node ``i`` asks, a category behind them, or -1 at a leaf;
    ``right[i]``: the node above (the left one follows at ``i + 1``); ``leaf[i]``: its number in order."""

    feature: list[int]
    bound: list[float]
    codes: list[np.ndarray | None]
    right: list[int]
    leaf: list[int]
    leaves: int

    @classmethod
    def of(cls, vec: np.ndarray, codes: np.ndarray, leaves: int, least: int = 4) -> Tree:
        """At most ``leaves`` leaves of equally many rows, none by less than ``least`` of the given rows."""
        tree = cls([], [], [], [], [], 0)
        vec = np.where(np.isfinite(vec), vec, 0.0)
        tree._grow(vec, codes, np.arange(len(vec)), leaves, least)
        return tree

    def _grow(self, vec, codes, rows, leaves, least) -> None:
        at = len(self.feature)
        for column, empty in ((self.feature, -1), (self.bound, 0.0), (self.codes, None), (self.right, -1), (self.leaf, -1)):
            column.append(empty)
        halves = self._split(vec, codes, rows, at) if leaves > 1 and len(rows) >= 2 * least else None
        if halves is None:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
            return
        left = max(1, min(leaves - 1, round(leaves * len(halves[0]) / len(rows))))
        self._grow(vec, codes, halves[0], left, least)
        self.right[at] = len(self.feature)
        self._grow(vec, codes, halves[1], leaves - left, least)

    def _split(self, vec, codes, rows, at):
        """The halves of ``rows`` that lie closest together: by all columns, while there are many rows, of which
        some tell; then by the column that varies most."""
        told = rows[:: max(1, len(rows) // TOLD)]
        if len(rows) >= MANY:
            ways = [(sum(len(half) * _variation(vec[half], codes[half]).sum() for half in way[2:]), j)
                    for j in range(vec.shape[1] + codes.shape[1]) if (way := self._halves(vec, codes, told, j))]
            order = [j for _, j in sorted(ways)[:1]]
        else:
            order = np.argsort(-_variation(vec[rows], codes[rows]), kind="stable").tolist()
        for j in order:
            way = self._halves(vec, codes, told if len(rows) >= MANY else rows, j)
            if way:
                self.feature[at], self.bound[at], self.codes[at] = j, *way[:2]
                low = self._low(at, vec[rows], codes[rows])
                return rows[low], rows[~low]
        return None

    @staticmethod
    def _halves(vec, codes, rows, j):
        """Bound, or listed codes, of column ``j``, and the rows on either side; None where all are equal."""
        if j < vec.shape[1]:
            own, listed = vec[rows, j], None
            bound = np.median(own)
            low = own <= bound
            if low.all():  # the median is the largest value
                low = own < bound
                bound = own[low].max() if low.any() else bound
        else:
            values, place, counts = np.unique(codes[rows, j - vec.shape[1]], return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            n = int(np.searchsorted(np.cumsum(counts[order]), len(rows) / 2)) + 1
            bound, listed = 0.0, np.sort(values[order[:n]])
            low = np.isin(place, order[:n])
        return (float(bound), listed, rows[low], rows[~low]) if low.any() and not low.all() else None

    def _low(self, at, vec, codes):
        j = self.feature[at]
        return vec[:, j] <= self.bound[at] if j < vec.shape[1] else np.isin(codes[:, j - vec.shape[1]], self.codes[at])

    def place(self, vec: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.zeros(len(vec), np.int64), [(0, np.arange(len(vec)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if self.feature[at] < 0:
                out[rows] = self.leaf[at]
                continue
            low = self._low(at, vec[rows], codes[rows])
            todo += [(at + 1, rows[low]), (self.right[at], rows[~low])]
        return out


def _variation(vec: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Variance of each column, a category as its one-hot slots."""
    shares = (np.unique(codes[:, j], return_counts=True)[1] / len(codes) for j in range(codes.shape[1]))
    return np.concatenate([vec.var(0), [1 - (share * share).sum() for share in shares]])


def bits(codes: np.ndarray) -> np.ndarray:
    """One of 64 bits for each value."""
    return np.left_shift(np.uint64(1), (codes & 63).astype(np.uint64))


@dataclass
class Boxes:
    """What tiles can hold: coordinates between ``low`` and ``high``, categories among ``values``."""

    low: np.ndarray
    high: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, vec: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> Boxes:
        """Of runs of rows that begin at ``starts``."""
        return cls(np.fmin.reduceat(vec, starts), np.fmax.reduceat(vec, starts), np.bitwise_or.reduceat(bits(codes), starts))

    def away(self, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Least squared distance of one box (or point) from each of these."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return (gap * gap).sum(1) + 2.0 * ((self.values & values) == 0).sum(1)

    def points_away(self, i: int, vec: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Least squared distance of points from box ``i``."""
        gap = np.maximum(np.maximum(self.low[i] - vec, vec - self.high[i]), 0.0)
        return np.einsum("ij,ij->i", gap, gap) + 2.0 * ((marks & self.values[i]) == 0).sum(1)


@dataclass
class Rows:
    """Rows in runs of one tile each; ``points`` are the coordinates in which distances are measured."""

    ids: np.ndarray
    vec: np.ndarray
    codes: np.ndarray
    points: np.ndarray
    starts: np.ndarray

    def runs(self) -> Iterator[tuple[int, int]]:
        yield from zip(self.starts.tolist(), [*self.starts[1:].tolist(), len(self.ids)])



def small(codes: np.ndarray) -> np.ndarray:
    """One byte for each code: equal codes have equal bytes."""
    return (codes & 0xFF).astype(np.uint8)


def edges(cells: np.ndarray, most: int) -> np.ndarray:
    """Where the runs of equal ``cells`` begin, cut after ``most`` rows."""
    first = np.flatnonzero(np.diff(cells, prepend=cells[0] - 1)) if len(cells) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(cells)))
    return np.concatenate([np.arange(a, a + n, most) for a, n in zip(first, sizes)]) if len(first) else first


class Tile:
    """One run of data rows, made ready to meet many query rows; ``scale``: squared size of the largest vector."""

    def __init__(self, rows: Rows, run: tuple[int, int], scale: float):
        own = slice(*run)
        self.ids, self.vec, self.codes, self.scale = rows.ids[own], rows.vec[own], rows.codes[own], scale
        self.centre = rows.points[own].mean(0)
        d = (rows.points[own] - self.centre) / scale**0.5
        d2 = np.einsum("ij,ij->i", d, d)
        self.most, self.right = d2.max(), np.empty((d.shape[1] + 2, len(d)), np.float32)
        self.right[:-2], self.right[-2], self.right[-1] = d.T, d2, 1.0
        self.small = small(self.codes)
        # Categories in which all rows of the tile agree count by row, the others by pair.
        same = (self.small == self.small[:1]).all(0)
        self.same, self.varied = np.flatnonzero(same), np.flatnonzero(~same)
        self.by_category = np.ascontiguousarray(self.small.T)
        self.fit = bool(np.isfinite(self.most)) and 1e-200 < scale < 1e200

    def within(self, q: np.ndarray, q_small: np.ndarray, reach: np.ndarray):
        """Pairs of a query row and a row of the tile that may lie within ``reach`` (squared, by row), none left
        out; None where they are too many for a list, or single precision can't tell."""
        if not self.fit:
            return None
        q = (q - self.centre) / self.scale**0.5
        q2, two = np.einsum("ij,ij->i", q, q), 2.0 / self.scale
        less = reach / self.scale - q2
        if len(self.same):
            less -= two * (q_small[:, self.same] != self.small[0, self.same]).sum(1)
        wrong = (q.shape[1] + 8) * UNIT32 * (2 * np.sqrt(q2 * self.most) + np.abs(less) + self.most + two * len(self.varied)) + 1e-30
        left = np.empty((len(q), q.shape[1] + 2), np.float32)
        left[:, :-2], left[:, -2], left[:, -1] = -2.0 * q, 1.0, -(less + 2 * wrong)
        out = left @ self.right
        hit = np.flatnonzero(out <= 0)
        if len(hit) * DENSE > out.size and len(self.varied):
            differing = np.zeros(out.shape, np.uint8)
            for j in self.varied:
                differing += q_small[:, j, None] != self.by_category[j]
            hit = np.flatnonzero(differing * np.float32(two) + out <= 0)
        return None if len(hit) * DENSE > out.size else np.divmod(hit, out.shape[1])
