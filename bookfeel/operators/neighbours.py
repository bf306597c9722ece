"""Nearest neighbours: exact with cell pruning, approximate by probing, stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..sources import tables
from . import box_tree as bt
from .joins import only_new

MAX_CELLS = 1024      # bounds what the driver and every task hold of the cells
MAX_TASKS = 100_000
BLOCK = 2048          # rows per block, so a pair of blocks fits any task
TILES = 8             # tiles of questions per task
PART_BYTES = 64 << 20  # data rows that a task holds
SLACK = 1e-6          # keeps ties and rounding inside the exact bound
TIE = 1e-9            # scores closer than this share of their possible size tie
TILE = 512            # rows of a tile of the exact search
MAX_TILES = 16_384    # leaves of its tree, whose boxes the driver and every task hold
SAMPLE_BYTES = 32 << 20  # of drawn rows that the driver makes the tree of


class _Space:
    """Distances between rows made of a numeric part and category codes.

    Category codes count 2 per difference, the squared distance of two one-hot
    slots. For an inner product the data rows get one more coordinate that gives
    them all the same length, which turns "largest product" into "nearest".
    """

    def __init__(self, metric: str, longest: float):
        self.metric, self.longest = metric, longest

    def squared(self, q, q_codes, d, d_codes):
        q2, d2 = (q * q).sum(1), (d * d).sum(1)
        if self.metric == "dot":
            d2 = np.full(len(d), self.longest**2)
        out = q2[:, None] + d2[None, :] - 2.0 * (q @ d.T)
        return np.maximum(self._add_differences(out, q_codes, d_codes), 0.0)

    @staticmethod
    def _add_differences(out, a_codes, b_codes):
        if a_codes.shape[1]:
            differing = np.zeros(out.shape, dtype=np.uint8 if a_codes.shape[1] < 128 else np.uint32)
            for j in range(a_codes.shape[1]):
                differing += a_codes[:, j][:, None] != b_codes[:, j][None, :]
            out += 2 * differing
        return out

    def between_data(self, a, a_codes, b, b_codes):
        """Distance of two data rows, the added coordinate included."""
        out = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T))
        if self.metric == "dot":
            lift = np.sqrt(np.maximum(self.longest**2 - (a * a).sum(1), 0.0))
            lift_b = np.sqrt(np.maximum(self.longest**2 - (b * b).sum(1), 0.0))
            out += (lift[:, None] - lift_b[None, :]) ** 2
        return np.sqrt(np.maximum(self._add_differences(out, a_codes, b_codes), 0.0))

    def points(self, d):
        """Data rows where distances are measured, with the added coordinate."""
        if self.metric != "dot":
            return d
        lift = np.sqrt(np.maximum(self.longest**2 - (d * d).sum(1), 0.0))
        return np.concatenate([d, lift[:, None]], 1)

    def asked(self, q):
        """Query rows there."""
        return np.concatenate([q, np.zeros((len(q), 1))], 1) if self.metric == "dot" else q

    def reach(self, q, key):
        """Squared distance beyond which no row has a rank key up to ``key``."""
        q2, long2 = (q * q).sum(1), self.longest**2
        with np.errstate(over="ignore"):
            if self.metric == "dot":
                most = q2 + long2 + 2 * (key + 1) * np.maximum(TIE * np.sqrt(q2) * self.longest, 1e-300)
            else:
                most = (key + 1) * np.maximum(TIE * (q2 + long2), 1e-300)
        return most + 1e-12 * (q2 + long2)

    def score_pairs(self, q, q_codes, d, d_codes):
        """:meth:`score` of each query row and the data row beside it."""
        q2 = (q * q).sum(1)
        if self.metric == "dot":
            score = (q * d).sum(1)
            return score, -np.round(score / np.maximum(TIE * np.sqrt(q2) * self.longest, 1e-300))
        squared = ((q - d) ** 2).sum(1) + 2.0 * (q_codes != d_codes).sum(1)
        return np.sqrt(squared), np.round(squared / np.maximum(TIE * (q2 + self.longest**2), 1e-300))

    def score(self, q, d, squared):
        """What is reported (product or distance), and the rank key, lower first.

        The key counts in units of TIE times the largest value that the query can
        reach, so it follows the scale of the vectors; rounding noise stays below it.
        """
        q2 = (q * q).sum(1)[:, None]
        if self.metric == "dot":
            score = q @ d.T
            return score, -np.round(score / np.maximum(TIE * np.sqrt(q2) * self.longest, 1e-300))
        unit = np.maximum(TIE * (q2 + self.longest**2), 1e-300)
        return np.sqrt(squared), np.round(squared / unit)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """A list column of equal-length lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _points(vectors: DataFrame, key: str, vector: str, codes: str | None) -> DataFrame:
    return vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
        (F.col(codes) if codes else F.array()).cast("array<bigint>").alias("codes"),
    )


def _pivots(points: DataFrame, cells: int):
    """``cells`` rows drawn by a hash of the id: at most MAX_CELLS rows. The ids are
    drawn first, so that no partition sends that many vectors."""
    drawn = points.select("id").orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells)
    rows = points.join(F.broadcast(drawn), "id", "left_semi").orderBy(F.md5(F.col("id").cast("string")), "id").limit(cells).collect()
    vec = np.array([r["vec"] for r in rows], dtype=np.float64)
    codes = np.array([r["codes"] for r in rows], dtype=np.int64).reshape(len(rows), -1)
    return vec, codes


def _assign(points: DataFrame, space: _Space, pivots) -> DataFrame:
    """Each row with its nearest cell and the distance to that cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_vec, p_codes = pivots
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vec = _matrix(batch.column("vec"), n)
            codes = _matrix(batch.column("codes"), n)
            far = space.between_data(vec, codes, p_vec, p_codes)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vec"), batch.column("codes"),
                 pa.array(cell.astype(np.int64)), pa.array(far[np.arange(n), cell])],
                names=["id", "vec", "codes", "cell", "away"],
            )

    schema = "id bigint, vec array<double>, codes array<bigint>, cell bigint, away double"
    return points.mapInArrow(run, schema)


def _pack(assigned: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows gathered into blocks of about BLOCK rows of one cell."""
    spread = F.pmod(F.xxhash64("id"), F.col("parts"))
    return (
        assigned.join(F.broadcast(parts), "cell")
        .withColumn("sub", spread)
        .groupBy("cell", "sub")
        .agg(F.collect_list(F.struct("id", "vec", "codes")).alias("rows"))
        .select(
            "cell", "sub",
            F.col("rows.id").alias("ids"),
            F.flatten("rows.vec").alias("flat"),
            F.flatten("rows.codes").alias("flat_codes"),
        )
    )


def _unpack(ids, flat, flat_codes):
    ids = np.asarray(ids, dtype=np.int64)
    vec = np.asarray(flat, dtype=np.float64).reshape(len(ids), -1)
    codes = np.asarray(flat_codes, dtype=np.int64).reshape(len(ids), -1)
    return ids, vec, codes


def _row(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return batch.column(name)[i].values.to_numpy(zero_copy_only=False)


def _bounds(space: _Space, k: int, nprobe: int | None, ids, vec, codes):
    """Exact search: a row's k-th distance among rows at hand, which bounds its answer."""
    if nprobe is not None or len(ids) <= k:
        return np.full(len(ids), np.inf)
    own = np.sqrt(space.squared(vec, codes, vec, codes))
    own[ids[:, None] == ids[None, :]] = np.inf
    return np.partition(own, k - 1, axis=1)[:, k - 1]


def _look(space: _Space, pivots, limits, k: int, nprobe: int | None, vec, codes, bound):
    """The cells that each row must look at, as a matrix.

    Exact search: a cell all of whose rows lie beyond the row's bound (triangle
    inequality on the pivot's distance and the cell's nearest and farthest row) is
    skipped. Probing: the ``nprobe`` nearest cells, and more until they hold k other rows.
    """
    p_vec, p_codes = pivots
    nearest, farthest, held = limits
    away = np.sqrt(space.squared(vec, codes, p_vec, p_codes))
    if nprobe is not None:
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(held[order], axis=1) - held[order]
        wanted = (np.arange(away.shape[1]) < nprobe) | (before < k + 1)
        look = np.zeros(away.shape, dtype=bool)
        np.put_along_axis(look, order, wanted, axis=1)
    else:
        least = np.maximum(np.maximum(away - farthest, nearest - away), 0.0)
        look = least <= (bound + SLACK * (1.0 + bound))[:, None]
    return look & np.isfinite(farthest)


def _probes(blocks: DataFrame, space: _Space, pivots, limits, k: int, nprobe: int | None) -> DataFrame:
    """For each block of one cell, the cells it must look at, with just the rows that must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vec, codes = _unpack(*[_row(batch, c, i) for c in ("ids", "flat", "flat_codes")])
                look = _look(space, pivots, limits, k, nprobe, vec, codes, _bounds(space, k, nprobe, ids, vec, codes))
                out = {"cell": [], "q_ids": [], "q_flat": [], "q_codes": []}
                for cell in np.flatnonzero(look.any(0)):
                    take = look[:, cell]
                    out["cell"].append(int(cell))
                    out["q_ids"].append(ids[take])
                    out["q_flat"].append(vec[take].ravel())
                    out["q_codes"].append(codes[take].ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["cell"], pa.int64()),
                     pa.array(out["q_ids"], pa.list_(pa.int64())),
                     pa.array(out["q_flat"], pa.list_(pa.float64())),
                     pa.array(out["q_codes"], pa.list_(pa.int64()))],
                    names=["cell", "q_ids", "q_flat", "q_codes"],
                )

    schema = "cell bigint, q_ids array<bigint>, q_flat array<double>, q_codes array<bigint>"
    return blocks.mapInArrow(run, schema)


def _tiled(assigned: DataFrame, places: DataFrame) -> DataFrame:
    """Rows gathered into tiles of about BLOCK rows: small cells together, a crowded one in several."""
    return (
        assigned.join(F.broadcast(places), "cell")
        .withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")))
        .groupBy("tile")
        .agg(F.collect_list(F.struct("cell", "id", "vec", "codes")).alias("rows"))
        .select(
            "tile",
            F.col("rows.cell").alias("cells"),
            F.col("rows.id").alias("ids"),
            F.flatten("rows.vec").alias("flat"),
            F.flatten("rows.codes").alias("flat_codes"),
        )
    )


def _questions(tiles: DataFrame, space: _Space, pivots, limits, k: int, nprobe: int | None, of_cell: dict) -> DataFrame:
    """Each tile of query rows with the bounds of its rows and the tiles that any of them must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vec, codes = _unpack(*[_row(batch, c, i) for c in ("ids", "flat", "flat_codes")])
                bound = _bounds(space, k, nprobe, ids, vec, codes)
                look = _look(space, pivots, limits, k, nprobe, vec, codes, bound)
                meets = sorted({t for cell in np.flatnonzero(look.any(0)) for t in range(*of_cell[int(cell)])})
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in ("tile", "ids", "flat", "flat_codes")],
                     pa.array([bound], pa.list_(pa.float64())), pa.array([meets], pa.list_(pa.int64()))],
                    names=["q_tile", "q_ids", "q_flat", "q_codes", "q_bounds", "q_meets"],
                )

    schema = ("q_tile bigint, q_ids array<bigint>, q_flat array<double>, q_codes array<bigint>, "
              "q_bounds array<double>, q_meets array<bigint>")
    return tiles.mapInArrow(run, schema)


def _smallest(rank: np.ndarray, k: int, most: np.ndarray):
    """Row and column of every entry up to its row's k-th smallest, ties with the
    k-th included, and none above ``most``; ties are settled by id."""
    limit = most
    if rank.shape[1] > k:
        limit = np.minimum(np.partition(rank, k - 1, axis=1)[:, k - 1], most)
    return np.nonzero((rank <= limit[:, None]) & np.isfinite(rank))


class _Best:
    """The k best rows so far of each query row of a tile."""

    def __init__(self, rows: int, k: int):
        self.k, self.found, self.size = k, [], 0
        self.most = np.full(rows, np.finfo(np.float64).max)  # no key above it is needed

    def add(self, row, ids, score, key) -> None:
        self.found.append((row, ids, score, key))
        self.size += len(row)
        if self.size > 4 * self.k * len(self.most):
            self.settle()

    def settle(self):
        if not self.found:
            return None
        row, ids, score, key = [np.concatenate(x) for x in zip(*self.found)]
        order = np.lexsort((ids, key, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order, place = order[place < self.k], place[place < self.k]
        self.found = [(row[order], ids[order], score[order], key[order])]
        self.size = len(order)
        full = order[place == self.k - 1]
        self.most[row[full]] = key[full]
        return self.found[0]


def _nearest_in_tiles(pairs: DataFrame, space: _Space, pivots, limits, k: int, nprobe: int | None) -> DataFrame:
    """The k best data rows of each query row, among the tiles that its tile meets in a task. A
    tile's pairs come one after another; only its best rows are kept meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer():
            settled = best.settle() if best else None
            if settled is not None:
                row, neighbour, score, key = settled
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[row]), pa.array(neighbour), pa.array(score), pa.array(key)],
                    names=["id", "neighbour", "score", "key"],
                )

        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("q_tile")[i].as_py() != at:
                    yield from answer()
                    at = batch.column("q_tile")[i].as_py()
                    q_ids, q, q_codes = _unpack(*[_row(batch, c, i) for c in ("q_ids", "q_flat", "q_codes")])
                    look = _look(space, pivots, limits, k, nprobe, q, q_codes, _row(batch, "q_bounds", i))
                    best = _Best(len(q_ids), k)
                ids, d, d_codes = _unpack(*[_row(batch, c, i) for c in ("ids", "flat", "flat_codes")])
                cells = np.asarray(_row(batch, "cells", i), dtype=np.int64)
                for cell in np.unique(cells):
                    rows, own = np.flatnonzero(look[:, cell]), np.flatnonzero(cells == cell)
                    if not len(rows):
                        continue
                    squared = space.squared(q[rows], q_codes[rows], d[own], d_codes[own])
                    score, rank = space.score(q[rows], d[own], squared)
                    rank[q_ids[rows][:, None] == ids[own][None, :]] = np.inf
                    row, col = _smallest(rank, k, best.most[rows])
                    best.add(rows[row], ids[own[col]], score[row, col], rank[row, col])
        yield from answer()

    return pairs.mapInArrow(run, "id bigint, neighbour bigint, score double, key double")


def _tree(points: DataFrame, space: _Space, total: int, width: int, leaf: int) -> bt.Tree:
    """The tree of some rows drawn by a hash of the id, and of rows at random where few ids make that fail."""
    per = max(min(leaf, TILE), min(TILE, total // 256))
    leaves = min(MAX_TILES, -(-total // per))
    wanted = min(total, 16 * leaves, max(64, SAMPLE_BYTES // (8 * max(1, width))))
    share = max(1, total // wanted)
    kept = points.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(share)) == 0).select("vec", "codes").limit(2 * wanted)
    rows = kept.toArrow().combine_chunks()
    n = rows.num_rows
    if not n:
        return bt.Tree.of(np.empty((0, 0)), np.empty((0, 0), np.int64), 1)
    vec, codes = (_matrix(rows.column(c).combine_chunks(), n) for c in ("vec", "codes"))
    return bt.Tree.of(space.points(vec), codes, leaves)


def _placed(points: DataFrame, space: _Space, tree: bt.Tree) -> DataFrame:
    """Each row with its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec, codes = (_matrix(batch.column(c), batch.num_rows) for c in ("vec", "codes"))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("id", "vec", "codes")], pa.array(tree.place(space.points(vec), codes))],
                    names=["id", "vec", "codes", "cell"])

    return points.mapInArrow(run, "id bigint, vec array<double>, codes array<bigint>, cell bigint")


_BLOBS = ("ids", "cells", "vec", "codes")


def _chunked(placed: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """Rows of neighbouring leaves as one row of four blobs, in the order of their leaves."""
    dealt = placed.join(F.broadcast(places), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("chunk"), "cell", "id", "vec", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            parts = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays(
                [pa.array([at]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["chunk", *_BLOBS])

        at, held = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            chunk, cell, ids = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("chunk", "cell", "id"))
            vec, codes = (_matrix(batch.column(c), n) for c in ("vec", "codes"))
            first = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
            for low, high in zip(first, [*first[1:], n]):
                if held and chunk[low] != at:
                    yield told()
                    held = []
                at = int(chunk[low])
                held.append((ids[low:high], cell[low:high], vec[low:high].astype(np.float64), codes[low:high].astype(np.int64)))
        if held:
            yield told()

    return dealt.repartition(tasks, "chunk").sortWithinPartitions("chunk", "cell").mapInArrow(
        run, "chunk bigint, " + ", ".join(f"{c} binary" for c in _BLOBS))


def _rows_of(batch: pa.RecordBatch, i: int, space: _Space | None, prefix: str = "") -> bt.Rows:
    """The rows of a chunk; for queries (no ``space``) without points."""
    ids, cells, vec, codes = (
        np.frombuffer(batch.column(prefix + c)[i].as_buffer(), np.float64 if c == "vec" else np.int64) for c in _BLOBS)
    vec, codes = vec.reshape(len(ids), -1), codes.reshape(len(ids), -1)
    return bt.Rows(ids, vec, codes, vec if space is None else space.points(vec), bt.edges(cells, TILE))


class _Chunk:
    """Data rows whose tiles are made ready when they are met."""

    def __init__(self, space: _Space, rows: bt.Rows):
        self.space, self.rows, self.runs, self.tiles = space, rows, list(rows.runs()), {}
        self.boxes = bt.Boxes.of(rows.points, rows.codes, rows.starts)

    def tile(self, i: int) -> bt.Tile:
        if i not in self.tiles:
            self.tiles[i] = bt.Tile(self.rows, self.runs[i], self.space.longest**2)
        return self.tiles[i]


def _meet(space: _Space, k: int, q: bt.Rows, run: tuple[int, int], data: _Chunk, best: _Best, reach) -> np.ndarray:
    """Rows of ``data`` within ``reach`` (squared) of the query rows in ``run`` go to ``best``, nearest tiles
    first; the reach that is left then."""
    ids, vec, codes = (x[slice(*run)] for x in (q.ids, q.vec, q.codes))
    asked, marks, small = space.asked(vec), bt.bits(codes), bt.small(codes)
    box = bt.Boxes.of(asked, codes, np.zeros(1, np.int64))
    away = data.boxes.away(box.low[0], box.high[0], box.values[0])
    before, bounded = best.size, bool(np.isfinite(reach).all())
    for i in np.argsort(away, kind="stable").tolist():
        if away[i] > reach.max():
            break
        rows = np.flatnonzero(data.boxes.points_away(i, asked, marks) <= reach)
        if not len(rows):
            continue
        tile = data.tile(i)
        pairs = tile.within(asked[rows], small[rows], reach[rows]) if np.isfinite(reach[rows]).all() else None
        if pairs is None:
            squared = space.squared(vec[rows], codes[rows], tile.vec, tile.codes)
            score, rank = space.score(vec[rows], tile.vec, squared)
            rank[ids[rows][:, None] == tile.ids[None, :]] = np.inf
            row, col = _smallest(rank, k, best.most[rows])
            best.add(rows[row], tile.ids[col], score[row, col], rank[row, col])
        elif len(pairs[0]):
            row, col = rows[pairs[0]], pairs[1]
            score, rank = space.score_pairs(vec[row], codes[row], tile.vec[col], tile.codes[col])
            kept = (ids[row] != tile.ids[col]) & (rank <= best.most[row])
            best.add(row[kept], tile.ids[col[kept]], score[kept], rank[kept])
        if not bounded and best.size:
            best.settle()
        if not bounded or best.size < before:  # settled
            reach = np.minimum(reach, space.reach(vec, best.most))
            bounded = bool(np.isfinite(reach).all())
        before = best.size
    return reach


def _boxes(chunks: DataFrame, space: _Space) -> tuple[np.ndarray, bt.Boxes]:
    """The chunk and the box of every tile: ``MAX_TILES`` leaves, and a tile for each ``TILE`` rows of a crowded one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _rows_of(batch, i, space)
                box = bt.Boxes.of(data.points, data.codes, data.starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk").slice(i, 1), pa.array([len(data.starts)], pa.int64()),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (box.low, box.high, box.values)]],
                    names=["chunk", "tiles", "low", "high", "marks"])

    rows = chunks.mapInArrow(run, "chunk bigint, tiles bigint, low binary, high binary, marks binary").collect()
    parts = [np.concatenate([np.frombuffer(r[c], kind).reshape(r["tiles"], -1) for r in rows])
             for c, kind in (("low", np.float64), ("high", np.float64), ("marks", np.uint64))]
    return np.repeat([r["chunk"] for r in rows], [r["tiles"] for r in rows]), bt.Boxes(*parts)


LOOKED = 256  # tiles for which a tile's rows are asked one by one whether they must meet it


def _asked_chunks(chunks: DataFrame, space: _Space, k: int, tile_chunk: np.ndarray, boxes: bt.Boxes, whole: bool) -> DataFrame:
    """Each chunk of query rows with their reach, the chunks that any of them must meet, and, if ``whole``
    (all rows ask), their k best rows in their own chunk, which is not met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, at = _rows_of(batch, i, space), batch.column("chunk")[i].as_py()
                own = _Chunk(space, rows)
                reach, meets, found = np.empty(len(rows.ids)), set(), []
                for low, high in rows.runs():
                    best = _Best(high - low, k)
                    left = _meet(space, k, rows, (low, high), own, best, np.full(high - low, np.inf))
                    settled = best.settle()
                    reach[low:high] = np.minimum(left, space.reach(rows.vec[low:high], best.most))
                    if settled is not None:
                        found.append((rows.ids[low:high][settled[0]], *settled[1:]))
                    asked, marks = space.asked(rows.vec[low:high]), bt.bits(rows.codes[low:high])
                    box = bt.Boxes.of(asked, rows.codes[low:high], np.zeros(1, np.int64))
                    near = np.flatnonzero(~(boxes.away(box.low[0], box.high[0], box.values[0]) > reach[low:high].max()))
                    if len(near) <= LOOKED:
                        near = [j for j in near if tile_chunk[j] not in meets and (boxes.points_away(j, asked, marks) <= reach[low:high]).any()]
                    meets.update(tile_chunk[near].tolist())
                if whole:
                    meets.discard(at)
                told = [np.concatenate(x) for x in zip(*found)] if whole and found else [np.empty(0)] * 4
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*[one.column(c) for c in ("chunk", *_BLOBS)], pa.array([reach.tobytes()], pa.binary()),
                     pa.array([sorted(meets)], pa.list_(pa.int64())),
                     *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(told, (np.int64, np.int64, np.float64, np.float64))]],
                    names=["q_chunk", *[f"q_{c}" for c in _BLOBS], "q_reach", "q_meets", "id", "neighbour", "score", "key"])

    return chunks.mapInArrow(
        run, "q_chunk bigint, " + ", ".join(f"q_{c} binary" for c in _BLOBS) + ", q_reach binary, q_meets array<bigint>, "
             "id binary, neighbour binary, score binary, key binary")


_FOUND = "id bigint, neighbour bigint, score double, key double"


def _at_hand(questions: DataFrame) -> DataFrame:
    """The best rows found in the own chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(batch.column(c)[i].as_buffer(), kind))
                     for c, kind in (("id", np.int64), ("neighbour", np.int64), ("score", np.float64), ("key", np.float64))],
                    names=["id", "neighbour", "score", "key"])

    return questions.select("id", "neighbour", "score", "key").mapInArrow(run, _FOUND)


def _nearest_in_chunks(pairs: DataFrame, space: _Space, k: int) -> DataFrame:
    """The k best rows of each query row among the chunks that its chunk meets in a task. A chunk's
    pairs come one after another; only its best rows are kept meanwhile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer():
            for (low, high), best in zip(rows.runs(), bests) if rows else ():
                settled = best.settle()
                if settled is not None:
                    row, *rest = settled
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows.ids[low:high][row]), *map(pa.array, rest)], names=["id", "neighbour", "score", "key"])

        at, rows = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("q_chunk")[i].as_py() != at:
                    yield from answer()
                    at, rows = batch.column("q_chunk")[i].as_py(), _rows_of(batch, i, None, "q_")
                    reach = np.frombuffer(batch.column("q_reach")[i].as_buffer()).copy()
                    bests = [_Best(high - low, k) for low, high in rows.runs()]
                data = _Chunk(space, _rows_of(batch, i, space))
                for (low, high), best in zip(rows.runs(), bests):
                    reach[low:high] = _meet(space, k, rows, (low, high), data, best, reach[low:high])
        yield from answer()

    return pairs.mapInArrow(run, _FOUND)


def _search_tree(points: DataFrame, space: _Space, total: int, k: int, leaf: int, asking: DataFrame | None) -> DataFrame:
    """``id, neighbour, score, key``: among them, the k best rows of every row, or of the ids in ``asking``."""
    spark = points.sparkSession
    width = points.select(F.size("vec") + F.size("codes")).first()[0]
    placed = written(_placed(points, space, _tree(points, space, total, width, leaf)), "placed")
    cores = spark.sparkContext.defaultParallelism
    most = max(1, min(4 * BLOCK, max(TILE, -(-total // (4 * cores)))))
    # One row per leaf, at most MAX_TILES.
    counts = sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect())
    places, chunk, room = [], -1, 0
    for cell, n in counts:
        parts = -(-n // most)
        if parts > 1 or n > room:
            chunk, room = chunk + 1, most if parts == 1 else 0
        places.append((cell, chunk, parts))
        chunk, room = chunk + parts - 1, max(room - n, 0)
    held = spark.createDataFrame(places, "cell bigint, first bigint, parts bigint")
    # Explicit numbers of partitions: a chunk is little data and much work.
    tasks = min(chunk + 1, max(4 * cores, -(-(chunk + 1) // TILES)), MAX_TASKS)
    chunks = written(_chunked(placed, held, tasks), "chunks")
    queries = chunks if asking is None else _chunked(placed.join(asking, "id", "left_semi"), held, tasks)
    tile_chunk, boxes = _boxes(chunks, space)
    questions = written(
        _asked_chunks(queries.repartition(min(chunk + 1, MAX_TASKS)), space, k, tile_chunk, boxes, asking is None), "questions")
    # Every part of the questions meets every part of the chunks, without a shuffle of the pairs: what
    # goes on are the k best rows of a question in a part. A part is as large as a task may hold.
    parts = min(chunk + 1, max(-(-total * 8 * (width + 2) // PART_BYTES), -(-2 * cores // tasks)))
    asked = questions.select("q_chunk", *[f"q_{c}" for c in _BLOBS], "q_reach", "q_meets")
    pairs = asked.repartition(tasks).join(
        chunks.repartition(parts).hint("shuffle_replicate_nl"), F.array_contains("q_meets", F.col("chunk"))
    ).drop("q_meets", "chunk")
    return _nearest_in_chunks(pairs, space, k).union(_at_hand(questions))


def _search(
    points: DataFrame, k: int, metric: str, nprobe_share: float | None,
    leaf: int = BLOCK, asking: DataFrame | None = None,
) -> DataFrame:
    """Search all rows for the neighbours of all rows, or only of the ids in ``asking``."""
    facts = points.agg(
        F.count("*").alias("n"),
        F.max(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)).alias("longest"),
    ).first()
    if not facts["n"]:
        return points.sparkSession.createDataFrame([], "id bigint, rank int, neighbour bigint, score double")
    space = _Space(metric, float(facts["longest"]) ** 0.5)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("key", "neighbour"))
    if nprobe_share is None and np.isfinite(space.longest):
        found = _search_tree(points, space, facts["n"], k, leaf, asking)
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "score")
    pivots = _pivots(points, min(MAX_CELLS, -(-facts["n"] // leaf)))
    assigned = written(_assign(points, space, pivots), "cells")
    # One row per cell, at most MAX_CELLS.
    cells = assigned.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("away").alias("near"), F.max("away").alias("far")
    ).collect()
    nearest = np.full(len(pivots[0]), np.inf)
    farthest = np.full(len(pivots[0]), -np.inf)
    held = np.zeros(len(pivots[0]), dtype=np.int64)
    for c in cells:
        nearest[c["cell"]], farthest[c["cell"]], held[c["cell"]] = c["near"], c["far"], c["n"]
    nprobe = None
    if nprobe_share is not None:
        nprobe = max(1, int(np.ceil(nprobe_share * len(pivots[0]))))
    of_cell, room, tile = {}, 0, -1
    for c in sorted(cells, key=lambda c: c["cell"]):
        parts = -(-c["n"] // BLOCK)
        if parts > 1 or c["n"] > room:
            tile, room = tile + 1, BLOCK if parts == 1 else 0
        of_cell[c["cell"]] = (tile, tile + parts)
        tile, room = tile + parts - 1, max(room - c["n"], 0)
    places = points.sparkSession.createDataFrame(
        [(c, first, end - first) for c, (first, end) in of_cell.items()], "cell bigint, first bigint, parts bigint"
    )
    limits = (nearest, farthest, held)
    tiles = written(_tiled(assigned, places), "tiles")
    queries = tiles if asking is None else _tiled(assigned.join(asking, "id", "left_semi"), places)
    # Rows are whole tiles here: little data, much work. Explicit numbers of
    # partitions keep adaptive execution from merging them into one task.
    questions = written(
        _questions(queries.repartition(min(tile + 1, MAX_TASKS)), space, pivots, limits, k, nprobe, of_cell), "questions")
    # Every part of the questions meets every part of the tiles, without a shuffle of the
    # pairs: what goes on are the k best rows of a question in a part. A part is as large as a task may hold.
    cores = points.sparkSession.sparkContext.defaultParallelism
    groups = min(tile + 1, max(4 * cores, -(-(tile + 1) // TILES)))
    held_bytes = facts["n"] * 8 * (pivots[0].shape[1] + pivots[1].shape[1] + 2)
    parts = min(tile + 1, max(-(-held_bytes // PART_BYTES), -(-2 * cores // groups)))
    pairs = questions.repartition(groups).join(
        tiles.repartition(parts).hint("shuffle_replicate_nl"), F.array_contains("q_meets", F.col("tile"))
    ).drop("q_meets", "tile")
    found = _nearest_in_tiles(pairs, space, pivots, limits, k, nprobe)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "id", "rank", "neighbour", "score"
    )


def knn_exact(
    vectors: DataFrame, k: int = 10, metric: str = "dot", key: str = "id", vector: str = "embedding",
    codes: str | None = None, leaf: int = BLOCK, asking: DataFrame | None = None,
) -> DataFrame:
    """Exact ``(id, rank, neighbour, score)`` for every row, itself excluded.

    ``metric`` is ``dot`` (inner product) or ``euclidean``. ``codes`` names a
    column of category codes that take part as one-hot slots. ``asking`` (a
    DataFrame of ``id``) limits whose neighbours are found.
    """
    points = written(_points(vectors, key, vector, codes), "points")
    return _search(points, k, metric, None, leaf=leaf, asking=asking)


def knn_mixed(
    features: DataFrame, numeric: list[str], categories: list[str], k: int = 10, asking: DataFrame | None = None,
) -> DataFrame:
    """Exact neighbours by Euclidean distance over standardised numbers and
    one-hot categories."""
    from .scaling import apply_numeric, category_hashes, fit_numeric

    scaled = apply_numeric(features, fit_numeric(features, numeric))
    rows = scaled.select(
        F.col("book_id").alias("id"),
        F.array(*[f"z_{c}" for c in numeric]).alias("embedding"),
        category_hashes(features, categories).alias("codes"),
    )
    return knn_exact(rows, k, "euclidean", codes="codes", asking=asking)


def projected_categories(df: DataFrame, columns: list[str], output: str, dims: int = 512, spread: int = 16) -> DataFrame:
    """``df`` with the one-hot slots of text ``columns`` under a sparse random projection.

    Each value has ``spread`` of the ``dims`` slots, drawn by a hash of column, value and
    number, with weight ``1 / sqrt(spread)``. No two values share all of theirs, so their
    squared distance stays near the 2 of one-hot slots, however many values there are; that
    of whole rows is off by about ``sqrt(2 / dims)`` of itself.
    """
    from pyspark.ml.feature import ElementwiseProduct, HashingTF
    from pyspark.ml.linalg import Vectors

    numbers = F.sequence(F.lit(0), F.lit(spread - 1))
    slots = lambda c: F.transform(
        numbers, lambda i: F.concat(F.lit(f"{c}\x1f"), F.col(c), F.lit("\x1f"), i.cast("string")))
    placed = df.withColumn("_slots", F.flatten(F.array(*[slots(c) for c in columns])))
    counted = HashingTF(inputCol="_slots", outputCol="_counts", numFeatures=dims).transform(placed)
    weight = Vectors.dense([spread**-0.5] * dims)
    return ElementwiseProduct(scalingVec=weight, inputCol="_counts", outputCol=output).transform(counted).drop("_slots", "_counts")


def compressed_vectors(
    features: DataFrame, numeric: list[str], categories: list[str], dims: int = 32, hashed: int = 512
) -> DataFrame:
    """Numbers and projected categories reduced by principal components. The projection
    keeps the covariance matrix of bounded size whatever the categories hold."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .scaling import apply_numeric, category_text, fit_numeric

    scaled = apply_numeric(features, fit_numeric(features, numeric)).withColumns(
        {f"_c_{c}": category_text(features, c, "unknown") for c in categories}
    )
    named = [f"_c_{c}" for c in categories]
    if named:
        scaled = projected_categories(scaled, named, "_hashed", hashed)
    assembler = VectorAssembler(inputCols=[*[f"z_{c}" for c in numeric], *["_hashed"] * bool(named)], outputCol="_all")
    # The fit reads the vectors several times; they are made once.
    whole = written(assembler.transform(scaled).select("book_id", "_all"), "whole-vectors")
    return PCA(k=dims, inputCol="_all", outputCol="_few").fit(whole).transform(whole).select(
        F.col("book_id").alias("id"), vector_to_array("_few").alias("embedding")
    )


def knn_compressed(
    features: DataFrame, numeric: list[str], categories: list[str], k: int = 10, dims: int = 32,
    asking: DataFrame | None = None, trained: bool = False,
) -> DataFrame:
    """Neighbours on the compressed vectors, Euclidean: principal components, or, if
    ``trained``, the bottleneck of a network."""
    from .bottleneck import network_vectors

    vectors = (network_vectors if trained else compressed_vectors)(features, numeric, categories, dims)
    return knn_exact(vectors, k, "euclidean", asking=asking)


def knn_ivf(
    vectors: DataFrame, k: int = 10, leaf: int = 500, probe: float = 0.07,
    key: str = "id", vector: str = "embedding", metric: str = "dot",
    asking: DataFrame | None = None,
) -> DataFrame:
    """Approximate neighbours: rows meet only the nearest ``probe`` share of the cells
    around centres drawn by a hash of the id, and always cells with at least k other
    rows. The cell count stops at MAX_CELLS; cells then hold more rows, in more
    blocks, and the share searched stays the same."""
    points = written(_points(vectors, key, vector, None), "points")
    return _search(points, k, metric, probe, leaf=leaf, asking=asking)


def as_lists(neighbours: DataFrame) -> DataFrame:
    """``(book_id, similar_books)``: k ids per book, nearest first."""
    return neighbours.groupBy(F.col("id").alias("book_id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda e: e["neighbour"]
        ).alias("similar_books")
    )


def dot(a, b):
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def nearest_to(vectors: DataFrame, query: list[float], k: int = 5, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Top ``k`` rows by inner product with one query vector; no Python, no shuffle
    beyond the k best rows of each partition."""
    score = dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    scored = vectors.select(key, score.alias("score"))
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def semantic_search(
    vectors: DataFrame, query: str, embedder, k: int = 5, key: str = "id", vector: str = "embedding"
) -> DataFrame:
    """Embed the question and return the ``k`` nearest rows with their scores."""
    question = vectors.sparkSession.createDataFrame([(query,)], "q string")
    embedded = embedder(question, "q", "v").first()["v"]  # one row
    return nearest_to(vectors, list(embedded), k, key, vector)


# The distance that each kind of model ranks by.
MODEL_METRICS = {"exact": "dot", "ivf": "dot", "mixed": "euclidean", "compressed": "euclidean"}


def build_similarity(data: DataFrame, root: str, model: str, search=knn_exact, key: str = "id", **options) -> DataFrame:
    """Neighbour lists of the rows not stored yet, added to the model's table.

    New rows are searched among all rows; stored lists are left as they are. ``data``
    is what ``search`` takes first: vectors, or features for the mixed and compressed
    searches, whose ``key`` is ``book_id``.
    """
    spark: SparkSession = data.sparkSession
    path = f"{root}/model={model}"
    asking = data.select(F.col(key).alias("id"))
    if tables.exists(spark, path):
        done = tables.read(spark, path).select(F.col("book_id").alias("id"))
        asking = written(only_new(asking, done, "id"), "asking")
        if asking.isEmpty():
            return tables.read(spark, path)
    return tables.append_unique(as_lists(search(data, asking=asking, **options)), path)


def similar_books(
    spark: SparkSession, book_id: int, model: str, stores: list[str], vectors: DataFrame, k: int = 10,
    metric: str | None = None,
) -> DataFrame:
    """Neighbours of one book: from the first store that knows k of them (the filter is
    pushed into its files), else computed by the model's distance; empty for an unknown
    id. A stored list shorter than k is taken only when the table has no more rows.
    """
    for root in stores:
        path = f"{root}/model={model}"
        if tables.exists(spark, path):
            hit = tables.read(spark, path).filter(F.col("book_id") == book_id)
            row = hit.select(F.slice("similar_books", 1, k).alias("s")).first()
            if row is not None and (len(row["s"]) == k or len(row["s"]) >= vectors.limit(k + 1).count() - 1):
                return spark.createDataFrame(
                    [(book_id, i + 1, s) for i, s in enumerate(row["s"])],
                    "book_id bigint, rank int, neighbour bigint",
                )
    own = vectors.filter(F.col("id") == book_id).select("embedding").first()
    if own is None:
        return spark.createDataFrame([], "book_id bigint, rank int, neighbour bigint")
    others = vectors.filter(F.col("id") != book_id)
    if (metric or MODEL_METRICS.get(model, "dot")) == "dot":
        found, best = nearest_to(others, list(own["embedding"]), k), F.desc("score")
    else:
        point = F.array(*[F.lit(float(x)) for x in own["embedding"]])
        apart = F.transform(F.arrays_zip(F.col("embedding").alias("x"), point.alias("y")),
                            lambda p: p["x"].cast("double") - p["y"])
        found, best = others.select("id", dot(apart, apart).alias("score")).orderBy("score", "id").limit(k), F.asc("score")
    return found.select(
        F.lit(book_id).cast("long").alias("book_id"),
        F.row_number().over(Window.partitionBy(F.lit(book_id)).orderBy(best, "id")).alias("rank"),
        F.col("id").alias("neighbour"),
    )
