"""Near-duplicate vectors by counted collisions of one-dimensional projections.

Every distinct vector, scaled to length 1, is projected on orthonormal directions.
Two vectors collide on a direction when their projections lie within a window; pairs
that collide often enough are verified by their cosine in double precision. The count
asked for is the largest one that a pair at the threshold reaches with probability
``recall``. Vectors are sorted by the first projection and packed into blocks; a
block meets those whose first projections come within the greatest distance that a
linked pair can have, which loses nothing. Collisions are counted block against block
inside a task, which hands on links per vector and a spanning set of edges, not pairs.
Work stays quadratic in the vectors within that distance on the first projection.

Null, empty and zero vectors, and those with null or non-finite components, link with
nothing. Equal vectors are compared once and counted as often as they occur. Vectors
of different dimensions never link. Null ids have links but lend no id to a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from .components import components

DIRECTIONS = 24
BLOCK = 4096
STRIP = 64  # rows counted at once
STEPS = 24  # of a window


def calibrated(threshold: float, dim: int, recall: float = 0.99999, width: float = 1.5) -> tuple[int, float, int]:
    """Directions, half-width of the window, and the count to ask for."""
    m = min(DIRECTIONS, dim)
    hit = math.erf(width / math.sqrt(2))  # chance that a pair at the threshold collides on a direction
    need, missed = 0, 0.0
    while need < m:
        missed += math.comb(m, need) * hit**need * (1 - hit) ** (m - need)
        if missed > 1 - recall:
            break
        need += 1
    return m, width * math.sqrt((2 - 2 * threshold) / dim), need


def directions(dim: int, m: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, m)))[0]


def usable(vector: Column) -> Column:
    """Whether a vector can be compared at all."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(packed: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed.to_pylist()), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(reps: DataFrame) -> DataFrame:
    """Vectors sorted by dimension and first projection, ``BLOCK`` to a row."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axis: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = [np.array(v, "<f8") for v in batch.column("_n_vec").to_pylist()]
            first = []
            for v in vectors:
                d = axis.setdefault(len(v), directions(len(v), min(DIRECTIONS, len(v)))[:, 0])
                u = v / np.abs(v).max()
                first.append(float(u @ d) / float(np.sqrt(u @ u)))
            yield pa.RecordBatch.from_arrays([
                batch.column("_n_rep"), batch.column("_n_count"), pa.array([len(v) for v in vectors], pa.int32()),
                pa.array(first, pa.float64()), pa.array([v.tobytes() for v in vectors], pa.binary()),
            ], names=["_n_rep", "_n_count", "_n_dim", "_n_first", "_n_packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, held, dim = TaskContext.get().partitionId(), 0, [], None

        def block(rows: pa.Table) -> pa.RecordBatch:
            first = rows["_n_first"]
            return pa.RecordBatch.from_arrays([
                pa.array([piece], pa.int32()), pa.array([number], pa.int32()),
                pa.array([rows["_n_dim"][0].as_py()], pa.int32()),
                pa.array([first[0].as_py()]), pa.array([first[-1].as_py()]),
                pa.array([rows["_n_rep"].to_pylist()], pa.list_(pa.int64())),
                pa.array([rows["_n_count"].to_pylist()], pa.list_(pa.int64())),
                pa.array([b"".join(rows["_n_packed"].to_pylist())], pa.binary()),
            ], names=["piece", "number", "dim", "low", "high", "reps", "counts", "packed"])

        for batch in batches:
            dims = batch.column("_n_dim").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (dims[a] != dim or sum(x.num_rows for x in held) >= BLOCK):
                        yield block(pa.Table.from_batches(held))
                        number, held = number + 1, []
                    dim = dims[a]
                    take = min(b - a, BLOCK - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield block(pa.Table.from_batches(held))

    projected = written(reps.select("_n_rep", "_n_count", "_n_vec").mapInArrow(
        project, "_n_rep bigint, _n_count bigint, _n_dim int, _n_first double, _n_packed binary"), "vector-projections")
    return written(
        projected.repartitionByRange("_n_dim", "_n_first", "_n_rep").sortWithinPartitions("_n_dim", "_n_first", "_n_rep")
        .mapInArrow(pack, "piece int, number int, dim int, low double, high double, reps array<bigint>, "
                          "counts array<bigint>, packed binary"), "vector-blocks")


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of each pair; ``labels`` point to the least member."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def compare(left: np.ndarray, right: np.ndarray, left_n: np.ndarray, right_n: np.ndarray, same: bool,
            threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block of unit vectors with another: their number per vector (left
    ones first; each linked vector counts as often as it occurs) and class labels."""
    m, half, need = calibrated(threshold, left.shape[1])
    axes, step = directions(left.shape[1], m), max(half / STEPS, 1e-12)
    # Windows are whole steps, a little wider than asked for; steps count modulo 256.
    a, b = ((np.floor(x @ axes / step).astype(np.int64) & 255).astype(np.uint8).T.copy() for x in (left, right))
    a += np.uint8(STEPS + 1)
    links, labels = np.zeros(len(left) + len(right), np.int64), np.arange(len(left) + len(right))
    gap, hits = (np.empty((STRIP, len(right)), t) for t in (np.uint8, bool))
    for at in range(0, len(left), STRIP):
        n = min(STRIP, len(left) - at)
        count = np.zeros((n, len(right)), np.uint8)
        for k in range(m):
            np.subtract(a[k, at:at + n, None], b[k], out=gap[:n])
            np.less_equal(gap[:n], 2 * STEPS + 2, out=hits[:n])
            np.add(count, hits[:n].view(np.uint8), out=count)
        i, j = np.nonzero(count >= need)
        i += at
        if same:
            i, j = i[j > i], j[j > i]
        for part in range(0, len(i), 1 << 18):
            x, y = i[part:part + (1 << 18)], j[part:part + (1 << 18)]
            linked = np.einsum("ij,ij->i", left[x], right[y]) >= threshold
            x, y = x[linked], y[linked]
            links += np.bincount(x, right_n[y], len(links)).astype(np.int64)
            links += np.bincount(y + len(left), left_n[x], len(links)).astype(np.int64)
            _merge(labels, x, y + (0 if same else len(left)))
    if same:
        links[:len(left)] += links[len(left):]
        links, labels = links[:len(left)], labels[:len(left)]
    return links, labels


def _linked(blocks: DataFrame, threshold: float) -> DataFrame:
    """``rep, links, root`` by pair of blocks, for vectors that have links there."""
    reach = math.sqrt(2 - 2 * threshold) + 1e-9  # a projection shortens distances
    order = Window.orderBy("dim", "low", "piece", "number")  # one row per BLOCK vectors
    index = written(blocks.select("piece", "number", "dim", "low", "high", (F.row_number().over(order) - 1).alias("i")),
                    "vector-index")
    # The last block that begins within reach: running maximum over begins and ends.
    marks = index.select("dim", F.col("low").alias("x"), F.lit(0).alias("end"), "i").union(
        index.select("dim", (F.col("high") + reach).alias("x"), F.lit(1).alias("end"), "i"))
    last = F.max(F.when(F.col("end") == 0, F.col("i"))).over(Window.partitionBy("dim").orderBy("x", "end", "i"))
    pairs = marks.withColumn("last", last).where("end = 1").select(
        "i", F.explode(F.sequence("i", F.greatest("i", "last"))).alias("j"))
    numbered = written(blocks.join(index.select("piece", "number", "i"), ["piece", "number"]).select(
        "i", "dim", "reps", "counts", "packed"), "vector-blocks")
    other = numbered.select(*(F.col(c).alias(f"{c}_") for c in ("reps", "counts", "packed")), F.col("i").alias("j"))
    both = pairs.join(numbered, "i").join(other, "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                dim, same = row["dim"].as_py(), row["i"].as_py() == row["j"].as_py()
                left, right = (_units(batch.column(c).slice(k, 1), dim) for c in ("packed", "packed_"))
                ids, ids_, n, n_ = (row[c].values.to_numpy() for c in ("reps", "reps_", "counts", "counts_"))
                links, labels = compare(left, right, n, n_, same, threshold)
                ids = ids if same else np.concatenate([ids, ids_])
                at = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(links[at]), pa.array(ids[labels[at]])], names=["rep", "links", "root"])

    return both.mapInArrow(run, "rep bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """Per row: ``key``, ``n_links``, ``component_id`` (least id of its component) and
    ``kept`` (whether it has that id)."""
    rows = vectors.select(F.col(key).alias("_n_id"), F.col(vector).alias("_n_vec"))
    sound = rows.where(usable(F.col("_n_vec")))
    reps = written(sound.groupBy("_n_vec").agg(F.count("*").alias("_n_count"), F.min("_n_id").alias("_n_least"))
                   .withColumn("_n_rep", F.monotonically_increasing_id()), "vector-copies")
    linked = written(_linked(_blocks(reps), threshold), "vector-links")
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per_rep = written(
        reps.drop("_n_vec").join(links, F.col("_n_rep") == F.col("rep"), "left")
        .join(roots, F.col("_n_rep") == F.col("node"), "left")
        .select("_n_rep", F.coalesce("root", "_n_rep").alias("root"), "_n_least",
                (F.coalesce("links", F.lit(0)) + F.col("_n_count") - 1).alias("n_links")), "vector-classes")
    least = written(per_rep.groupBy("root").agg(F.min("_n_least").alias("component_id")), "vector-components")
    classes = written(reps.select("_n_rep", "_n_vec").join(per_rep, "_n_rep").join(least, "root")
                      .select("_n_vec", "n_links", "component_id"), "vector-classes")
    found = sound.join(classes, "_n_vec").select("_n_id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("_n_vec"))).select(
        "_n_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_n_id").alias("component_id"))
    return found.union(alone).select(
        F.col("_n_id").alias(key), "n_links", "component_id",
        F.col("_n_id").eqNullSafe(F.col("component_id")).alias("kept"))
