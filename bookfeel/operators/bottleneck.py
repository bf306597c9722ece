"""Compressed vectors from a trained network with a bottleneck.

Numbers and a trained vector per category go through 128 and 64 units to ``dims``, and
back through 64 and 128 to the numbers, which are the targets. The vector of a category
value is the sum of two rows of its column's table, drawn by two hashes: no two values
are likely to share both, and the tables stay bounded however many values there are.

Each round broadcasts the weights; every partition takes them through its rows in small
batches, and the results are averaged by rows. What meets on the driver is one set of
weights, summed block by block in tasks before. A fit depends on the partitions of its
rows; the rows are stored once, so a retried task repeats its work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from . import partials
from .scaling import apply_numeric, category_text, fit_numeric

# Units before and behind the bottleneck, numbers of a category's vector, passes.
UNITS, WIDTH, ROUNDS = (128, 64), 10, 10
SLOTS = 2048  # rows of the table of a category column
BATCH = 32
RATE, KEEP1, KEEP2, TINY = 1e-3, 0.9, 0.999, 1e-7  # of the usual adaptive steps
SLOT_RATE = 0.05


@dataclass
class Network:
    """``table``: the category rows of all columns; ``layers``: weights and offsets in order."""

    table: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    depth: int  # layers up to the bottleneck

    @classmethod
    def start(cls, numbers: int, columns: int, dims: int, seed: int = 0) -> Network:
        draw = np.random.default_rng(seed)
        sizes = [numbers + columns * WIDTH, *UNITS, dims, *UNITS[::-1], numbers]
        layers = []
        for a, b in zip(sizes, sizes[1:]):
            edge = (6 / (a + b)) ** 0.5
            layers.append((draw.uniform(-edge, edge, (a, b)), np.zeros(b)))
        return cls(draw.uniform(-0.05, 0.05, (columns * SLOTS, WIDTH)), layers, len(UNITS) + 1)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.table.ravel(), *[x.ravel() for layer in self.layers for x in layer]])

    def filled(self, flat: np.ndarray) -> Network:
        """A network of this shape with other weights."""
        parts, at = [], 0
        for x in [self.table, *[x for layer in self.layers for x in layer]]:
            parts.append(flat[at:at + x.size].reshape(x.shape).copy())
            at += x.size
        return Network(parts[0], list(zip(parts[1::2], parts[2::2])), self.depth)

    def inputs(self, numbers: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """``slots``: two rows of the table per category column."""
        if not slots.shape[1]:
            return numbers
        rows = self.table[slots]
        vectors = rows[:, 0::2] + rows[:, 1::2]
        return np.concatenate([numbers, vectors.reshape(len(numbers), -1)], 1)

    def forward(self, x: np.ndarray, upto: int | None = None) -> list[np.ndarray]:
        """What each layer gives, the inputs first; all but the last layer cut off below 0."""
        out = [x]
        for k, (w, b) in enumerate(self.layers[:upto]):
            y = out[-1] @ w + b
            out.append(y if k == len(self.layers) - 1 else np.maximum(y, 0))
        return out

    def encoded(self, numbers: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return self.forward(self.inputs(numbers, slots), self.depth)[-1]

    def decoded(self, numbers: np.ndarray, slots: np.ndarray) -> np.ndarray:
        return self.forward(self.inputs(numbers, slots))[-1]

    def gradients(self, numbers: np.ndarray, slots: np.ndarray):
        """Mean squared error per row summed over the numbers, and its slopes: of the layers, and of the inputs' category part."""
        values = self.forward(self.inputs(numbers, slots))
        apart = values[-1] - numbers
        back, slopes = 2 * apart / len(numbers), []
        for k in range(len(self.layers) - 1, -1, -1):
            w, _ = self.layers[k]
            slopes.append((values[k].T @ back, back.sum(0)))
            back = back @ w.T
            if k:
                back = back * (values[k] > 0)
        return (apart * apart).sum() / len(numbers), slopes[::-1], back[:, numbers.shape[1]:]

    def trained(self, numbers: np.ndarray, slots: np.ndarray, seed: int) -> Network:
        """Once through the rows, in a drawn order, ``BATCH`` at a time."""
        net = self.filled(self.flat())
        weights = [x for layer in net.layers for x in layer]
        first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
        heat = np.full(len(net.table), 1e-3)  # squared slopes seen by a table row
        order = np.random.default_rng(seed).permutation(len(numbers))
        for step, low in enumerate(range(0, len(order), BATCH), 1):
            some = order[low:low + BATCH]
            _, slopes, vectors = net.gradients(numbers[some], slots[some])
            rate = RATE * (1 - KEEP2**step) ** 0.5 / (1 - KEEP1**step)
            for x, m, v, g in zip(weights, first, second, [g for pair in slopes for g in pair]):
                m += (1 - KEEP1) * (g - m)
                v += (1 - KEEP2) * (g * g - v)
                x -= rate * m / (np.sqrt(v) + TINY)
            if slots.shape[1]:
                each = np.repeat(vectors.reshape(len(some), -1, WIDTH), 2, axis=1).reshape(-1, WIDTH)
                rows, which = np.unique(slots[some].ravel(), return_inverse=True)
                sums = np.zeros((len(rows), WIDTH))
                np.add.at(sums, which, each)
                heat[rows] += (sums * sums).mean(1)
                net.table[rows] -= SLOT_RATE * sums / np.sqrt(heat[rows])[:, None]
        return net


def _rows(features: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """``id, numbers, slots`` of every book."""
    scaled = apply_numeric(features, fit_numeric(features, numeric))
    slots = [
        (F.pmod(F.xxhash64(category_text(features, c, "nan"), F.lit(turn)), F.lit(SLOTS)) + i * SLOTS).cast("int")
        for i, c in enumerate(categories) for turn in (0, 1)]
    return scaled.select(
        F.col("book_id").alias("id"), F.array(*[f"z_{c}" for c in numeric]).alias("numbers"),
        (F.array(*slots) if slots else F.array().cast("array<int>")).alias("slots"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield _matrix(batch.column("numbers")), _matrix(batch.column("slots")).astype(np.int64)


def fit(rows: DataFrame, numbers: int, columns: int, dims: int = 32, rounds: int = ROUNDS, seed: int = 0) -> Network:
    """A network trained on stored ``rows`` (``numbers``, ``slots``), ``rounds`` times over all of them."""
    net = Network.start(numbers, columns, dims, seed)
    size = len(net.flat())
    for turn in range(rounds):
        def part(batches, net=net, turn=turn):
            n, own = 0, net
            for k, (x, s) in enumerate(_parts(batches)):  # batch after batch, as they come
                own, n = own.trained(x, s, seed + 1000 * turn + k), n + len(x)
            return np.append(own.flat() * n, n) if n else None

        total = partials.summed(rows, size + 1, part)
        if not total[-1]:
            break
        net = net.filled(total[:-1] / total[-1])
    return net


def error(rows: DataFrame, net: Network) -> float:
    """Mean squared difference of the numbers and what the network makes of them."""
    def part(batches):
        out = np.zeros(2)
        for x, s in _parts(batches):
            out += ((net.decoded(x, s) - x) ** 2).sum(), x.size
        return out

    total = partials.summed(rows, 2, part)
    return float(total[0] / total[1]) if total[1] else 0.0


def encode(rows: DataFrame, net: Network) -> DataFrame:
    """``id, embedding``: what the bottleneck gives."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, s in _parts([batch]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(list(net.encoded(x, s)), pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.mapInArrow(run, f"id {kind}, embedding array<double>")


def network_vectors(features: DataFrame, numeric: list[str], categories: list[str], dims: int = 32, rounds: int = ROUNDS) -> DataFrame:
    """``id, embedding`` of every book by a network trained on all of them."""
    rows = written(_rows(features, numeric, categories), "network-rows")
    return encode(rows, fit(rows, len(numeric), len(categories), dims, rounds))
