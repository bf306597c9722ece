"""Text quality by naive Bayes support vectors.

Features are indicators of hashed n-grams: one to three bytes, one and two words, and
a word two to four times in a row. Each is scaled by the log ratio of its smoothed counts in
good and bad texts; on the scaled, length-normed rows a linear hinge-loss model is
fitted by dual coordinate descent, and a sigmoid over margins of rows kept out of the
fit turns margins into scores.

The fit takes a bounded sample of labelled rows (``sample``, by hash of the key); the
scoring reads every whole text. A null or empty text has no n-grams and gets the score
of the intercept. Labels other than 0 and 1 are passed over; a key with several labels
takes the least. Without labels of both classes every score is the share of label 1
(a half without any). Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
BITS = 16
SIZE = 1 << BITS
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]  # odd multipliers


def _slots(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * _MIX[kind]
    return (x ^ (x >> np.uint32(13))) * _MIX[(kind + 1) % 5] >> np.uint32(32 - BITS)


def grams(text: str | None) -> np.ndarray:
    """Distinct slots of the n-grams of a text, ascending."""
    if not text:
        return np.empty(0, np.uint16)
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    words = np.array([zlib.crc32(w) for w in text.encode().split()], np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    out = [_slots(b, 0), _slots(two + np.uint32(1 << 16), 1),
           _slots((two[:-1] << np.uint32(8) | b[2:]) + np.uint32(1 << 24), 2), _slots(words, 3)]
    if len(words) > 1:
        left, right = words[:-1], words[1:]
        out.append(_slots(left * np.uint32(31) + right, 4))
        run = left == right  # slots 0 to 2: a word two, three or four times in a row
        for n in range(3):
            if run.any():
                out.append(np.array([n], np.uint32))
            run = run[:-1] & run[1:]
    slots = np.sort(np.concatenate(out).astype(np.uint16), kind="stable")
    return slots[np.concatenate([[True], slots[1:] != slots[:-1]])]


@dataclass
class Model:
    weights: np.ndarray  # per slot, the log-count ratio included
    intercept: float
    slope: float = 1.0  # of the sigmoid
    shift: float = 0.0

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum()) / np.sqrt(max(1, len(slots))) + self.intercept

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def _counted(rows: list[np.ndarray], which: np.ndarray, at_once: int = 256) -> np.ndarray:
    """How many of the rows have each slot."""
    counts = np.zeros(SIZE, np.int64)
    for low in range(0, len(which), at_once):
        counts += np.bincount(np.concatenate([rows[i] for i in which[low:low + at_once]]), minlength=SIZE)
    return counts


def _hinge_by_dual_ascent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray,
                          rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights over ``ratio``-scaled indicator rows, and the intercept."""
    def value(x: np.ndarray) -> np.ndarray:  # made anew each time: all at once are many times the slots
        return ratio[x] / np.sqrt(len(x)) if len(x) else ratio[x]

    norms = np.array([v @ v + 1 for v in map(value, rows)])
    w, intercept, alpha = np.zeros(SIZE), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        for i in draw.permutation(len(rows)):
            own = value(rows[i])
            gap = y[i] * (own @ w[rows[i]] + intercept) - 1
            new = min(max(alpha[i] - gap / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * own
                intercept += step
                alpha[i] = new
    return w, intercept


def _sigmoid(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of greatest likelihood, by Newton steps on softened targets."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    x, at = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        slope = x.T @ (p - target) + 1e-3 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, aside: np.ndarray, smooth: float = 1.0,
             cost: float = 1.0) -> Model:
    """``rows``: distinct slots per text; ``aside``: rows for the sigmoid only."""
    good = labels == 1
    fit = ~aside
    if not (good & fit).any() or not (~good & fit).any():
        share = np.clip(good.mean() if len(good) else 0.5, 1e-6, 1 - 1e-6)
        return Model(np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = [smooth + _counted(rows, np.flatnonzero(fit & side)) for side in (good, ~good)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    index = np.flatnonzero(fit)
    y = np.where(good[index], 1.0, -1.0)
    each = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))  # classes weigh alike
    w, intercept = _hinge_by_dual_ascent([rows[i] for i in index], y, ratio, each)
    model = Model(w * ratio, intercept)
    kept = np.flatnonzero(aside)
    if good[kept].any() and not good[kept].all():
        model.slope, model.shift = _sigmoid(np.array([model.margin(rows[i]) for i in kept]), good[kept])
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> Model:
    """Fit on at most ``sample`` labelled keys."""
    chosen = (
        labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_key"))
        .agg(F.min(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [grams(x).astype("<u2").tobytes() for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_label"), pa.array(packed, pa.binary())],
                names=["_key", "_label", "slots"])

    kind = docs.schema[key].dataType.simpleString()
    rows = (  # the sample is bounded, so it goes to the texts
        docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key")
        .select("_key", "_label", "_text").mapInArrow(slots, f"_key {kind}, _label int, slots binary")
        .select("*", (F.crc32(F.col("_key").cast("string")) % 5 == 1).alias("aside")).collect()
    )
    rows.sort(key=lambda r: (r["_key"], r["slots"]))
    return fit_rows([np.frombuffer(r["slots"], "<u2") for r in rows],
                    np.array([r["_label"] for r in rows], int), np.array([r["aside"] for r in rows], bool))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a score column; every other column is kept as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(model.margin(grams(x))) for x in batch.column(text).to_pylist()]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=[*names, into])

    names = [c for c in docs.columns if c != into]
    return docs.select(*names).mapInArrow(run, docs.select(*names).schema.add(into, "double"))
