"""Latent Dirichlet allocation by batch variational Bayes.

Texts are rows of (term index, weight); the topics are one table of topics by terms,
bounded by the vocabulary's own bound, that the driver holds and every task gets. A round
is one pass over the texts: each task fits the topic shares of its texts against the
table and sums what they add to it (E step); the sums meet by blocks of terms (M step).
Start values are drawn from hashes of topic and term, so a fit is repeatable whatever
the partitions. A text stops by its own change, so its shares do not depend on the others
in its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import partials

TINY = np.finfo(np.float64).eps


@dataclass
class Topics:
    """``weights``: topics by terms (pseudo-counts); ``prior`` of shares and of terms."""

    weights: np.ndarray
    terms: list[str]
    prior: float

    def top(self, count: int) -> list[tuple[int, int, str, float]]:
        """Topic, rank from 1, term, weight; equal weights by term."""
        out = []
        for topic, row in enumerate(self.weights):
            order = sorted(range(len(row)), key=lambda i: (-row[i], self.terms[i]))[:count]
            out += [(topic, rank, self.terms[i], float(row[i])) for rank, i in enumerate(order, 1)]
        return out


def digamma(x: np.ndarray) -> np.ndarray:
    """For positive ``x``, by recurrence and the asymptotic series."""
    x = np.array(x, dtype=np.float64)
    out = np.zeros_like(x)
    for _ in range(8):
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def start_weights(terms: list[str], k: int, seed: int) -> np.ndarray:
    """About gamma(100, 1/100), from a hash of seed, topic and term."""
    draws = np.array([
        [np.frombuffer(hashlib.md5(f"{seed}|{topic}|{term}".encode()).digest(), np.uint32)[:2] for term in terms]
        for topic in range(k)], dtype=np.float64).reshape(k, len(terms), 2)
    u = (draws + 0.5) / 2.0**32
    normal = np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1])
    return (1 - 1 / 900 + normal / 30) ** 3


def expectations(weights: np.ndarray) -> np.ndarray:
    """exp(E[log of a term's share]) by term and topic."""
    return np.exp(digamma(weights) - digamma(weights.sum(1))[:, None]).T.copy()


def shares(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, table: np.ndarray, prior: float,
           rounds: int = 100, change: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """E step over texts of ``sizes`` entries each: pseudo-counts of topics by text, and exp(E[log share])."""
    k = table.shape[1]
    gamma = np.ones((len(sizes), k))
    expected = np.exp(digamma(gamma) - digamma(gamma.sum(1))[:, None])
    gamma[sizes == 0] = prior
    left = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)
    rows = table[terms]
    for _ in range(rounds):
        if not len(left):
            break
        size = sizes[left]
        at = np.arange(size.sum()) + np.repeat(ends[left] - np.cumsum(size), size)  # entries of the texts left
        first = np.cumsum(size) - size
        part = rows[at]
        norm = np.einsum("ij,ij->i", np.repeat(expected[left], size, axis=0), part) + TINY
        sums = np.add.reduceat(part * (counts[at] / norm)[:, None], first, axis=0)
        new = prior + expected[left] * sums
        moved = np.abs(new - gamma[left]).mean(1)
        gamma[left] = new
        expected[left] = np.exp(digamma(new) - digamma(new.sum(1))[:, None])
        left = left[moved >= change]
    return gamma, expected


def _entries(batch: pa.RecordBatch):
    terms = batch.column("terms")
    sizes = np.asarray(terms.value_lengths()).astype(np.int64)
    return (sizes, np.asarray(terms.flatten()).astype(np.int64), np.asarray(batch.column("counts").flatten(), dtype=np.float64))


def _added(texts: DataFrame, table: np.ndarray, prior: float) -> np.ndarray:
    """What all texts add to the weights, topics by terms."""
    v, k = table.shape

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros((k, v))
        for batch in batches:
            sizes, terms, counts = _entries(batch)
            if not len(terms):
                continue
            _, expected = shares(sizes, terms, counts, table, prior)
            own = np.repeat(expected, sizes, axis=0)
            norm = np.einsum("ij,ij->i", own, table[terms]) + TINY
            own *= (counts / norm)[:, None]
            for topic in range(k):
                total[topic] += np.bincount(terms, own[:, topic], v)
        return total.ravel() if total.any() else None

    return table.T * partials.summed(texts, k * v, part).reshape(k, v)


def fit(texts: DataFrame, terms: list[str], k: int, rounds: int = 100, seed: int = 0, tolerance: float = 1e-4) -> Topics:
    """Topics of ``texts`` (``id``, ``terms`` indices, ``counts`` weights), each round over all of them.
    Rounds end when no term's share of a topic moves by ``tolerance`` of the largest share."""
    prior = 1.0 / k
    weights = start_weights(terms, k, seed)
    for _ in range(rounds):
        new = prior + _added(texts, expectations(weights), prior)
        old_part, part = weights / weights.sum(1)[:, None], new / new.sum(1)[:, None]
        weights = new
        if np.abs(part - old_part).max() < tolerance * part.max():
            break
    return Topics(weights, terms, prior)


def mixtures(texts: DataFrame, topics: Topics) -> DataFrame:
    """``id, mixture``: shares of the topics in every text; equal ones where it has no known term."""
    table, prior = expectations(topics.weights), topics.prior

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gamma, _ = shares(*_entries(batch), table, prior)
            parts = gamma / gamma.sum(1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(list(parts), pa.list_(pa.float64()))], ["id", "mixture"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "terms", "counts").mapInArrow(run, f"id {kind}, mixture array<double>")
