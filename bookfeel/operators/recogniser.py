"""Place names recognised in free text: a linear-chain conditional random field.

Words carry hashed features of themselves and their neighbours; a name is a word tagged
``B`` and the ``I`` words behind it. The features are made once and stored. A round of training
broadcasts the weights, every partition takes them through its sentences by stochastic gradients,
and the results are averaged by sentences (summed block by block in tasks, see :mod:`.partials`).
Where a partition has many sentences, some are taken side by side. Decoding
is Viterbi's; an entity's score is the least probability of its tags.

``entity_model`` makes a loader for :func:`.places.extract_entities`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import written
from . import partials

OUTSIDE, BEGIN, INSIDE = range(3)
SLOTS = 1 << 16  # of hashed features
NEVER = -1e4  # an I that follows no name
WORD = re.compile(r"\w+|[^\w\s]")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
LONG = 400  # words decoded in one run; longer sentences are cut there
MANY = 4096  # words whose sentences are decoded side by side, at least one sentence
ALONE, SIDE = 256, 64  # a step takes one sentence for each ALONE that a batch holds, at most SIDE


@lru_cache(1 << 16)
def _shape(word: str) -> str:
    kind = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", word)
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"\d", "d", kind))


def features(words: list[str]) -> np.ndarray:
    """Slots of every word's features, one row a word."""
    shapes = ["<", *map(_shape, words), ">"]
    lower = ["<", *(w.lower() for w in words), ">"]
    out = np.empty((len(words), 10), np.int64)
    for i in range(len(words)):
        k = i + 1
        texts = (f"b{lower[k - 1]}", f"a{lower[k + 1]}", f"B{shapes[k - 1]}{shapes[k]}", f"A{shapes[k]}{shapes[k + 1]}",
                 f"f{i == 0}{shapes[k]}", f"2{lower[k - 1]}|{shapes[k]}")
        out[i] = (*_own_slots(lower[k], shapes[k]), *map(_slot, texts))
    return out


def _slot(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % SLOTS


@lru_cache(1 << 16)
def _own_slots(lower: str, shape: str) -> tuple[int, int, int, int]:
    return _slot(f"w{lower}"), _slot(f"s{shape}"), _slot(f"p{lower[:3]}"), _slot(f"e{lower[-3:]}")


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Field:
    """``weights`` of slots by tag, ``steps`` from tag to tag; ``start`` of the first tag."""

    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray) -> Field:
        n = SLOTS * 3
        return cls(flat[:n].reshape(SLOTS, 3).copy(), flat[n:n + 9].reshape(3, 3).copy(), flat[n + 9:n + 12].copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.steps.ravel(), self.start])

    def parts(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word's tags (the start in the first), and of steps, forbidden ones out of reach."""
        own = self.weights[slots].sum(1)
        own[0] += self.start
        own[0, INSIDE] += NEVER
        steps = self.steps.copy()
        steps[OUTSIDE, INSIDE] += NEVER
        return own, steps

    def decode(self, slots: np.ndarray) -> np.ndarray:
        """The best tags (Viterbi)."""
        return self.decode_all([slots])[0][0]

    def decode_all(self, sentences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best tags of each sentence and their probabilities. All sentences go forward side by side,
        longest first, so that those with an i-th word are the first ones."""
        sizes = np.array([len(s) for s in sentences])
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        last = first + sizes[order] - 1
        longest = int(sizes.max())
        live = [int((sizes > i).sum()) for i in range(longest)]
        own = self.weights[np.concatenate(sentences)].sum(1)
        own[first] += self.start
        own[first, INSIDE] += NEVER
        steps = self.steps.copy()
        steps[OUTSIDE, INSIDE] += NEVER
        best, back, tags = own[first], np.zeros((len(own), 3), np.int64), np.empty(len(own), np.int64)
        forward, backward = own.copy(), np.zeros_like(own)
        for i in range(1, longest):
            n, at = live[i], first[:live[i]] + i
            ways = best[:n, :, None] + steps
            back[at] = ways.argmax(1)
            best[:n] = ways.max(1) + own[at]
            forward[at] += _sum(forward[at - 1][:, :, None] + steps, 1)
        tags[last] = best.argmax(1)
        for i in range(longest - 1, 0, -1):
            at = first[:live[i]] + i
            tags[at - 1] = back[at, tags[at]]
            backward[at - 1] = _sum(steps + (own[at] + backward[at])[:, None, :], 2)
        whole = np.empty(len(sizes))
        whole[order] = _sum(forward[last], 1)
        words = np.arange(len(own))
        chances = np.exp(forward[words, tags] + backward[words, tags] - np.repeat(whole, sizes))
        edges = np.cumsum(sizes)[:-1]
        return list(zip(np.split(tags, edges), np.split(chances, edges)))

    def marginals(self, slots: np.ndarray):
        """Log of the sum over all taggings, probabilities of tags by word and of steps in all."""
        own, steps = self.parts(slots)
        forward, backward = own.copy(), np.zeros_like(own)
        for i in range(1, len(own)):
            forward[i] += _sum(forward[i - 1][:, None] + steps, 0)
        for i in range(len(own) - 2, -1, -1):
            backward[i] = _sum(steps + (own[i + 1] + backward[i + 1])[None, :], 1)
        whole = _sum(forward[-1], 0)
        pairs = np.zeros((3, 3))
        if len(own) > 1:
            pairs = np.exp(forward[:-1, :, None] + steps + (own[1:] + backward[1:])[:, None, :] - whole).sum(0)
        return float(whole), np.exp(forward + backward - whole), pairs

    def loss(self, slots: np.ndarray, tags: np.ndarray) -> float:
        own, steps = self.parts(slots)
        return self.marginals(slots)[0] - own[np.arange(len(tags)), tags].sum() - steps[tags[:-1], tags[1:]].sum()

    def step(self, slots: np.ndarray, tags: np.ndarray, rate: float) -> None:
        """One step down the slope of one sentence's loss."""
        _, tag, pairs = self.marginals(slots)
        tag[np.arange(len(tags)), tags] -= 1
        np.subtract.at(pairs, (tags[:-1], tags[1:]), 1)
        np.subtract.at(self.weights, slots, rate * np.repeat(tag[:, None, :], slots.shape[1], 1))
        self.steps -= rate * pairs
        self.start -= rate * tag[0]


    def step_all(self, slots: np.ndarray, tags: np.ndarray, sizes: np.ndarray, rate: float) -> None:
        """One step for sentences side by side (their words one after another): every weight goes down
        the mean of its slopes in those of the sentences that hold it."""
        if len(sizes) == 1:
            return self.step(slots, tags, rate)
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        last, longest = first + sizes[order] - 1, int(sizes.max())
        live = [int((sizes > i).sum()) for i in range(longest)]
        own = self.weights[slots].sum(1)
        own[first] += self.start
        own[first, INSIDE] += NEVER
        steps = self.steps.copy()
        steps[OUTSIDE, INSIDE] += NEVER
        forward, backward = own.copy(), np.zeros_like(own)
        for i in range(1, longest):
            at = first[:live[i]] + i
            forward[at] += _sum(forward[at - 1][:, :, None] + steps, 1)
        for i in range(longest - 1, 0, -1):
            at = first[:live[i]] + i
            backward[at - 1] = _sum(steps + (own[at] + backward[at])[:, None, :], 2)
        whole = np.empty(len(sizes))
        whole[order] = _sum(forward[last], 1)
        each = np.repeat(whole, sizes)[:, None]
        tag = np.exp(forward + backward - each)
        tag[np.arange(len(tags)), tags] -= 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.flatnonzero(row[1:] == row[:-1])  # words with another behind them
        if len(inner):
            pairs = np.exp(forward[inner, :, None] + steps + (own + backward)[inner + 1, None, :] - each[inner, :, None]).sum(0)
            np.subtract.at(pairs, (tags[inner], tags[inner + 1]), 1)
            self.steps -= rate * pairs / (sizes > 1).sum()
        # A slot's slopes, and the sentences that hold it.
        known, place = np.unique(slots.ravel(), return_inverse=True)
        slopes = np.stack([np.bincount(place, np.repeat(tag[:, k], slots.shape[1]), len(known)) for k in range(3)], 1)
        held = np.unique(place.astype(np.int64) * len(sizes) + np.repeat(row, slots.shape[1])) // len(sizes)
        self.weights[known] -= rate * slopes / np.bincount(held, minlength=len(known))[:, None]
        self.start -= rate * tag[first].mean(0)


def _coded(sentences: DataFrame) -> DataFrame:
    """``slots`` (ten a word, one after another) and ``tags`` of each sentence with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(w, t) for w, t in zip(batch.column("words").to_pylist(), batch.column("tags").to_pylist()) if w]
            yield pa.RecordBatch.from_arrays([
                pa.array([features(w).ravel().astype(np.int32) for w, _ in kept], pa.list_(pa.int32())),
                pa.array([t for _, t in kept], pa.list_(pa.int32()))], ["slots", "tags"])

    return written(sentences.select("words", "tags").mapInArrow(run, "slots array<int>, tags array<int>"), "coded")


def fit(sentences: DataFrame, rounds: int = 8, rate: float = 0.2) -> Field:
    """Trained on stored rows of ``words`` and ``tags`` (0 outside, 1 begins, 2 inside a name), all of them in each round."""
    flat, coded = np.zeros(SLOTS * 3 + 12), _coded(sentences)
    for turn in range(rounds):
        def part(batches: Iterator[pa.RecordBatch], flat=flat, turn=turn) -> np.ndarray | None:
            field, n = Field.of(flat), 0
            for batch in batches:
                sizes = np.asarray(batch.column("tags").value_lengths()).astype(np.int64)
                tags = np.asarray(batch.column("tags").flatten()).astype(np.int64)
                slots = np.asarray(batch.column("slots").flatten()).astype(np.int64).reshape(len(tags), -1)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                side = min(SIDE, max(1, len(sizes) // ALONE))
                for low in range(0, len(sizes), side):
                    high = min(low + side, len(sizes))
                    a, b = edges[low], edges[high]
                    field.step_all(slots[a:b], tags[a:b], sizes[low:high], rate / (1 + turn))
                n += len(sizes)
            return np.append(field.flat() * n, n) if n else None

        total = partials.summed(coded, len(flat) + 1, part)
        if not total[-1]:
            break
        flat = total[:-1] / total[-1]
    return Field.of(flat)


def recognise(field: Field, text: str) -> list[dict]:
    """Entities of a whole text in order: ``entity_group``, ``score``, ``word`` (as it stands in the text)."""
    return recognise_all(field, [text])[0]


def recognise_all(field: Field, texts: list[str]) -> list[list[dict]]:
    """:func:`recognise` for each of the texts, some ``MANY`` words of them at a time."""
    out: list[list[dict]] = [[] for _ in texts]
    held: list[tuple[int, str, list[re.Match], np.ndarray]] = []

    def tell() -> None:
        for (i, sentence, part, _), (tags, chances) in zip(held, field.decode_all([h[3] for h in held])):
            for low in np.flatnonzero(tags == BEGIN).tolist():
                high = low + 1
                while high < len(tags) and tags[high] == INSIDE:
                    high += 1
                out[i].append({"entity_group": "LOC", "score": float(chances[low:high].min()),
                               "word": sentence[part[low].start():part[high - 1].end()]})
        held.clear()

    words = 0
    for i, text in enumerate(texts):
        for sentence in SENTENCE.split(text):
            found = list(WORD.finditer(sentence))
            for low in range(0, len(found), LONG):
                part = found[low:low + LONG]
                held.append((i, sentence, part, features([m[0] for m in part])))
                words += len(part)
                if words >= MANY:
                    tell()
                    words = 0
    if held:
        tell()
    return out


def entity_model(field: Field) -> Callable[[], Callable[[list[str]], list[list[dict]]]]:
    """A loader for ``extract_entities``; the weights travel with the tasks."""
    return lambda: lambda texts: recognise_all(field, texts)
