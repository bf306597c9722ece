"""Word vectors learnt from the texts at hand, and labels scored by them.

Words that stand within ``window`` of one another are counted in pairs; positive
pointwise mutual information (contexts smoothed by the power 0.75) makes a sparse matrix,
and its largest singular vectors, found by a randomised projection and a few power
rounds, make the vectors. The matrix stays a table: each product with it is one pass that
multiplies in the tasks. What the driver and the tasks hold of it is a dense matrix of
``vocabulary`` by ``dims`` numbers, bounded by these two parameters; words beyond the
most frequent ``vocabulary`` ones have no vector.

A text, or a label put into its task's template, is the mean of its words' vectors, rare
words weighing more. Labels are taken relative to their bare template, texts relative to
the mean text, and are scored by cosine: several labels by a logistic curve each, one
label by a softmax over all. A label without known words has cosine 0; a text without
known words scores every label alike, and so does a null text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text as tx

VOCABULARY, DIMS, WINDOW, LEAST = 20_000, 64, 5, 5
SMOOTH = 0.75
EXTRA, POWER = 8, 3  # more directions than asked for, and rounds that sharpen them
RARE = 1e-3  # a word as frequent as this weighs half
SHARPNESS = 0.1  # of cosines in scores
CODES = 1 << 20  # pairs counted at once


def _tokens(df: DataFrame, text: str) -> Column:
    """The words of a text column; a column of words as it is."""
    if df.schema[text].dataType.simpleString() == "array<string>":
        return F.col(text)
    return tx.tokens(F.coalesce(F.col(text), F.lit("")))


def vocabulary(df: DataFrame, text: str, most: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """``word, n``: the most frequent words of at least ``least`` occurrences, at most ``most`` of them."""
    words = df.select(F.explode(_tokens(df, text)).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "word").limit(most)


def pairs(df: DataFrame, text: str, words: list[str], window: int = WINDOW) -> DataFrame:
    """``a, b, n``: how often word ``b`` follows word ``a`` within ``window`` words of one text; words by
    their place in ``words``, other words in between count as places."""
    size, known = len(words), pa.array(words, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def counted():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            place = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1)).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            for low in range(0, len(place), CODES // window):  # a piece and what follows it within the window
                p, r = place[low:low + CODES // window + window], row[low:low + CODES // window + window]
                own = min(len(p), CODES // window)
                for step in range(1, window + 1):
                    a, b = p[:own][:len(p) - step], p[step:step + own]
                    use = (a >= 0) & (b >= 0) & (r[:own][:len(p) - step] == r[step:step + own])
                    held.append(a[use] * size + b[use])
                    total += len(held[-1])
                if total >= CODES:
                    yield counted()
                    held, total = [], 0
        if total:
            yield counted()

    found = df.select(_tokens(df, text).alias("words")).mapInArrow(run, "a int, b int, n bigint")
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def information(counts: DataFrame, size: int) -> DataFrame:
    """``a, b, value``: the positive entries of the smoothed mutual information of pairs in both orders."""
    both = written(counts.unionByName(counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
                   .groupBy("a", "b").agg(F.sum("n").alias("n")), "word-pairs")
    sums = np.zeros(size)
    for r in both.groupBy("a").agg(F.sum("n").alias("n")).collect():  # a row per word of the vocabulary
        sums[r["a"]] = r["n"]
    total, smooth = sums.sum(), sums**SMOOTH
    spark = both.sparkSession
    marks = spark.createDataFrame(
        [(i, float(s), float(c)) for i, (s, c) in enumerate(zip(sums, smooth / max(smooth.sum(), 1e-300))) if s],
        "w int, s double, c double")
    value = F.log(F.col("n") / (F.col("s") * F.col("c")))  # log(P(a, b) / (P(a) * P'(b))); the total cancels
    rows = both.join(F.broadcast(marks.select(F.col("w").alias("a"), "s")), "a") \
        .join(F.broadcast(marks.select(F.col("w").alias("b"), "c")), "b")
    return rows.select("a", "b", value.alias("value")).where("value > 0") if total else rows.select("a", "b", F.lit(0.0).alias("value"))


def product(matrix: DataFrame, dense: np.ndarray, turned: bool = False) -> np.ndarray:
    """The sparse ``matrix`` (or its transpose) times ``dense``, both of as many rows as the vocabulary."""
    size, dims = dense.shape
    row, col = ("b", "a") if turned else ("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, dims))
        seen = np.zeros(size, bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(low, 1 << 14)
                i, j = np.asarray(part.column(row)), np.asarray(part.column(col))
                order = np.argsort(i, kind="stable")
                i, values = i[order], (dense[j] * np.asarray(part.column("value"))[:, None])[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                out[i[first]] += np.add.reduceat(values, first, axis=0)
                seen[i] = True
        at = np.flatnonzero(seen)
        for low in range(0, len(at), 1024):
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[low:low + 1024].astype(np.int32)), pa.array(list(out[at[low:low + 1024]]), pa.list_(pa.float64()))],
                ["i", "sums"])

    total = np.zeros((size, dims))
    # Dealt by row when stored, so that a task sees few rows: together about as many as the vocabulary has.
    found = matrix.mapInArrow(run, "i int, sums array<double>").toArrow()
    if len(found):
        at, sums = found["i"].to_numpy(), found["sums"].combine_chunks().flatten().to_numpy().reshape(len(found), -1)
        np.add.at(total, at, sums)
    return total


def singular(matrix: DataFrame, turned: DataFrame, size: int, dims: int, seed: int = 0) -> np.ndarray:
    """Left singular vectors times the root of their values; ``turned`` is the table sorted by column."""
    dims = min(dims, size)
    draw = np.random.default_rng(seed)
    found, _ = np.linalg.qr(product(matrix, draw.normal(size=(size, min(size, dims + EXTRA)))))
    for _ in range(POWER):
        back, _ = np.linalg.qr(product(turned, found, True))
        found, _ = np.linalg.qr(product(matrix, back))
    right, values, left = np.linalg.svd(product(turned, found, True), full_matrices=False)  # the transpose of found' * matrix
    vectors = (found @ left.T)[:, :dims] * np.sqrt(values[:dims])
    return vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)  # signs settled


@dataclass
class WordVectors:
    words: list[str]
    counts: np.ndarray
    vectors: np.ndarray
    centre: np.ndarray  # the mean text

    def params(self) -> dict:
        return {"words": self.words, "counts": self.counts.tolist(), "dims": self.vectors.shape[1],
                "vectors": base64.b64encode(self.vectors.astype("<f8").tobytes()).decode(), "centre": self.centre.tolist()}

    @classmethod
    def of(cls, params: dict) -> WordVectors:
        vectors = np.frombuffer(base64.b64decode(params["vectors"]), "<f8").reshape(-1, params["dims"])
        return cls(params["words"], np.array(params["counts"]), vectors, np.array(params["centre"]))

    def means(self, lists: pa.ListArray) -> np.ndarray:
        """The vector of each list of words; zero without known ones."""
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        place = pc.index_in(lists.flatten(), value_set=pa.array(self.words, pa.string()))
        known = np.asarray(pc.is_valid(place))
        place = np.asarray(pc.fill_null(place, 0))
        share = self.counts / max(self.counts.sum(), 1)
        weight = (RARE / (RARE + share))[place] * known if len(self.words) else np.zeros(len(place))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out = np.zeros((len(sizes), self.vectors.shape[1]))
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(sizes) if len(self.words) else []:
            for low in range(ends[i] - sizes[i], ends[i], 1 << 16):
                at = slice(low, min(low + (1 << 16), ends[i]))
                out[i] += weight[at] @ self.vectors[place[at]]
        return out / np.maximum(np.bincount(row, weight, len(sizes)), 1e-300)[:, None]

    def labels(self, labels: list[str], template: str) -> np.ndarray:
        """What each label adds to its template (or, in a template without known words, to the
        mean text), at unit length; zero for a label without known words."""
        import regex

        def of(texts):
            split = [[w for w in regex.split(r"[^\p{L}]+", t.lower()) if w] for t in texts]
            return unit(self.means(pa.array(split, pa.list_(pa.string()))))

        bare = of([template.format("")])
        base = bare if bare.any() else self.centre
        return np.where(of(labels).any(1)[:, None], unit(of([template.format(x) for x in labels]) - base), 0.0)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1))[:, None]
    return np.where(length > 1e-12, rows / np.maximum(length, 1e-12), 0.0)


def fit(df: DataFrame, text: str, most: int = VOCABULARY, dims: int = DIMS, window: int = WINDOW, least: int = LEAST,
        seed: int = 0) -> WordVectors:
    """Vectors of the words of all texts, which are cut into words once."""
    df, text = written(df.select(_tokens(df, text).alias("words")), "words"), "words"
    rows = vocabulary(df, text, most, least).collect()  # at most ``most`` rows
    words, counts = [r["word"] for r in rows], np.array([r["n"] for r in rows], dtype=np.float64)
    if not words:
        return WordVectors([], counts, np.zeros((0, dims)), np.zeros(dims))
    matrix = information(pairs(df, text, words, window), len(words))
    by_row = written(matrix.repartitionByRange("a"), "information")
    by_column = written(by_row.repartitionByRange("b"), "information-turned")
    vectors = singular(by_row, by_column, len(words), dims, seed)
    model = WordVectors(words, counts, vectors, np.zeros(vectors.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(vectors.shape[1]), 0
        for batch in batches:
            found = unit(model.means(batch.column(0)))
            total, n = total + found.sum(0), n + len(found)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], ["sums", "n"])

    parts = df.mapInArrow(run, "sums array<double>, n bigint").collect()  # a row per task
    model.centre = np.sum([r["sums"] for r in parts], axis=0) / max(1, sum(r["n"] for r in parts))
    return model


@dataclass
class Task:
    """Labels, the template they are put into, and whether several can hold."""

    labels: list[str]
    template: str
    multi: bool


def cosines(model: WordVectors, found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of texts, given by their means, to the labels."""
    known = (found * found).sum(1) > 0
    return np.where(known[:, None], unit(unit(found) - model.centre), 0.0) @ labels.T


def scores_of(cosine: np.ndarray, multi: bool) -> np.ndarray:
    if multi:
        return 1 / (1 + np.exp(-cosine / SHARPNESS))
    power = np.exp((cosine - cosine.max(1)[:, None]) / SHARPNESS)
    return power / power.sum(1)[:, None]


def score_tasks(df: DataFrame, keys: list[str], text: Column, model: WordVectors, tasks: dict[str, Task]) -> DataFrame:
    """``keys`` and one column of falling (label, score) entries per task, each text read once."""
    labels = {name: model.labels(t.labels, t.template) for name, t in tasks.items()}
    entry = pa.struct([("label", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = model.means(batch.column(batch.num_columns - 1))  # for all tasks
            columns = list(batch.columns[:-1])
            for name, task in tasks.items():
                score = np.round(scores_of(cosines(model, means, labels[name]), task.multi), 12)  # rounding noise settles no tie
                names = np.array(task.labels, dtype=object)
                rank = np.argsort(np.argsort(names.astype(str)))
                order = np.lexsort((np.broadcast_to(rank, score.shape), -score), axis=1)
                flat = pa.StructArray.from_arrays(
                    [pa.array(names[order].ravel(), pa.string()), pa.array(np.take_along_axis(score, order, 1).ravel())], fields=list(entry))
                columns.append(pa.ListArray.from_arrays(
                    pa.array(np.arange(0, score.size + 1, len(names), dtype=np.int32)), flat))
            yield pa.RecordBatch.from_arrays(columns, [*keys, *tasks])

    rows = df.select(*keys, tx.tokens(F.coalesce(text, F.lit(""))).alias("_words"))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys),
                        *(f"`{t}` array<struct<label: string, score: double>>" for t in tasks)])
    return rows.mapInArrow(run, schema)
