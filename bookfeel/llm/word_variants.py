"""Groups of spelling variants from a dictionary of trie-node pairs.

The distinct words are sorted, forward and reversed, and the nodes of both tries get
integer numbers: a word of length L adds the nodes below its common start with the word
before it. At each of its positions a word lies between a prefix node and a suffix node.
Skipping position i gives the pair of the nodes around it; inserting there gives the
pair that meets between i - 1 and i. Two words with one skipped pair differ by a
replaced code point; a skipped pair equal to another word's inserted one tells a deleted
(or inserted) code point. Equal pairs are all there is to compare, so the neighbours are
exact. A pair has at most one word per code point of the alphabet, which bounds its group.
Of a run of equal code points only the first is skipped towards a shorter word, as
skipping the others gives the same word; so no neighbour is counted twice.

Numbering is by range partition. A task learns how the range before its own ended from
the driver, which holds two words and one path of numbers per range, nothing else.

What is defined: a word is taken once per row of ``counts`` (sum repeated words before);
words may be of any length and script, the empty word included; null words are left out;
an empty table gives no rows; a word without a near one is its own root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed, written
from ..operators.joins import skew_join

ENTRIES = 1 << 16  # numbers of an output batch
MOST = 1 << 20  # code points of the words taken at once
INSERTED, SKIPPED, SKIPPED_FIRST = 0, 1, 2  # kinds of pairs; the last begins a run of equal code points


def _common(a: str, b: str) -> int:
    """Length of the common start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


class Path:
    """Numbers of the nodes along the last word: steps of (depth, number), numbers rising by one between them."""

    def __init__(self, word: str = "", steps=(), last: int = 0):
        self.word, self.steps, self.last = word, list(steps), last

    def move(self, word: str) -> None:
        depth = _common(self.word, word)
        self.steps = cut(self.steps, depth)
        if len(word) > depth:
            self.steps.append((depth + 1, self.last + 1))
            self.last += len(word) - depth
        self.word = word

    def nodes(self) -> np.ndarray:
        """Node of every prefix, the root (0) first."""
        out = np.zeros(len(self.word) + 1, np.int64)
        ends = [depth for depth, _ in self.steps[1:]] + [len(out)]
        for (depth, number), end in zip(self.steps, ends):
            out[depth:end] = np.arange(number, number + end - depth)
        return out


def cut(steps, depth: int) -> list:
    """The part of a path down to ``depth``."""
    return [x for x in steps if x[0] <= depth]


ENDS = "piece long, rows long, nodes long, first string, last string, depths array<long>, numbers array<long>"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How a range begins and ends, with numbers of its own."""
    path, rows, piece, first = Path(), 0, None, None
    for batch in batches:
        if piece is None and batch.num_rows:
            piece, first = batch.column("piece")[0].as_py(), batch.column("key")[0].as_py()
        for word in batch.column("key").to_pylist():
            path.move(word)
        rows += batch.num_rows
    if rows:
        depths, numbers = [list(x) for x in zip(*path.steps)] if path.steps else ([], [])
        values = (piece, rows, path.last, first, path.word, depths, numbers)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(pa.int64())] * 2
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, kinds)], [x.split()[0] for x in ENDS.split(", ")])


def _starts(ends: list) -> dict[int, tuple[int, int, str, list]]:
    """Rows before, last number, last word and its path for the start of each range."""
    out, rows, base, word, steps = {}, 0, 0, "", []
    for e in sorted(ends, key=lambda e: e["piece"]):
        shared = _common(word, e["first"])
        out[e["piece"]] = (rows, base, word, steps)
        own = list(zip(e["depths"], e["numbers"]))
        along = 0  # as far as the last word follows the first
        if own and e["first"] and own[0][1] == 1:
            along = min(own[1][0] - 1 if len(own) > 1 else len(e["last"]), len(e["first"]))
            own = own[1:]
        # Nodes of the first word down to ``shared`` are those of the range before.
        new = cut(steps, min(shared, along))
        if along > shared:
            new.append((shared + 1, base + 1))
        new += [(depth, base + number - shared) for depth, number in own]
        rows, base, word, steps = rows + e["rows"], base + e["nodes"], e["last"], new
    return out


def _numbers(batches: Iterator[pa.RecordBatch], starts: dict, back: bool) -> Iterator[pa.RecordBatch]:
    path, rank = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if path is None:
            rank, base, word, steps = starts[batch.column("piece")[0].as_py()]
            path = Path(word, steps, base)
        nodes, held = [], 0

        def part(at):
            values = np.concatenate(nodes)
            offsets = np.cumsum([0, *map(len, nodes)]).astype(np.int32)
            rows = batch.slice(at - len(nodes), len(nodes))
            ranks = pa.array(np.arange(rank - len(nodes), rank)) if not back else rows.column("rank")
            return pa.RecordBatch.from_arrays(
                [rows.column("key"), rows.column("n"), ranks, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                ["key", "n", "rank", "nodes"])

        for at, word in enumerate(batch.column("key").to_pylist(), 1):
            path.move(word)
            rank += 1
            nodes.append(path.nodes()[::-1] if back else path.nodes())
            held += len(word)
            if held > MOST:
                yield part(at)
                nodes, held = [], 0
        if nodes:
            yield part(batch.num_rows)


def numbered(words: DataFrame, back: bool, pieces: int | None = None) -> DataFrame:
    """``key, n, rank, nodes`` of distinct ``key`` (with ``n``): the trie nodes of all prefixes, shortest
    first; with ``back`` of the reversed keys given, longest first. Ranks count in code point
    order, or are taken from ``rank`` with ``back``."""
    ranged = words.repartitionByRange(pieces, "key") if pieces else words.repartitionByRange("key")
    # The checkpoint fixes the sampled bounds: both passes see the same ranges.
    ranged = checkpointed(ranged.sortWithinPartitions("key").withColumn("piece", F.spark_partition_id().cast("long")))
    starts = _starts(ranged.select("piece", "key").mapInArrow(_ends, ENDS).collect())  # one row a range
    return ranged.mapInArrow(
        lambda batches: _numbers(batches, starts, back), "key string, n long, rank long, nodes array<long>")


PAIRS = "p long, s long, kind int, n long, rank long"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column("before").offsets)).astype(np.int64)
        step = np.cumsum(sizes) // MOST
        edges = np.flatnonzero(np.diff(step, prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            rows = batch.slice(a, b - a)
            size = sizes[a:b]
            before, after = (np.asarray(rows.column(x).flatten()) for x in ("before", "after"))
            word = np.repeat(np.arange(len(size)), size)
            start = np.zeros(len(before), bool)
            start[np.cumsum(size) - size] = True
            end = np.roll(start, -1)
            codes = np.frombuffer("".join(rows.column("key").to_pylist()).encode("utf-32-le"), np.uint32)
            of = word[~end]
            first = np.ones(len(codes), bool)
            first[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
            kind = np.concatenate([np.full(len(before), INSERTED), np.where(first, SKIPPED_FIRST, SKIPPED)]).astype(np.int32)
            word = np.concatenate([word, of])
            columns = [
                np.concatenate([before, before[~end]]), np.concatenate([after, after[~start]]), kind,
                np.asarray(rows.column("n"))[word], np.asarray(rows.column("rank"))[word]]
            for at in range(0, len(word), ENTRIES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at:at + ENTRIES]) for c in columns], [x.split()[0] for x in PAIRS.split(", ")])


def near_words(vocabulary: DataFrame, pieces: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rank, key, n`` of the words, and ``rank, n_near, best`` (``n``, minus rank) of those with near ones."""
    forward = written(numbered(vocabulary, False, pieces), "trie-forward")
    back = numbered(forward.select(F.reverse("key").alias("key"), "n", "rank"), True, pieces)
    both = forward.withColumnRenamed("nodes", "before").join(
        back.select("rank", F.col("nodes").alias("after")), "rank")
    pairs = both.select("key", "n", "rank", "before", "after").mapInArrow(_pairs, PAIRS)
    # At most the alphabet's code points and one word: see the head of the module.
    members = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "rank")).alias("all")).where("size(all) > 1")

    def others(m):
        return F.filter("all", lambda x: (x["rank"] != m["rank"]) & (
            ((m["kind"] > INSERTED) & (x["kind"] > INSERTED))
            | ((m["kind"] == INSERTED) & (x["kind"] == SKIPPED_FIRST))
            | ((m["kind"] == SKIPPED_FIRST) & (x["kind"] == INSERTED))))

    found = members.select(F.explode(F.transform("all", lambda m: F.struct(
        m["rank"].alias("rank"), F.size(others(m)).alias("near"),
        F.array_max(F.transform(others(m), lambda x: F.struct(x["n"].alias("n"), (-x["rank"]).alias("back")))).alias("best"),
    ))).alias("m")).select("m.*")
    near = found.where("near > 0").groupBy("rank").agg(
        F.sum("near").alias("n_near"), F.max("best").alias("best"))
    return forward.select("rank", "key", "n"), written(near, "near-words")


def roots(forms: DataFrame) -> DataFrame:
    """``rank, root`` from ``rank, form``: forms followed to the last, each round twice as far."""
    known = written(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        after = known.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        stepped = written(skew_join(known, after, "root", "left", ["rank"]), "roots")
        known = stepped.select("rank", F.coalesce("next", "root").alias("root"))
        if not stepped.where("next is not null").limit(1).count():
            return known


def variants(counts: DataFrame, ratio: int = 2, pieces: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``counts`` (``word``, ``n``).

    ``form`` is the near word with the largest ``n`` (of equal ones the first by code point), if that is
    at least ``ratio`` times the word's own; ``root`` is where following forms ends."""
    vocabulary = counts.where("word is not null").select(F.col("word").alias("key"), F.col("n").cast("long").alias("n"))
    words, near = near_words(vocabulary, pieces)
    rows = written(words.join(near, "rank", "left").select(
        "rank", F.col("key").alias("word"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.back")).alias("form")), "near-rows")
    ends = roots(rows.where("form is not null").select("rank", "form"))
    rows = written(rows.join(ends, "rank", "left").withColumn("root", F.coalesce("root", "rank")), "rooted-rows")
    forms = rows.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    rows = written(skew_join(rows, forms, "form", "left", ["rank"]), "formed-rows")
    names = rows.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    return skew_join(rows, names, "root", "left", ["rank"]).select(
        "word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
