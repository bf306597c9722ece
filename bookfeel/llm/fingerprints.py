"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text into chunks wherever its low bits are all
zero; ``size`` is the block size, the mean length of a chunk. Each chunk gives one
letter of the signature. A fingerprint is ``size:signature:signature at twice the
size``, where the size is the smallest power of two from 4 on at which at most 64
chunks arise; so it follows from the whole text, without a cap. Two fingerprints are
compared where their block sizes meet, by edit distance (insertions and deletions):
1 minus distance over total length, the better one where both signatures meet. Sizes
more than a factor of two apart give 0.

``with_edits`` also edits each text: its last third is replaced by the first code
points, as many or all, of the next document by descending key; after the last comes
the first. Null texts count as empty; two empty texts are alike (1). Equal keys follow
one another by a hash of the text. Null keys come last. A single document is its own
next. Columns other than key and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from .pieces import slices

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WIDTH = 7  # bytes that the rolling hash sees
LEAST = 2  # block sizes begin at 2**LEAST
CHUNKS = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
LEAF = np.arange(1, 257, dtype=np.uint32) * np.uint32(2654435761)
LEAF ^= LEAF >> np.uint32(15)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_power[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((ODD, INVERSE)):
            _power[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base)]))
    return _power


def rolling(b: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at each place; zeros stand before the text."""
    leaf = LEAF[b]
    out = np.zeros(len(b), np.uint32)
    for k in range(min(WIDTH, len(b))):
        part = leaf[:len(b) - k]  # rotated by its distance, 4 bits a byte
        out[k:] ^= part << np.uint32(4 * k) | part >> np.uint32((32 - 4 * k) % 32)
    out *= np.uint32(2246822519)
    out ^= out >> np.uint32(13)
    return out


def _zero_bits(hashes: np.ndarray, level: int) -> np.ndarray:
    """Whether the lowest ``level`` bits are zero; never for more bits than there are."""
    return (hashes & np.uint32((1 << level) - 1)) == 0 if level < 32 else np.zeros(len(hashes), bool)


def _signature(values: np.ndarray, ends: np.ndarray, n: int) -> bytes:
    """A letter per chunk; ``ends`` are the last bytes of chunks, a rest is a chunk too."""
    starts = np.concatenate([[0], ends + 1])
    starts = starts[starts < n]
    if not len(starts):
        return b""
    up, down = _powers(n)
    sums = np.add.reduceat(values * up[:n], starts) * down[starts]
    sums ^= sums >> np.uint64(29)
    return LETTERS[(sums * ODD) >> np.uint64(58)].tobytes()


def fingerprint(data: bytes) -> str:
    b = np.frombuffer(data, np.uint8)
    n, level = len(b), LEAST
    hashes = rolling(b)
    cuts = np.flatnonzero(_zero_bits(hashes, level))
    while len(cuts) + (n > 0 and (not len(cuts) or cuts[-1] != n - 1)) > CHUNKS:
        level += 1
        cuts = cuts[_zero_bits(hashes[cuts], level)]
    twice = cuts[_zero_bits(hashes[cuts], level + 1)]
    values = LEAF[b].astype(np.uint64)
    return f"{1 << level}:{_signature(values, cuts, n).decode()}:{_signature(values, twice, n).decode()}"


def _common(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, of at most 64 letters each:
    one bit per letter of the first, all pairs at once."""
    out = np.zeros(len(pairs), np.int64)
    step = 2048
    for part in range(0, len(pairs), step):
        group = pairs[part:part + step]
        a = np.zeros((len(group), CHUNKS), np.uint8)
        b = np.zeros((len(group), CHUNKS), np.uint8)
        for row, (x, y) in enumerate(group):
            a[row, :len(x)] = np.frombuffer(x.encode(), np.uint8)
            b[row, :len(y)] = np.frombuffer(y.encode(), np.uint8)
        where, rows = np.zeros((len(group), 128), np.uint64), np.arange(len(group))
        for k in range(CHUNKS):
            where[rows, a[:, k]] |= np.uint64(1) << np.uint64(k)
        where[:, 0] = 0
        state = np.full(len(group), 2**64 - 1, np.uint64)
        for k in range(CHUNKS):
            match = where[rows, b[:, k]]
            step_ = state & match
            state = np.where(b[:, k] > 0, (state + step_) | (state - step_), state)
        out[part:part + step] = np.bitwise_count(~state)
    return out


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Likeness of fingerprints, 0 to 1."""
    asked, owner = [], []
    out = np.zeros(len(pairs))
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (n, x1, x2), (m, y1, y2) = x.split(":"), y.split(":")
        n, m = int(n), int(m)
        meets = [(x1, y1), (x2, y2)] if n == m else [(x2, y1)] if 2 * n == m else [(x1, y2)] if n == 2 * m else []
        asked += meets
        owner += [i] * len(meets)
    if asked:
        total = np.array([len(x) + len(y) for x, y in asked])
        np.maximum.at(out, owner, np.where(total > 0, 2 * _common(asked) / np.maximum(total, 1), 1.0))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(
                [fingerprint((x or "").encode()) for x in batch.column("_text").to_pylist()], pa.string())],
                names=["_key", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")) \
        .mapInArrow(run, f"_key {kind}, fingerprint string").withColumnRenamed("_key", key)


def _compared(keys: pa.Array, texts: list[str], prints: list[str], nexts: list[str], next_prints: list[str]) -> pa.RecordBatch:
    edited = []
    for own, other in zip(texts, nexts):
        third = len(own) // 3
        edited.append((own[:len(own) - third] + other[:third]).encode())
    edited_prints = [fingerprint(x) for x in edited]
    return pa.RecordBatch.from_arrays([
        keys, pa.array([len(x) for x in texts], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(prints, pa.string()), pa.array(edited_prints, pa.string()),
        pa.array(likeness(list(zip(prints, edited_prints)))), pa.array(likeness(list(zip(prints, next_prints)))),
    ], names=COLUMNS)


COLUMNS = ["_key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its fingerprint, that of the edited text, and how alike they and the next
    document's are.

    Texts are shuffled once, into ranges by descending key. In a range each row meets the
    next; the last row of a range meets the first of the next range in a small join.
    """
    kind = docs.schema[key].dataType.simpleString()
    ranged = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")) \
        .withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("_key").desc_nulls_last(), F.col("_tie")]
    ranged = ranged.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = TaskContext.get().partitionId(), None  # the row that waits for its next

        def seam(at: int, row: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                row[0], *(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())),
                pa.array([piece], pa.int32()), pa.array([at], pa.int32()), pa.array([row[1]], pa.string())],
                names=[*COLUMNS, "_piece", "_end", "_text"])

        for batch in slices(batches, "_text"):
            keys, texts = batch.column("_key"), batch.column("_text").to_pylist()
            prints = [fingerprint(x.encode()) for x in texts]
            if held is None:
                yield seam(0, (keys.slice(0, 1), texts[0]))
            else:
                keys, texts, prints = pa.concat_arrays([held[0], keys]), [held[1], *texts], [held[2], *prints]
            held = keys.slice(len(keys) - 1), texts[-1], prints[-1]
            done = _compared(keys.slice(0, len(keys) - 1), texts[:-1], prints[:-1], texts[1:], prints[1:])
            n = done.num_rows
            yield pa.RecordBatch.from_arrays(
                [*done.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())],
                names=[*COLUMNS, "_piece", "_end", "_text"])
        if held is not None:
            yield seam(1, held)

    found = written(ranged.mapInArrow(run, f"_key {kind}, {RESULT}, _piece int, _end int, _text string"), "fingerprints")
    seams = found.where("_piece IS NOT NULL")
    ends = seams.where("_end = 1").select("_piece", "_key", "_text")  # two rows per range
    heads = seams.where("_end = 0").select(F.col("_piece").alias("_follows"), F.col("_text").alias("_next"))
    chain = ends.select("_piece").withColumn("_after", F.lead("_piece").over(Window.orderBy("_piece")))
    first = heads.agg(F.min("_follows")).scalar()
    chain = chain.select("_piece", F.coalesce("_after", first).alias("_follows"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nexts = batch.column("_text").to_pylist(), batch.column("_next").to_pylist()
            yield _compared(batch.column("_key"), texts, [fingerprint(x.encode()) for x in texts],
                            nexts, [fingerprint(x.encode()) for x in nexts])

    closed = ends.join(chain, "_piece").join(heads, "_follows").select("_key", "_text", "_next") \
        .mapInArrow(close, f"_key {kind}, {RESULT}")
    return found.where("_piece IS NULL").select(*COLUMNS).union(closed).withColumnRenamed("_key", key)
