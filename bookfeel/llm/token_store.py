"""Token ids in canonical length-limited Huffman code, in blocks that stand alone.

A store is a folder of three tables. ``codebook`` gives the code length of each id
(codes follow from the lengths), fitted to the counts of the whole corpus.
``blocks`` holds whole documents in key order: ``part`` and ``block`` order them,
``start`` counts the ids before it in its part, ``payload`` is the bit string and
``checkpoints`` the bit offset of every 256th id. ``index`` gives the ids before each
part. A block is decoded on its own, all its checkpoints side by side by table.

Null text counts as empty; a document then has its end id only. Null keys come
first; rows with equal keys follow one another in the order of a hash of their ids.
An empty table gives an empty store. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import written
from .pieces import per_worker, slices
from .text_ids import of_json

STEP = 256  # ids between checkpoints
BLOCK = 1 << 18  # ids after which a block ends with its document
TEXTS = 8 << 20  # bytes of texts encoded at once


def binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Values after one another as a binary column of ``sizes`` values each."""
    edges = (np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))])


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Code lengths of at most ``limit`` bits of least total, by package-merge; 0: unused."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = weights = counts[order].astype(np.int64)
    is_leaf = [np.ones(len(order), bool)]
    for _ in range(limit - 1):
        pairs = len(weights) // 2 * 2
        merged = np.concatenate([leaves, weights[0:pairs:2] + weights[1:pairs:2]])
        by_weight = np.argsort(merged, kind="stable")
        weights = merged[by_weight]
        is_leaf.append(by_weight < len(order))
    take = 2 * len(order) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Codebook:
    """Canonical codes: by length, then id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        spans = 1 << (self.width - self.lengths[order])
        begins = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.int64)
        self.codes[order] = begins >> (self.width - self.lengths[order])
        # Id and length for each window of ``width`` bits.
        self.table = np.zeros(1 << self.width, np.int64)
        self.table[:spans.sum()] = np.repeat(order << 5 | self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bit string, and the bit offset of every ``STEP``-th id."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        begins = ends - bits
        size = (int(ends[-1]) + 7) // 8 if len(ids) else 0
        value, at = self.codes[ids] << (32 - (begins & 7) - bits), begins >> 3
        out = np.zeros(size + 4, np.float64)
        for k in range(4 if self.width > 17 else 3):  # bytes that a code can touch
            out[k:size + k] += np.bincount(at, value >> (24 - 8 * k) & 255, minlength=size)[:size]
        return out[:size].astype(np.uint8).tobytes(), begins[::STEP].astype("<u4")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        b = np.zeros(len(payload) + STEP * 4 + 8, np.uint32)
        b[:len(payload)] = np.frombuffer(payload, np.uint8)
        word = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at, down = checkpoints.astype(np.int64), np.uint32(32 - self.width)
        out = np.empty((STEP, len(at)), np.int64)
        for t in range(min(STEP, n)):
            found = self.table[word[at >> 3] << (at & 7).astype(np.uint32) >> down]
            out[t] = found >> 5
            at += found & 31
        return out.T.ravel()[:n]


def write_store(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 0, key: str = "doc_id",
                text: str = "text", limit: int = 16) -> None:
    """Encode every text and write the store at ``path``, documents in order of ``key``.

    Encoded ids are written once; the counts come with them, one sparse list per
    task. What the driver holds is bounded by the vocabulary and the part count.
    """
    import json

    spark = docs.sparkSession
    vocab = json.loads(tokenizer)
    size = 1 + max([*vocab["model"]["vocab"].values(), *(x["id"] for x in vocab.get("added_tokens", []))])
    kind = "<u2" if size <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("library", tokenizer), lambda: of_json(tokenizer))
        counts, keys = np.zeros(size, np.int64), None
        for batch in slices(batches, "_text", TEXTS):
            flat, n = encoder.encode(batch.column("_text"))
            if end_id is not None:
                n = n + 1
                own = np.ones(int(n.sum()), bool)
                own[np.cumsum(n) - 1] = False
                ended = np.full(len(own), end_id, np.uint32)
                ended[own] = flat
                flat = ended
            counts += np.bincount(flat, minlength=size)
            keys = batch.column("_key")
            yield pa.RecordBatch.from_arrays([
                keys, binary(flat.astype(kind), n), pa.nulls(len(n), pa.list_(pa.int32())), pa.nulls(len(n), pa.list_(pa.int64())),
            ], names=["_key", "ids", "counted", "counts"])
        if keys is not None:
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, keys.type), pa.nulls(1, pa.binary()),
                pa.array([used.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([counts[used]], pa.list_(pa.int64())),
            ], names=["_key", "ids", "counted", "counts"])

    key_kind = docs.schema[key].dataType.simpleString()
    encoded = written(docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    ).mapInArrow(encode, f"_key {key_kind}, ids binary, counted array<int>, counts array<bigint>"), "token-ids")

    totals = (
        encoded.where("counted IS NOT NULL").select(F.explode(F.arrays_zip("counted", "counts")).alias("x"))
        .groupBy("x.counted").agg(F.sum("x.counts").alias("n")).collect()  # one row per used id at most
    )
    counts = np.zeros(size, np.int64)
    for row in totals:
        counts[row[0]] = row[1]
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(
        [(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()], "id int, length int"
    ).coalesce(1).write.parquet(f"{path}/codebook")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part, start, number = Codebook(lengths), TaskContext.get().partitionId(), 0, 0
        keys, tokens, ids, held = [], [], [], 0  # of the block in hand

        def block() -> pa.RecordBatch:
            payload, checkpoints = book.encode(np.concatenate(ids))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                pa.ListArray.from_arrays([0, sum(map(len, keys))], pa.concat_arrays(keys)),
                pa.array([np.concatenate(tokens)], pa.list_(pa.int64())),
                pa.array([payload], pa.binary()), pa.array([checkpoints.tobytes()], pa.binary()),
            ], names=BLOCK_COLUMNS)

        for batch in batches:
            column = batch.column("ids")
            edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
            flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]].view(kind)
            edges = (edges - edges[0]) // int(kind[2:])
            at = 0
            while at < len(column):  # up to the document that fills the block
                to = min(len(column), int(np.searchsorted(edges, edges[at] + BLOCK - held)))
                to = max(to, at + 1)
                keys.append(batch.column("_key").slice(at, to - at))
                tokens.append(np.diff(edges[at:to + 1]))
                ids.append(flat[edges[at]:edges[to]].astype(np.int64))
                held += int(edges[to] - edges[at])
                at = to
                if held >= BLOCK:
                    yield block()
                    number, start, keys, tokens, ids, held = number + 1, start + held, [], [], [], 0
        if keys:
            yield block()

    (
        encoded.where("ids IS NOT NULL").select("_key", "ids", F.xxhash64("ids").alias("_tie"))
        .repartitionByRange("_key", "_tie").sortWithinPartitions("_key", "_tie").select("_key", "ids")
        .mapInArrow(pack, f"part int, block int, start bigint, keys array<{key_kind}>, tokens array<bigint>, "
                          "payload binary, checkpoints binary")
        .write.parquet(f"{path}/blocks")
    )
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(
        F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")).coalesce(1) \
        .write.parquet(f"{path}/index")


BLOCK_COLUMNS = ["part", "block", "start", "keys", "tokens", "payload", "checkpoints"]


def read_store(spark: SparkSession, path: str, key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """Per document, decoded from the store: ``key``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit
    integers) and, if asked for, ``ids`` in that form."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # bounded by the vocabulary
    lengths = np.zeros(1 + max((r["id"] for r in book), default=0), np.uint8)
    for row in book:
        lengths[row["id"]] = row["length"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codebook(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, tokens = (batch.column(c)[i].values for c in ("keys", "tokens"))
                tokens = tokens.to_numpy(zero_copy_only=False)
                ids = table.decode(batch.column("payload")[i].as_py(),
                                   np.frombuffer(batch.column("checkpoints")[i].as_py(), "<u4"),
                                   int(tokens.sum())).astype("<u4")
                ends = np.cumsum(tokens)
                crcs = [zlib.crc32(ids[b - n:b]) for b, n in zip(ends.tolist(), tokens.tolist())]
                columns = [keys, pa.array(batch.column("start")[i].as_py() + ends - tokens, pa.int64()),
                           pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64())]
                columns += [binary(ids, tokens)] if keep_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["_key", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids]
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # The index has one row per part, so as many as the write had tasks.
    placed = blocks.join(F.broadcast(spark.read.parquet(f"{path}/index")), "part").select(
        (F.col("start") + F.col("part_start")).alias("start"), "keys", "tokens", "payload", "checkpoints")
    return placed.mapInArrow(
        unpack, f"_key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * keep_ids
    ).withColumnRenamed("_key", key)
