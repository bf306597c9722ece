"""Byte-level BPE by merge ranks: encoding in numpy matrices, and decoding.

``encode_documents`` splits every text by the pattern, encodes each match by the
ranks and decodes the ids again. Matches not seen before by a task are put, by
length, into padded matrices. Each round merges in every row the leftmost pair of
least rank; ranks of pairs come from a hash table, finished rows leave the matrix.

Null text counts as empty and gives no ids. Special tokens are ordinary text.
Repeated rows give repeated results, an empty table an empty one. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import CachedEncoder, MatchMemory, per_worker, slices

NONE = np.int32(2**31 - 1)
MOST_ROWS = 1 << 22  # cells of one matrix


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class PairTable:
    """Rank of the joined token for each pair of tokens, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, 2**64 - 1, np.uint64)
        self.values = np.full(size, NONE, np.int32)
        self.probes, slot, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == 2**64 - 1
            _, first = np.unique(slot[left][free], return_index=True)
            put = left[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it isn't a token; -1 is padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys).ravel() & (self.keys[slot] != 2**64 - 1).ravel())
        flat, keys, slot = found.ravel(), keys.ravel(), slot.ravel()
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            flat[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != 2**64 - 1)]
        found = flat.reshape(found.shape)
        found[(left < 0) | (right < 0)] = NONE
        return found


class Bpe:
    """Merges of one vocabulary. Rows of over ``long`` bytes merge on their own."""

    def __init__(self, ranks: dict[bytes, int], long: int = 256):
        self.ranks, self.long = ranks, long
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairTable(ranks)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def merge_rows(self, rows: list[bytes]) -> list[bytes]:
        """Ids of each row, as bytes. All rows of one length bucket merge together."""
        out = [b""] * len(rows)
        lengths = np.array([len(x) for x in rows], np.int64)
        for i in np.flatnonzero(lengths > self.long):
            out[i] = self.merge_long(rows[i]).astype("<u4").tobytes()
        width = 1
        while width <= self.long:
            members = np.flatnonzero((lengths > width // 2) & (lengths <= width) & (lengths <= self.long))
            step = max(1, MOST_ROWS // width)
            for at in range(0, len(members), step):
                self._merge_matrix(rows, lengths, members[at:at + step], width, out)
            width *= 2
        return out

    def _merge_matrix(self, rows, lengths, members, width, out) -> None:
        count = lengths[members]
        inside = np.arange(width) < count[:, None]
        ids = np.full((len(members), width), -1, np.int32)
        ids[inside] = self.byte[np.frombuffer(b"".join(rows[i] for i in members), np.uint8)]
        pad = np.full((len(members), 1), -1, np.int32)
        ranks = self.pairs.rank(ids, np.hstack([ids[:, 1:], pad]))
        while len(members):
            at = ranks.argmin(axis=1)  # the first, so the leftmost
            best = ranks[np.arange(len(members)), at]
            live = best != NONE
            done = np.flatnonzero(~live)
            flat = ids[done][np.arange(ids.shape[1]) < count[done, None]].astype("<u4").tobytes()
            ends = 4 * np.cumsum(count[done])
            for i, a, b in zip(members[done].tolist(), (ends - 4 * count[done]).tolist(), ends.tolist()):
                out[i] = flat[a:b]
            if not live.any():
                return
            ids, ranks, at, best = ids[live], ranks[live], at[live], best[live]
            members, count = members[live], count[live] - 1
            row, column = np.arange(len(members)), np.arange(ids.shape[1] - 1)
            source = column + (column > at[:, None])
            ids[row, at] = best
            ids = np.take_along_axis(ids, source, axis=1)  # drops the right half of the pair
            ranks = np.take_along_axis(ranks, source, axis=1)
            after = np.where(at + 1 < count, ids[row, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            ranks[row, at] = self.pairs.rank(best, after)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pairs.rank(ids[has, at[has] - 1], best[has])
            widest = max(1, int(count.max()))
            ids, ranks = ids[:, :widest], ranks[:, :widest]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long match. A round merges every occurrence of the least rank from the
        left, up to the first whose merge makes a pair of lower rank; this gives what
        one merge at a time gives."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        while len(ids) > 1:
            rank = self.pairs.rank(ids[:-1], ids[1:])
            least = rank.min()
            if least == NONE:
                break
            at = np.flatnonzero(rank == least)
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            in_run = np.arange(len(at)) - np.repeat(begins, np.diff([*begins, len(at)]))
            at = at[in_run % 2 == 0]
            merged = np.full(len(at), least, np.int32)
            left = np.where(at > 0, ids[at - 1], -1).astype(np.int32)
            left[np.flatnonzero(np.diff(at, prepend=-9) == 2)] = least
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1).astype(np.int32)
            lower = np.flatnonzero(
                (self.pairs.rank(left, merged) < least) | (self.pairs.rank(merged, right) < least)
            )
            if len(lower):
                at = at[:lower[0] + 1]
            ids = ids.copy()
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids = ids[keep]
        return ids

    def encode(self, matches: list[str]) -> list[bytes]:
        """Ids of each match, as bytes."""
        raw = [x.encode() for x in matches]
        whole = list(map(self.ranks.get, raw))  # a match that is a token stays whole
        rest = [i for i, x in enumerate(whole) if x is None]
        out = [b"" if x is None else x.to_bytes(4, "little") for x in whole]
        for i, ids in zip(rest, self.merge_rows([raw[i] for i in rest])):
            out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


def _encoder(ranks: bytes, pattern: str) -> tuple[Bpe, CachedEncoder]:
    bpe = Bpe(read_ranks(ranks))
    memory = MatchMemory(pattern, bpe.encode)
    return bpe, CachedEncoder(memory.parts, memory.whole)


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id",
                     text: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and what
    ``keep`` names: ``ids`` (binary, little-endian unsigned 32-bit integers) and
    ``decoded`` (binary, the text that the ids give back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = per_worker(("ranks", ranks, pattern), lambda: _encoder(ranks, pattern))
        for batch in slices(batches, "_text"):
            ids = encoder.encode(batch.column("_text").to_pylist())
            columns = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                       "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())}
            decoded, digests = [], []
            for x in ids:
                back = bpe.decode(np.frombuffer(x, "<u4"))
                digests.append(hashlib.sha256(back).hexdigest())
                if "decoded" in keep:
                    decoded.append(back)
            columns["decoded_sha256"] = pa.array(digests, pa.string())
            columns |= {"ids": pa.array(ids, pa.binary())} if "ids" in keep else {}
            columns |= {"decoded": pa.array(decoded, pa.binary())} if "decoded" in keep else {}
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *(columns[x] for x in names)], names=["_key", *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *keep]
    kinds = {"n_tokens": "bigint", "ids": "binary", "decoded": "binary"}
    kind = docs.schema[key].dataType.simpleString()
    schema = ", ".join([f"_key {kind}", *(f"{x} {kinds.get(x, 'string')}" for x in names)])
    return docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    ).mapInArrow(run, schema).withColumnRenamed("_key", key)
