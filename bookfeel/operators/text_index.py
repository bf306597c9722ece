"""``LIKE '%text%'`` by an inverted index of trigrams.

Postings list the keys of every three neighbouring characters (lower case) by blocks of at
most ``PART`` texts, stored in the order of the trigrams; the texts are stored in the order
of their keys. A question reads the postings of its rarest trigrams, the keys that have
all of them are looked up, and ``LIKE`` verifies each text. A pattern without three
characters in a row (wildcards cut it) is answered by a scan of the texts; ``plan`` says
which way a pattern takes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import written
from ..sources import tables
from .search import contains

PART = 4096  # keys of one posting row
CHARS = 8 << 20  # characters after which a block ends, too
ASKED = 4  # trigrams that a question reads


def _codes(text: str) -> np.ndarray:
    """The different trigrams of a text as numbers, 21 bits a character, ascending."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _spelled(codes: np.ndarray) -> list[str]:
    whole = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i:i + 3] for i in range(0, len(whole), 3)]


def _postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``gram, keys`` of each block of texts, made where the texts are read: only lists move on."""
    part, kind = PART, texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1).to_pylist()
            low = 0
            while low < len(rows):
                found, chars, at = [], 0, low
                while at < len(rows) and at - low < part and chars < CHARS:
                    found.append(_codes(rows[at]))
                    chars, at = chars + len(rows[at]), at + 1
                code, row = np.concatenate(found), np.repeat(np.arange(low, at), [len(f) for f in found])
                low, order = at, np.argsort(code, kind="stable")
                code = code[order]
                first = np.flatnonzero(np.diff(code, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), keys.take(pa.array(row[order])))
                yield pa.RecordBatch.from_arrays([pa.array(_spelled(code[first]), pa.string()), lists], ["gram", "keys"])

    return texts.where(F.length(text) > 2).where(F.col(key).isNotNull()).select(key, F.lower(text)).mapInArrow(
        run, f"gram string, keys array<{kind}>")


def pattern_trigrams(text: str) -> list[str]:
    """Trigrams that every text with the pattern holds: those of its pieces between wildcards."""
    pieces = re.split("[%_]", text.lower())
    return sorted({p[i:i + 3] for p in pieces for i in range(len(p) - 2)})


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, key: str, text: str):
        self.spark, self.path, self.key, self.text = spark, path, key, text

    def _table(self, name: str) -> DataFrame:
        return tables.read(self.spark, f"{self.path}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._table("texts")

    def plan(self, text: str) -> list[str]:
        """The trigrams whose postings a pattern reads: its rarest; none means a scan."""
        grams = pattern_trigrams(text)
        if not grams:
            return []
        found = {r["gram"]: r["n"] for r in self._table("counts").filter(F.col("gram").isin(grams)).collect()}
        return sorted(grams, key=lambda g: (found.get(g, 0), g))[:ASKED]

    def candidates(self, grams: list[str]) -> DataFrame:
        """Keys of the rows that hold all of ``grams``."""
        rows = self._table("postings").filter(F.col("gram").isin(grams)).select("gram", F.explode("keys").alias(self.key))
        return rows.groupBy(self.key).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams)).select(self.key)

    def search(self, text: str) -> DataFrame:
        """Stored rows whose text contains ``text``, as ``LIKE`` has it."""
        grams = self.plan(text)
        rows = self.texts
        if grams:
            rows = tables.look_up(rows, self.key, written(self.candidates(grams), "candidates"))
        return rows.filter(contains(F.col(self.text), text))


def build(df: DataFrame, path: str, key: str, text: str, keep: list[str] | None = None) -> TextIndex:
    """An index of ``df`` under ``path``: ``key`` (distinct), ``text`` and the columns ``keep``. A null text has
    no trigrams and matches nothing."""
    texts = tables.write_keyed(df.select(key, text, *[c for c in keep or [] if c not in (key, text)]), f"{path}/texts", key)
    postings = tables.write_keyed(written(_postings(texts, key, text), "postings"), f"{path}/postings", "gram")
    tables.write_keyed(postings.groupBy("gram").agg(F.sum(F.size("keys")).cast("long").alias("n")), f"{path}/counts", "gram")
    return TextIndex(df.sparkSession, path, key, text)
