"""Encoding texts piece by piece, with the pieces already seen kept per task.

Byte-level tokenizers split a text before merging, and no split-off match spans
from a non-space character into the white space after it. A text can therefore be
cut at every single space and the parts encoded on their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

Encode = Callable[[list[str]], list[bytes]]
GROUP = 1024  # texts cut at once; bounds the parts held


class CachedEncoder:
    """Texts to ids (little-endian unsigned 32-bit integers).

    ``parts`` encodes short parts, ``whole`` texts with runs of white space, or that
    ``odd`` picks. About ``limit`` parts are remembered.
    """

    def __init__(self, parts: Encode, whole: Encode, odd: Callable[[str], bool] = lambda text: False,
                 limit: int = 700_000):
        self.parts, self.whole, self.odd, self.limit = parts, whole, odd, limit
        self.known: dict[str, bytes | None] = {}  # None: it has white space at an end, or is empty

    def _learn(self, wanted: set[str]) -> set[str]:
        fresh = wanted - self.known.keys()
        plain = [x for x in fresh if x and x.strip() == x]
        self.known.update(zip(plain, self.parts([" " + x for x in plain])))
        if len(plain) < len(fresh):
            self.known.update(dict.fromkeys(fresh.difference(plain)))
        return fresh

    def _group(self, texts: list[str]) -> list[bytes]:
        cut = [x.split(" ") if x else [] for x in texts]
        full = len(self.known) >= self.limit
        passing = self._learn({x for parts in cut for x in parts[1:]})
        heads = list({parts[0] for parts in cut if parts})
        first = dict(zip(heads, self.parts(heads)))
        out: list[bytes | None] = []
        get = self.known.__getitem__
        for text, parts in zip(texts, cut):
            try:
                if not parts:
                    out.append(b"")
                elif self.odd(text) or not parts[0] or parts[0][-1].isspace():
                    out.append(None)
                else:
                    out.append(first[parts[0]] + b"".join(map(get, parts[1:])))
            except TypeError:  # a part known as None
                out.append(None)
        if full:  # what was learnt early is frequent and stays, the rest lasts a group
            for x in passing:
                del self.known[x]
        slow = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(slow, self.whole([texts[i] for i in slow])):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x for at in range(0, len(texts), GROUP) for x in self._group(texts[at:at + GROUP])]


_kept: dict = {}


def per_worker(key, make: Callable):
    """What ``make`` gives, such as an encoder that earlier tasks of this Python process have warmed up."""
    if key not in _kept:
        _kept.clear()  # one at a time bounds the memory
        _kept[key] = make()
    return _kept[key]


class MatchMemory:
    """Encodes texts match by match of a pattern; ``encode`` gets the unseen matches."""

    def __init__(self, pattern: str, encode: Encode, limit: int = 700_000):
        self.split, self.fresh, self.limit = regex.compile(pattern), encode, limit
        self.known: dict[str, bytes] = {}

    def _learn(self, matches: list[str]) -> list[str]:
        """What is to be forgotten after use."""
        texts, full = list(set(matches) - self.known.keys()), len(self.known) >= self.limit
        self.known.update(zip(texts, self.fresh(texts)))
        return texts if full else []

    def _forget(self, passing: list[str]) -> None:
        for x in passing:
            del self.known[x]

    def whole(self, texts: list[str]) -> list[bytes]:
        matches = [self.split.findall(x) for x in texts]
        passing = self._learn([m for x in matches for m in x])
        get = self.known.__getitem__
        out = [b"".join(map(get, x)) for x in matches]
        self._forget(passing)
        return out

    def parts(self, parts: list[str]) -> list[bytes]:
        """Like ``whole`` for parts that hold a space at their start only: they are split
        as one text, in which a space starts each part."""
        if not parts or parts[0][:1] != " ":
            return self.whole(parts)
        matches = self.split.findall("".join(parts))
        passing = self._learn(matches)
        ids = list(map(self.known.__getitem__, matches))
        self._forget(passing)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        begins = np.flatnonzero(np.fromiter((m[0] == " " for m in matches), bool, len(matches)))
        edges = [*np.concatenate([[0], ends])[begins].tolist(), int(ends[-1])]
        flat = b"".join(ids)
        return [flat[a:b] for a, b in zip(edges, edges[1:])]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice holds about ``most`` bytes of ``column`` or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        group = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(edges, [*edges[1:], batch.num_rows]):
            yield batch.slice(a, b - a)
