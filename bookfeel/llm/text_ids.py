"""Texts to ids by the tokenizers library, put together from parts already seen.

A byte-level tokenizer splits a text before merging, and no split-off match spans from a
non-space character into the white space after it, so a text can be cut at every single
space. The parts of a batch are cut, looked up and put together in Arrow. Unseen parts are split by the tokenizer's own pattern, where that is
known, so that the library only gets matches it has not seen.

Parts and matches are remembered up to a number of bytes each; beyond it, new ones last
for one batch. Texts with runs of white space, or with a special token, are encoded
whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# How byte-level tokenizers of this kind split a text; for ASCII texts the same in plain classes.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
JOINED = 4096  # parts given to the library in one text
LONG = 512  # bytes; longer parts aren't remembered
ENTRIES = 1_200_000  # parts, and matches, remembered at most


class Memory:
    """Ids (binary) by text, in Arrow: up to ``most`` bytes and ``ENTRIES`` texts."""

    def __init__(self, most: int):
        self.texts, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.left = most

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, -1 for one that is not known."""
        return np.asarray(pc.fill_null(pc.index_in(texts, value_set=self.texts), -1)).astype(np.int64)

    def keep(self, texts: pa.Array, ids: pa.Array) -> None:
        """New texts with their ids."""
        if self.left <= 0 or not len(texts):
            return
        short = pc.less_equal(pc.binary_length(texts), LONG)
        room = ENTRIES - len(self.texts)
        texts, ids = texts.filter(short)[:room], ids.filter(short)[:room]
        self.texts, self.ids = pa.concat_arrays([self.texts, texts]), pa.concat_arrays([self.ids, ids])
        self.left -= texts.nbytes + ids.nbytes
        if len(self.texts) >= ENTRIES:
            self.left = 0


def _edges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a binary column, from 0, and its bytes."""
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.empty(0, np.uint8)
    return edges - edges[0], flat


class TextIds:
    """``library``: a tokenizers.Tokenizer of a byte-level tokenizer; ``split`` tells that it splits by ``PATTERN``."""

    def __init__(self, library, split: bool, most: int = 80 << 20):
        self.library, self.split = library, split
        self.special = [x.content for x in library.get_added_tokens_decoder().values()]
        self.opens = np.zeros(max(library.get_vocab().values()) + 1, bool)
        self.opens[[i for x, i in library.get_vocab().items() if x.startswith("Ġ")]] = True  # holds a leading space
        self.parts, self.words = Memory(most // 2), Memory(most // 2)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, texts: list[str]) -> list[bytes]:
        """Texts that a space opens and that hold no other: joined, the ids that open with a space start them."""
        out = []
        for at in range(0, len(texts), JOINED):
            ids = np.frombuffer(self.whole(["".join(texts[at:at + JOINED])])[0], "<u4")
            edges = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            flat = ids.tobytes()
            out += [flat[a:b] for a, b in zip(edges, edges[1:])]
        return out

    def _by_matches(self, parts: pa.Array, pattern) -> pa.Array:
        """Ids of parts behind a space, from those of their matches."""
        if not len(parts):
            return pa.array([], pa.binary())
        matches = pa.array(pattern.findall(" " + " ".join(parts.to_pylist())), pa.string())
        coded = matches.dictionary_encode()
        distinct = coded.dictionary
        place = self.words.find(distinct)
        new = distinct.filter(pa.array(place < 0))
        spaced = pc.starts_with(new, pattern=" ")
        new = pa.concat_arrays([new.filter(spaced), new.filter(pc.invert(spaced))])
        n = pc.sum(spaced).as_py() or 0
        texts = new.to_pylist()
        ids = pa.array(self._spaced(texts[:n]) + self.whole(texts[n:]), pa.binary())
        places = np.where(place < 0, len(self.words.ids) + np.asarray(pc.fill_null(pc.index_in(distinct, value_set=new), 0)), place)
        taken = pa.concat_arrays([self.words.ids, ids]).take(pa.array(places[np.asarray(coded.indices)]))
        self.words.keep(new, ids)
        edges, flat = _edges(taken)
        starts = np.flatnonzero(np.asarray(pc.starts_with(matches, pattern=" ")))
        bounds = np.append(edges[starts], edges[-1]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])

    def _learn(self, fresh: pa.Array) -> pa.Array:
        """Ids of parts behind a space; null for one that is empty or has white space at an end."""
        plain = pc.and_(pc.not_equal(fresh, ""), pc.equal(pc.utf8_trim_whitespace(fresh), fresh))
        if self.split:
            plain_ascii = pc.and_(plain, pc.string_is_ascii(fresh))
            groups = [plain_ascii, pc.and_not(plain, plain_ascii)]
            found = [self._by_matches(fresh.filter(g), p) for g, p in zip(groups, (ASCII_PATTERN, PATTERN))]
        else:
            groups = [plain]
            found = [pa.array(self._spaced([" " + x for x in fresh.filter(plain).to_pylist()]), pa.binary())]
        place = np.full(len(fresh), sum(map(len, found)))
        at = 0
        for group, ids in zip(groups, found):
            place[np.asarray(group)] = np.arange(at, at + len(ids))
            at += len(ids)
        out = pa.concat_arrays([*found, pa.nulls(1, pa.binary())]).take(pa.array(place))
        self.parts.keep(fresh.filter(plain), out.filter(plain))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and how many each has."""
        if not len(column):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lists = pc.split_pattern(column, pattern=" ")
        offsets = np.asarray(lists.offsets).astype(np.int64)
        offsets -= offsets[0]
        heads, values = offsets[:-1], lists.flatten()
        memory = self.parts.ids
        index = self.parts.find(values)
        unseen = index < 0
        unseen[heads] = False  # heads have no space before them
        coded = values.filter(pa.array(unseen)).dictionary_encode()
        ids = self._learn(coded.dictionary)
        index[unseen] = len(memory) + np.asarray(coded.indices)
        odd = np.zeros(len(index), bool)
        odd[unseen] = ~np.asarray(pc.is_valid(ids))[np.asarray(coded.indices)]
        head_texts = values.take(pa.array(heads)).to_pylist()
        slow = np.logical_or.reduceat(odd, heads)
        slow |= np.fromiter(((not x and more) or x != x.rstrip() for x, more in zip(head_texts, np.diff(offsets) > 1)), bool, len(heads))
        for token in self.special:
            slow |= np.asarray(pc.match_substring(column, pattern=token))
        index[heads] = len(memory) + len(ids) + np.arange(len(heads))
        if slow.any():
            index[np.repeat(slow, np.diff(offsets))] = len(memory) + len(ids) + len(heads)  # the empty entry
        entries = pa.concat_arrays([memory, ids, pa.array([*self.whole(head_texts), b""], pa.binary())])
        edges, flat = _edges(entries.take(pa.array(index)))
        flat = flat.view("<u4")
        sizes = (edges[offsets[1:]] - edges[heads]) // 4
        if not slow.any():
            return flat, sizes
        rest = [np.frombuffer(x, "<u4") for x in self.whole(column.filter(pa.array(slow)).to_pylist())]
        sizes[slow] = [len(x) for x in rest]
        out = np.empty(int(sizes.sum()), "<u4")
        own = np.repeat(slow, sizes)
        out[own], out[~own] = np.concatenate(rest), flat
        return out, sizes


def of_json(tokenizer: str) -> TextIds:
    """Of the tokenizer described by its JSON."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    said = json.loads(tokenizer)
    before = said.get("pre_tokenizer") or {}
    split = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    return TextIds(Tokenizer.from_str(tokenizer), bool(split) and said.get("normalizer") is None)
