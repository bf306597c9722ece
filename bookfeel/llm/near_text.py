"""Near-duplicate texts by improved consistent weighted sampling.

A text is a weighted set of five-word shingles: count times mean idf of the words. Idf
comes from the document frequencies of all words in the corpus; those under
1/``RARE`` of the documents count as that, so the table of the others has at most
``RARE`` times the mean number of distinct words of a text as entries, however large
the corpus. (The frequency of a whole shingle would be the size of its group of
copies, and would hide large groups.) Each text gives ``SAMPLES`` consistent weighted
samples; two texts agree on one with the probability of their weighted Jaccard
similarity. Bands of ``BAND`` samples propose pairs, pairs with too few agreements for
the threshold (at the recall asked for) go, the others are verified exactly.

Texts with the same words are copies and are looked at once. In a bucket every text
is first verified against the least; those that stay outside that text's class then
meet every text of the bucket that is in another class, in large buckets block by
block on their samples. So no pair across classes is passed over, and few within one
are listed.

Words are runs of letters and digits of any script, lower-cased; marks, joiners and other
invisible format characters go with what they follow, all other characters (punctuation,
spaces, symbols) are outside. In scripts written without spaces (``SPACELESS``) every
letter is a word. A text of fewer than five words is one shingle; in one without words
each of its other characters counts as a word. Null and empty texts are copies of each other. Rows are told apart by key
and text: ``near_texts`` marks repeated ones alike, ``deduplicated`` keeps one of them
and all columns.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from .components import components
from .pieces import slices

WORDS = 5
SAMPLES, BAND = 40, 4
RARE = 256
SMALL = 16  # members of a bucket whose pairs are listed
BLOCK = 512  # texts of a family compared at once
BLOCK_BYTES = 2 << 20  # of texts whose pairs are verified together
FEW = 1 << 20  # rows of two hashes that may be broadcast; beyond that, a shuffled join
ODD, MIX, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_IN_WORD = np.array([chr(i).isalnum() for i in range(128)])
OUTSIDE, LETTER, SINGLE, MARK = range(4)
# First and last code points of scripts written without spaces between words.
SPACELESS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF),  # Thai, Lao, Myanmar, Khmer, Tai
    (0x1B00, 0x1B7F), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0x11700, 0x1174F),  # Balinese, Javanese, Myanmar, Tai Viet, Ahom
    (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31FF),  # radicals, kana, bopomofo
    (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),  # Han, Yi, half-width kana
    (0x12000, 0x1467F), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),  # cuneiform, hieroglyphs, Tangut, kana, Nushu, Han
)
_SEEDS = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((ODD, INVERSE)):
            _powers[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base)]))
    return _powers[0], _powers[1]


@cache
def _classes() -> np.ndarray:
    """Class of every code point; made once in a process that meets other than ASCII."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LN":
            out[i] = LETTER
        elif kind[0] == "M" or kind == "Cf" and i != 0x200B:  # the zero width space does divide words
            out[i] = MARK
    for first, last in SPACELESS:
        part = out[first:last + 1]
        part[part == LETTER] = SINGLE
        for i in range(first, last + 1):  # digits are written together in these scripts too
            if unicodedata.category(chr(i)) == "Nd":
                out[i] = LETTER
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    text = (text or "").lower()
    if text.isascii():
        b = np.frombuffer(text.encode(), np.uint8)
        inside = _IN_WORD[b]
        first = np.diff(inside, prepend=False) & inside
    else:
        b = _codes(text)
        kind = _classes()[b]
        base = kind
        if (kind == MARK).any():  # a mark is of the class of what it follows
            base = kind[np.maximum.accumulate(np.where(kind == MARK, 0, np.arange(len(kind))))]
        letter = base == LETTER
        inside = letter | (base == SINGLE)
        first = (kind == SINGLE) | (np.diff(letter, prepend=False) & letter)
    if not inside.any():
        b = _codes("".join(text.split()))
        inside = first = np.ones(len(b), bool)
        if not len(b):
            return np.empty(0, np.uint64)
    starts = np.flatnonzero(first)
    up, down = _power(len(b))
    each = _BYTE[b] if b.dtype == np.uint8 else _mixed(b.astype(np.uint64) + np.uint64(1))
    return _mixed(np.add.reduceat(np.where(inside, each, 0) * up[:len(b)], starts) * down[starts])


def identity(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes of a sequence of words."""
    up = _power(len(hashes))[0][:len(hashes)]
    sums = np.array([(_mixed(hashes + np.uint64(seed)) * up).sum(dtype=np.uint64) for seed in (1, 2)], np.uint64)
    first, second = _mixed(sums + np.uint64(len(hashes))).view(np.int64).tolist()
    return first, second


class Idf:
    """Idf of words, from the frequent ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, documents: int):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = 1 + np.log(np.maximum(documents, 1) / counts[order])
        self.rare = 1 + math.log(RARE)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], self.rare)


def shingles(hashes: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    n = min(WORDS, len(hashes))
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    count, weigh = len(hashes) - n + 1, idf.of(hashes)
    code, weight = np.full(count, np.uint64(n)), np.zeros(count)
    for k in range(n):
        code = (code ^ hashes[k:k + count]) * ODD
        weight += weigh[k:k + count]
    found, at, times = np.unique(_mixed(code), return_index=True, return_counts=True)
    return found, times * weight[at] / n


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard."""
    if len(a[0]) and len(b[0]):
        at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
        both = np.where(b[0][at] == a[0], np.minimum(a[1], b[1][at]), 0).sum()
    else:
        both = 0.0
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 1.0


def samples(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, each as a 32-bit hash of shingle and level."""
    best = np.full(SAMPLES, np.inf)
    out = np.zeros(SAMPLES, np.uint64)
    scale = 2.0 ** -32
    low = np.uint64(0xFFFFFFFF)
    for part in range(0, len(found), 2048):
        s, log_w = found[part:part + 2048], np.log(weights[part:part + 2048]).astype(np.float32)[:, None]
        x = (s[:, None] ^ _SEEDS) * MIX
        x ^= x >> np.uint64(29)
        y = (x + ODD) * MIX2
        y ^= y >> np.uint64(32)

        def gamma(z: np.ndarray) -> np.ndarray:
            u = ((z & low).astype(np.float32) + np.float32(0.5)) * np.float32(scale)
            v = ((z >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(scale)
            return np.maximum(-np.log(u * v), np.float32(1e-6))

        r, c = gamma(x), gamma(y)
        z = (y ^ x) * ODD
        beta = (z >> np.uint64(40)).astype(np.float32) * np.float32(2.0 ** -24)
        level = np.floor(log_w / r + beta)
        value = np.log(c) - r * (level - beta + 1)
        at = value.argmin(axis=0)
        least = value[at, np.arange(SAMPLES)]
        better = least < best
        best[better] = least[better]
        picked = s[at] ^ (level[at, np.arange(SAMPLES)].astype(np.int64).view(np.uint64) * MIX)
        out[better] = picked[better]
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def band_keys(sample: np.ndarray) -> np.ndarray:
    key = np.zeros(SAMPLES // BAND, np.uint64)
    for column in sample.reshape(-1, BAND).T:
        key = (key ^ column.astype(np.uint64)) * ODD
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def agreements(threshold: float, recall: float = 0.99999) -> int:
    """Agreeing samples to ask for, so that a pair at the threshold is let through with
    probability ``recall``."""
    need, missed = 0, 0.0
    while need < SAMPLES:
        missed += math.comb(SAMPLES, need) * threshold**need * (1 - threshold) ** (SAMPLES - need)
        if missed > 1 - recall:
            break
        need += 1
    return need


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: in how many texts a word occurs, for words above 1/``RARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t_text", 32 << 20):
            each = [np.unique(words(x)) for x in batch.column("_t_text").to_pylist()]
            found, n = np.unique(np.concatenate(each), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                                             names=["word", "n"])

    counts = docs.select("_t_text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > docs.agg(F.count("*")).scalar() / RARE)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_t_key"), body.alias("_t_text"), F.xxhash64(body).alias("_t_1"),
                       F.xxhash64(body, F.lit(3)).alias("_t_2"))


def _texts(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``_c, text`` for the classes in ``members``."""
    wanted = written(members.join(classes.select("_c", "_t_1", "_t_2"), "_c"), "wanted-texts")
    n = wanted.count()
    chosen = F.broadcast(wanted) if n <= FEW else wanted  # so the texts needn't be shuffled
    return written(docs.select("_t_1", "_t_2", "_t_text").join(chosen, ["_t_1", "_t_2"]).groupBy("_c")
                   .agg(F.first("_t_text").alias("text")).coalesce(max(1, -(-n // 2000))), "pair-texts")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links that connect whatever the pairs ``a, b`` with weighted Jaccard at or above
    ``threshold`` connect.

    Texts are dealt into blocks of about ``BLOCK_BYTES``, and pairs go by the two blocks
    of their texts: a text travels once for each block that it has partners in, not for
    each partner, and its shingles are made once there. Pairs that links found before
    already connect are passed over.
    """
    need = agreements(threshold)
    left = classes.select(F.col("_c").alias("a"), F.col("sample").alias("x"))
    agree = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda hit: hit))
    likely = written(pairs.join(left, "a").join(left.toDF("b", "y"), "b").where(agree >= need).select("a", "b"), "text-pairs")
    texts = _texts(likely.select(F.col("a").alias("_c")).union(likely.select("b")).distinct(), classes, docs)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(13)), F.lit(max(1, -(-size // BLOCK_BYTES)))).cast("int")
    dealt = written(likely.select("a", "b", block("a").alias("p"), block("b").alias("q"))
                    .select("a", "b", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")), "text-pairs-dealt")
    travels = dealt.select(F.col("p").alias("x"), F.col("q").alias("y"), F.col("a").alias("_c")) \
        .union(dealt.select("p", "q", "b")).distinct()

    def verify(pairs_: pa.Table, texts_: pa.Table) -> pa.Table:
        at = {c: i for i, c in enumerate(texts_["_c"].to_pylist())}
        sets = [shingles(words(x), idf) for x in texts_["text"].to_pylist()]
        parent, found = list(range(len(sets))), []

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for u, v in zip(pairs_["a"].to_pylist(), pairs_["b"].to_pylist()):
            i, j = root(at[u]), root(at[v])
            if i != j and similarity(sets[at[u]], sets[at[v]]) >= threshold:
                parent[i] = j
                found.append((u, v))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return written(dealt.groupBy("p", "q").cogroup(travels.join(texts, "_c").select("x", "y", "_c", "text").groupBy("x", "y"))
                   .applyInArrow(verify, "a bigint, b bigint"), "text-links")


def _by_families(placed: DataFrame, classes: DataFrame, docs: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Links across classes within large buckets (rows of ``placed``).

    The buckets whose leaders are in one class make up a family; its texts, taken once
    however many buckets they share, are dealt into blocks, and every block of texts
    outside the leaders' class meets every block of the family in a task of its own.
    There pairs with enough agreements are verified, the likeliest first; those that
    earlier links connect are passed over, and only links leave the task.
    """
    need = agreements(threshold)
    family = placed.select("led", "_c", "root").distinct()
    sizes = family.groupBy("led").agg(
        F.ceil(F.count(F.when(F.col("root") != F.col("led"), 1)) / BLOCK).alias("outside"), F.ceil(F.count("*") / BLOCK).alias("all"))
    family = written(family.join(sizes.where("outside > 0"), "led"), "text-families")
    texts = _texts(family.select("_c").distinct(), classes, docs)
    rows = written(family.join(texts.join(classes.select("_c", "sample"), "_c"), "_c"), "family-texts")
    block = lambda n: F.pmod(F.xxhash64("_c", F.lit(13)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    fields = ["_c", "root", "sample", "text"]
    dealt = rows.where("root <> led").select("led", block("outside").alias("p"), every("all").alias("q"), F.lit(True).alias("out"), *fields) \
        .union(rows.select("led", every("outside").alias("p"), block("all").alias("q"), F.lit(False).alias("out"), *fields))

    def compare(table: pa.Table) -> pa.Table:
        ids, roots, out = (table[c].to_numpy() for c in ("_c", "root", "out"))
        sample = np.array(table["sample"].to_pylist(), np.int32).reshape(-1, SAMPLES)
        x, y = np.flatnonzero(out), np.flatnonzero(~out)
        agree = np.zeros((len(x), len(y)), np.uint8)
        for k in range(SAMPLES):
            agree += sample[x, k, None] == sample[y, k]
        i, j = np.nonzero((agree >= need) & (roots[x][:, None] != roots[y]))
        order = np.argsort(-agree[i, j].astype(int), kind="stable")
        made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parent: dict[int, int] = {}
        found = []

        def top(r: int) -> int:
            while parent.get(r, r) != r:
                r = parent[r]
            return r

        def shingled(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in made:
                made[k] = shingles(words(table["text"][k].as_py()), idf)
            return made[k]

        for u, v in zip(x[i[order]].tolist(), y[j[order]].tolist()):
            a, b = top(int(roots[u])), top(int(roots[v]))
            if a != b and similarity(shingled(u), shingled(v)) >= threshold:
                parent[a] = b
                found.append((int(ids[u]), int(ids[v])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return written(dealt.groupBy("led", "p", "q").applyInArrow(compare, "a bigint, b bigint"), "text-links")


def classes_of(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``_t_key``, ``_t_1``, ``_t_2`` (hashes of the text), ``class_id`` (least
    key of its class), ``class_size`` and ``kept_key``, ``kept_1``, ``kept_2``: the row
    that stays for the class."""
    rows = _identified(docs, key, text)
    frequent = word_counts(rows).collect()  # bounded: RARE times the distinct words of a text
    idf = Idf(np.array([r["word"] for r in frequent], np.int64).view(np.uint64),
              np.array([r["n"] for r in frequent], float), rows.count())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t_text"):
            ids, signed = [], []
            for x in batch.column("_t_text").to_pylist():
                w = words(x)
                ids.append(identity(w))
                signed.append(samples(*shingles(w, idf)).view(np.int32) if len(w) else None)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("_t_key", "_t_1", "_t_2")),
                pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()),
                pa.array(signed, pa.list_(pa.int32()))], names=["_t_key", "_t_1", "_t_2", "h1", "h2", "sample"])

    kind = docs.schema[key].dataType.simpleString()
    signed = written(rows.mapInArrow(
        sign, f"_t_key {kind}, _t_1 bigint, _t_2 bigint, h1 bigint, h2 bigint, sample array<int>"), "signed-texts")
    row = F.struct("_t_key", "_t_1", "_t_2")
    classes = written(
        signed.groupBy("h1", "h2").agg(F.min(row).alias("least"), F.count("*").alias("copies"), F.first("sample").alias("sample"))
        .select("h1", "h2", "least", "copies", "sample", "least._t_1", "least._t_2")
        .withColumn("_c", F.monotonically_increasing_id()), "text-classes")

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.array(x, np.int32).view(np.uint32)) for x in batch.column("sample").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_c"), pa.array(keys, pa.list_(pa.int64()))], names=["_c", "keys"])

    bands = written(classes.where("sample IS NOT NULL").select("_c", "sample").mapInArrow(banded, "_c bigint, keys array<bigint>")
                    .select("_c", F.posexplode("keys").alias("band", "key")), "text-bands")
    buckets = written(bands.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("_c").alias("leader")).where("n > 1"),
                      "text-buckets")
    members = written(bands.join(buckets, ["band", "key"]), "text-members")
    stars = members.where("_c <> leader").select(F.col("leader").alias("a"), F.col("_c").alias("b")).distinct()
    links = _verified(stars, classes, rows, idf, threshold)
    roots = written(components(links), "text-roots")

    # Members that aren't in the class of their bucket's leader meet those of other classes.
    placed = members.join(roots.withColumnRenamed("node", "_c"), "_c", "left") \
        .withColumn("root", F.coalesce("root", "_c")) \
        .join(roots.select(F.col("node").alias("leader"), F.col("root").alias("led")), "leader", "left") \
        .withColumn("led", F.coalesce("led", "leader"))
    placed = written(placed, "text-placed")
    outside = placed.where("root <> led AND _c <> leader")
    small = outside.where(F.col("n") <= SMALL).select("band", "key", "_c", "root", "leader").join(
        placed.where((F.col("n") <= SMALL) & (F.col("_c") != F.col("leader")))
        .select("band", "key", F.col("_c").alias("d"), F.col("root").alias("other")), ["band", "key"]) \
        .where("root <> other").select(F.least("_c", "d").alias("a"), F.greatest("_c", "d").alias("b"))
    more = _verified(small.distinct(), classes, rows, idf, threshold) \
        .union(_by_families(placed.where(F.col("n") > SMALL), classes, rows, idf, threshold))
    roots = written(components(links.union(more)), "text-roots")

    joined = classes.join(roots, F.col("_c") == F.col("node"), "left").select(
        "h1", "h2", "least", "copies", F.coalesce("root", "_c").alias("root"))
    kept = written(joined.groupBy("root").agg(F.min("least").alias("kept"), F.sum("copies").alias("class_size")), "text-kept")
    final = written(joined.join(kept, "root").select("h1", "h2", "kept", "class_size"), "text-final")
    return signed.select("_t_key", "_t_1", "_t_2", "h1", "h2").join(final, ["h1", "h2"]).select(
        "_t_key", "_t_1", "_t_2", F.col("kept._t_key").alias("class_id"), "class_size",
        F.col("kept._t_key").alias("kept_key"), F.col("kept._t_1").alias("kept_1"), F.col("kept._t_2").alias("kept_2"))


def near_texts(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``class_id``, ``class_size`` (rows) and ``kept``."""
    kept = F.col("_t_key").eqNullSafe(F.col("kept_key")) & (F.col("_t_1") == F.col("kept_1")) & (F.col("_t_2") == F.col("kept_2"))
    return classes_of(docs, threshold, key, text).select(
        F.col("_t_key").alias(key), "class_id", "class_size", kept.alias("kept"))


def deduplicated(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all columns as they are."""
    found = classes_of(docs, threshold, key, text)
    own = F.col("_t_key").eqNullSafe(F.col("kept_key")) & (F.col("_t_1") == F.col("kept_1")) & (F.col("_t_2") == F.col("kept_2"))
    stays = written(found.where(own).groupBy("_t_key", "_t_1", "_t_2").agg(F.count("*").alias("_t_same")), "text-stays")
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(F.struct(*docs.columns).alias("_t_row"), F.col(key).alias("_t_own"), F.xxhash64(body).alias("_t_x"),
                         F.xxhash64(body, F.lit(3)).alias("_t_y"))
    joined = marked.join(stays, F.col("_t_own").eqNullSafe(F.col("_t_key")) & (F.col("_t_x") == F.col("_t_1"))
                         & (F.col("_t_y") == F.col("_t_2")))
    once = joined.where("_t_same = 1").select("_t_row.*")
    if stays.where("_t_same > 1").isEmpty():
        return once
    return once.union(joined.where("_t_same > 1").dropDuplicates(["_t_own", "_t_x", "_t_y"]).select("_t_row.*"))
