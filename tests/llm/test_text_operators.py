"""Operators on texts against libraries and brute force, with the odd rows of each."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookfeel.llm import bpe, fingerprints, near_text, quality, text_ids, token_store
from bookfeel.llm.pieces import CachedEncoder, MatchMemory
from bookfeel.llm.queries import vocabulary

RANKS = vocabulary("byte_bpe_50k.tiktoken")
JSON = vocabulary("byte_bpe_50k.json").decode()
ALPHABET = "abc the AB12  \n\t\x1c\x1d\x85\xa0éü中文😀'!?.,$%<|endoftext|> "


def odd_texts():
    draw = random.Random(3)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(300)]
    return texts + ["", " ", "  a", "a\n\nb  c", "a" * 5000, "ab" * 1500, "abc" * 700 + "x", "\n" * 999 + "x", "the" * 400,
                    "".join(draw.choice("abcdefgh") for _ in range(2000)), "word " * 30_000]


def docs(spark, texts, start=0):
    """Documents with null fields, a repeated row and columns of clashing names."""
    rows = [(start + i, x, "en", None if i % 3 else "s", 1, "_", 7, [1]) for i, x in enumerate(texts)]
    rows += [(None, None, None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, ids int, _key string, size int, keys array<int>")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_merges_equal_the_library():
    model = bpe.Bpe(bpe.read_ranks(RANKS))
    memory = MatchMemory(P.PATTERN, model.encode)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = odd_texts()
    small = MatchMemory(P.PATTERN, model.encode, limit=5)
    for encoder in (CachedEncoder(memory.parts, memory.whole), CachedEncoder(small.parts, small.whole, limit=5)):
        ids = encoder.encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [lib.encode_ordinary(x) for x in texts]
    assert [model.decode(np.frombuffer(x, "<u4")).decode() for x in ids] == texts


def test_long_matches_merge_alike_both_ways():
    ranks = bpe.read_ranks(RANKS)
    rows = ["a" * 700, "ab" * 300, "the" * 100 + "x", "\n" * 513, "abcdefgh" * 60, "aab" * 200]
    assert all(len(x) > bpe.Bpe(ranks).long for x in rows)
    assert list(bpe.Bpe(ranks).encode(rows)) == list(bpe.Bpe(ranks, long=1024).encode(rows))


def test_encoded_documents(spark):
    texts = odd_texts()[:60]
    rows = bpe.encode_documents(docs(spark, texts), RANKS, P.PATTERN).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "" if r["doc_id"] is None else texts[r["doc_id"]]
        assert bytes(r["decoded"]).decode() == text and r["n_tokens"] * 4 == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), RANKS, P.PATTERN, keep=()).count() == 0


def huffman_bits(counts):
    import heapq

    heap = [(int(c), i) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    total, tie = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total, tie = total + a[0] + b[0], tie + 1
        heapq.heappush(heap, (a[0] + b[0], tie))
    return total


@pytest.mark.parametrize("n, limit", [(1, 16), (2, 16), (300, 16), (300, 9), (5000, 13)])
def test_code_lengths(n, limit):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(max=10**7)
    lengths = token_store.code_lengths(counts, limit)
    assert lengths.max() <= limit and (n == 1 or sum(2.0 ** -lengths.astype(float)) == 1)
    if limit == 16 and n < 5000:
        free = token_store.code_lengths(counts, 40)
        assert n == 1 or (free * counts).sum() == huffman_bits(counts)
    book = token_store.Codebook(lengths)
    for size in (0, 1, 255, 256, 257, 3000):
        ids = np.random.default_rng(size).integers(0, n, size)
        payload, checkpoints = book.encode(ids)
        assert (book.decode(payload, checkpoints, size) == ids).all()


@pytest.mark.parametrize("split", [True, False])
@pytest.mark.parametrize("most", [0, 2000, 80 << 20])
def test_ids_equal_the_library(split, most):
    """With known matches or not, with all, some or no memory, in one batch and in many."""
    lib = Tokenizer.from_str(JSON)
    texts = [*odd_texts(), "a<|endoftext|>b", "it's we'll 'tis '' 's x'", "naïve café 中文 字 naïve", "x" * 3000 + " y", "two words"] * 2
    want = [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]
    own = text_ids.TextIds(lib, split, most)
    for step in (len(texts), 7):
        got = []
        for at in range(0, len(texts), step):
            flat, sizes = own.encode(pa.array(texts).slice(at, step))
            ends = np.cumsum(sizes)
            got += [flat[b - n:b].tolist() for b, n in zip(ends.tolist(), sizes.tolist())]
        assert got == want
    assert [len(x) for x in own.encode(pa.array([], pa.string()))] == [0, 0]


def test_token_store(spark, tmp_path, monkeypatch):
    texts = odd_texts()[-60:] + ["a<|endoftext|>b"]
    lib = Tokenizer.from_str(JSON)
    table = docs(spark, texts)
    token_store.write_store(table, JSON, str(tmp_path / "s"), end_id=0)
    rows = token_store.read_store(spark, str(tmp_path / "s")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 0, 0, *range(1, len(texts))]
    start = 0
    for r in rows:
        ids = lib.encode(texts[r["doc_id"]] if r["doc_id"] is not None else "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert (r["start"], r["n_tokens"]) == (start, len(ids)) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += len(ids)
    token_store.write_store(empty(spark), JSON, str(tmp_path / "e"))
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


def longest_common(a, b):
    t = [0] * (len(b) + 1)
    for x in a:
        q = 0
        for j, y in enumerate(b):
            p = t[j + 1]
            t[j + 1] = q + 1 if x == y else max(t[j + 1], t[j])
            q = p
    return t[-1]


def test_fingerprint_likeness():
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], k=n)) for n in (1, 3, 30, 300, 3000)]
    texts += ["", "a" * 5000, "abcab" * 700]
    prints = [fingerprints.fingerprint(x.encode()) for x in texts]
    for x in prints:
        size, one, two = x.split(":")
        assert int(size) >= 4 and len(two) <= len(one) <= 64
    pairs = [(a, b) for a in prints for b in prints]
    for (a, b), found in zip(pairs, fingerprints.likeness(pairs)):
        (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
        n, m = int(n), int(m)
        sides = [(a1, b1), (a2, b2)] if n == m else [(a2, b1)] if 2 * n == m else [(a1, b2)] if n == 2 * m else []
        want = max((2 * longest_common(x, y) / (len(x) + len(y)) if x + y else 1.0 for x, y in sides), default=0.0)
        assert found == pytest.approx(1.0 if a == b else want)


def test_fingerprints_of_edited_texts(spark):
    texts = odd_texts()[:80] + ["word " * 5000, "unlike text"]
    rows = {r["doc_id"]: r for r in fingerprints.with_edits(docs(spark, texts).dropDuplicates(["doc_id"])).collect()}
    assert len(rows) == len(texts) + 1
    ids = [*range(len(texts) - 1, -1, -1), None]  # null comes last
    for k, i in enumerate(ids):
        own, other = ("" if j is None else texts[j] for j in (i, ids[(k + 1) % len(ids)]))
        third = len(own) // 3
        edited = (own[:len(own) - third] + other[:third]).encode()
        r = rows[i]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert r["fingerprint"] == fingerprints.fingerprint(own.encode())
        assert r["edited_fingerprint"] == fingerprints.fingerprint(edited)
        assert r["near_next"] == fingerprints.likeness([(r["fingerprint"], fingerprints.fingerprint(other.encode()))])[0]
    one = fingerprints.with_edits(docs(spark, ["abcdef"]).where("doc_id = 0").limit(1)).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1
    assert fingerprints.with_edits(docs(spark, texts)).count() == len(texts) + 2
    assert fingerprints.with_edits(empty(spark)).count() == 0
    assert fingerprints.fingerprints(docs(spark, texts)).count() == len(texts) + 2


def junk_and_prose(n):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = draw.choices(words, k=draw.randint(20, 120))
        kind = i % 8
        text = (" ".join(w).capitalize() + "." if kind > 1 else " ".join(x.upper() + "!!" for x in w) if kind else
                " ".join(x for x in w[:6] for _ in range(12)))
        rows.append((i, text, int(kind > 1)))
    return rows


def test_quality(spark):
    rows = junk_and_prose(600)
    table = docs(spark, [r[1] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows] + [(None, 1, 0), (3, None, 1), (4, 5, 1)],
                                   "doc_id long, quality int, toxic int")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = quality.fit(table, labels.where(~fold))
    found = quality.score(table, model).select("doc_id", "text", "score", fold.alias("held")).collect()
    assert len(found) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held"] and r["doc_id"] is not None]
    assert len(held) > 60 and sum((r["score"] >= 0.3) == (rows[r["doc_id"]][2] == 1) for r in held) >= 0.98 * len(held)
    again = quality.fit(table.repartition(3), labels.where(~fold))
    assert (again.weights == model.weights).all() and again.shift == model.shift
    assert quality.score(empty(spark), model).count() == 0
    assert quality.fit(table, labels.limit(0)).score(0.0) == pytest.approx(0.5)
    assert quality.fit(table, labels.where("quality = 1")).score(0.0) > 0.99


def naive_shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    n = min(5, len(w))
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)] if w else ["".join((text or "").split())]


def near_corpus():
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefghijklm", k=draw.randint(2, 7))) for _ in range(3000)]
    text = lambda n: draw.choices(words, k=n)
    shared, out = text(60), []
    for _ in range(60):  # alike in a passage only
        out.append(" ".join(text(120) + shared))
    base = text(300)
    for k in range(90):  # one large group of near copies
        w = list(base)
        w[draw.randrange(300)] = f"edit{k}"
        out.append(" ".join(w))
    for k in range(12):  # chains whose ends are less alike
        w = list(base[:200]) if not k else w
        w[k * 8:k * 8 + 3] = [f"x{k}", f"y{k}", f"z{k}"]
        out.append(" ".join(w))
    out += ["Same words, twice", "same   WORDS twice!", "", " ", "!!!", "???", "four words are here", "four words are there"]
    return out


def test_near_texts_against_all_pairs(spark):
    texts = near_corpus()
    table = docs(spark, texts)
    rows = near_text.near_texts(table).collect()
    assert len(rows) == len(texts) + 2 and len({r["doc_id"] for r in rows if r["kept"]}) == len({r["class_id"] for r in rows})
    n = len(texts) + 2
    df = {}
    for x in [*texts, None, texts[0]]:
        for w in set(near_text.words(x).tolist()):
            df[w] = df.get(w, 0) + 1
    many = {w: c for w, c in df.items() if c > n / near_text.RARE}
    idf = near_text.Idf(np.array(list(many), np.uint64), np.array(list(many.values()), float), n)
    sets = [near_text.shingles(near_text.words(x), idf) for x in texts]
    for x, s in zip(texts, sets):
        assert len(s[0]) == (len(set(naive_shingles(x))) if naive_shingles(x) != [""] else 0)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_text.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i: root(i) for i in range(len(texts))}
    # The null text is a copy of the empty ones; its null key is the least.
    blank = {i for i, x in enumerate(texts) if not x.strip()}
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] in blank:
            assert r["class_id"] is None
        else:
            assert r["class_id"] == want[r["doc_id"]]
    kept = near_text.deduplicated(table)
    assert kept.columns == table.columns and kept.count() == len({r["class_id"] for r in rows})
    assert near_text.near_texts(empty(spark)).count() == 0 and near_text.deduplicated(empty(spark)).count() == 0


def test_words_of_all_scripts():
    same = lambda a, b: near_text.words(a).tolist() == near_text.words(b).tolist()
    count = lambda x: len(near_text.words(x))
    assert same("it's \"so\" - a b, c", "it\u2019s \u201cso\u201d\u2014a\u00a0b\u3001c\u3000") and count("it's") == 2
    assert same("Ünï tëxt", "ünï…TËXT") and count("привет, мир") == 2 and count("हिन्दी में") == 2 and count("cafe\u0301 x") == 2
    assert count("今天天气很好。") == 6 and count("カタカナ、ひらがな") == 8 and count("ราคา 120 บาท") == 8 and count("한국어 텍스트") == 2
    assert same("a漢b2", "a 漢 b2") and same("漢\ufe0fab 3", "漢\ufe0f ab 3") and count("می\u200cخواهم") == 1 and count("a\u200bb") == 2
    assert count("——😀 😀") == 4 and count("！！！") == 3 and count("\u3000\xa0") == 0 and count("a❤️b") == 2
    assert near_text.words("plain Words a_b").tolist() == near_text.words("plain Words a_b é").tolist()[:4]


def test_near_texts_of_other_scripts(spark):
    draw = random.Random(5)
    texts = []
    for letters, stop in (("".join(map(chr, range(0x4E00, 0x4F00))), "，"), ("กขคงจฉชซฌญดตถทธนบปผพ", " "),
                          ("あいうえおかきくけこさしすせそ", "。"), (None, "\u2014"), (None, "\u00a0")):
        token = (lambda: "".join(draw.choices(letters, k=8))) if letters else (lambda: "".join(draw.choices("abcdefgh", k=5)))
        w = [token() for _ in range(100)]
        other = [token() for _ in range(100)]
        edited = list(w)
        edited[50] = token()
        texts += [stop.join(w), stop.join(edited), stop.join(other)]
    rows = {r["doc_id"]: r["class_id"] for r in near_text.near_texts(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows == {i: i - (i % 3 == 1) for i in range(len(texts))}


def test_large_buckets_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(near_text, "SMALL", 2)
    monkeypatch.setattr(near_text, "BLOCK", 16)
    test_near_texts_against_all_pairs(spark)


def test_samples_agree_as_similarity():
    draw = np.random.default_rng(1)
    for part in (60, 30):
        agree, alike = [], []
        for _ in range(80):
            a = draw.integers(0, 2**63, 200).astype(np.uint64)
            b, w = a.copy(), draw.uniform(1, 6, 200)
            b[:part] = draw.integers(0, 2**63, part).astype(np.uint64)
            v = w * draw.uniform(0.8, 1.2, 200)
            agree.append((near_text.samples(a, w) == near_text.samples(b, v)).mean())
            i, j = a.argsort(), b.argsort()
            alike.append(near_text.similarity((a[i], w[i]), (b[j], v[j])))
        assert np.mean(agree) == pytest.approx(np.mean(alike), abs=0.03)
