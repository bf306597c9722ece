"""Removal of repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from bookfeel.llm import queries, repeated_bytes


def expected(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter()
    for b in raw:
        n.update(hash(b[i:i + 200]) for i in range(len(b) - 199))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if n[hash(b[i:i + 200])] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.diff(gone.astype(int), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), len(spans), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, texts, **options):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "doc_id AS key", "'x' AS row", "1 AS n", "text AS gram").repartition(5)
    found = {r["row"]["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], list(zip(r["starts"], r["ends"])), r["kept_sha256"])
             for r in repeated_bytes.without_repeats(df, **options).collect()}
    want = expected(texts)
    assert [found[i] for i in range(len(texts))] == want
    return want


def prose(draw, n):
    return "".join(draw.choice("abcdefghij éü") for _ in range(n))


def test_query_against_all_windows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in queries.op13(spark, SMALL).collect()}
    want = {d[0]: (*w[:3], w[4]) for d, w in zip(docs, expected([d[1] for d in docs]))}
    assert found == want and sum(w[1] for w in want.values())


def test_passages_and_ends(spark):
    """Passages just at, under and over 200 bytes, at every place; periodic, short, null and equal texts."""
    draw = random.Random(5)
    passages = [prose(draw, 600) for _ in range(4)]
    texts = [None, "", "short", None, "a" * 199, "a" * 200, "b" * 201, "cd" * 400, "efg" * 90 + prose(draw, 50), "\n" * 900]
    for p in passages:
        texts += [p, p, p[:180], p[7:]]
    for k in range(60):
        p = draw.choice(passages)
        a = draw.randrange(0, 400)
        texts.append(prose(draw, draw.randrange(0, 300)) + p[a:a + draw.choice([150, 185, 199, 200, 210, 260])] + prose(draw, draw.randrange(0, 300)))
    line = prose(draw, 100)
    texts += [line * 3, line + prose(draw, 30) + line, line + line[:99], ("x" + line) * 2]
    for _ in range(30):  # near copies with edits
        t = list(passages[0] + passages[1])
        for _ in range(draw.randrange(1, 4)):
            t[draw.randrange(len(t))] = draw.choice("QRSTU")
        texts.append("".join(t))
    assert sum(w[1] for w in compare(spark, texts))
    assert repeated_bytes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "PIECE", 1000)
    draw = random.Random(9)
    a, b = prose(draw, 9000), prose(draw, 5000)
    texts = [a + b, b[100:4000] + a[2000:2300], a[:5000] + "?" + a[5001:], prose(draw, 7000), "z" * 6000, "yx" * 2500 + a[:250]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    pieces = [repeated_bytes.text_anchors(data, offsets, i, i + 1) for i in range(len(texts))]
    monkeypatch.setattr(repeated_bytes, "PIECE", 1 << 17)
    whole = repeated_bytes.text_anchors(data, offsets, 0, len(texts))
    for x, y in zip(zip(*pieces), whole):
        assert np.array_equal(np.concatenate(x), y)


@pytest.mark.parametrize("often", [2, 64])
def test_salted_groups(spark, monkeypatch, often):
    """A passage and near copies in most texts; with a low bar their buckets are spread over salts."""
    monkeypatch.setattr(repeated_bytes, "OFTEN", often)
    monkeypatch.setattr(repeated_bytes, "SAMPLE", 3)
    draw = random.Random(2)
    passage, base = prose(draw, 450), prose(draw, 900)
    texts = []
    for k in range(120):
        t = list(base)
        t[draw.randrange(len(t))] = "Q"
        texts.append("".join(t) if k % 2 else prose(draw, 120) + passage + prose(draw, 90))
    texts += [base] * 20
    compare(spark, texts, keep=["doc_id", "gram"])


def test_a_very_long_text(spark):
    draw = random.Random(4)
    half = prose(draw, 700_000)
    text = half + "!" + half[5:] + "q" * 300_000
    rows = repeated_bytes.without_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len(half.encode())
    total = len(text.encode())
    first = len(half[:5].encode())
    assert rows[0]["n_bytes"] == total
    assert list(zip(rows[0]["starts"], rows[0]["ends"])) == [(first, n), (n + 1, total)]
