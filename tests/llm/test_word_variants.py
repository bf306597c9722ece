"""Spelling variants against a comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from conftest import SMALL

from bookfeel.llm import queries, word_variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(n: dict[str, int]) -> set:
    edges = {w: [] for w in n}
    words = sorted(n)
    holes: dict = {}
    for w in words:  # one-code-point holes propose, ``near`` decides
        for i in range(len(w) + 1):
            holes.setdefault((w[:i], w[i:]), set()).add(w)
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for group in holes.values():
        for a in group:
            edges[a] += [b for b in group if near(a, b)]
    form = {}
    for w, found in edges.items():
        edges[w] = found = set(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(edges[w]), n[form[w]] if form[w] is not None else None) for w in n}


def counted(rows) -> dict[str, int]:
    n: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def rows_of(df):
    found = [tuple(r) for r in df.collect()]
    assert len(set(found)) == len(found)
    return set(found)


def test_query_against_all_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(queries.op12(spark, SMALL)) == expected(counted(map(tuple, docs)))


@pytest.mark.parametrize("pieces", [1, 2, 7, 40])
def test_ranges(spark, pieces):
    """Words that share their starts and ends across ranges, of one alphabet of few letters."""
    draw = random.Random(pieces)
    words = {"".join(draw.choice("abé\U0001F600") for _ in range(draw.randrange(0, 7))) for _ in range(500)}
    words |= {"a" * k for k in range(12)} | {"b" * 3000 + "a", "b" * 3000, "b" * 2999 + "aa", "", "aab", "aaab"}
    n = {w: draw.choice([3, 6, 6, 12, 30, 100]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n int")
    assert rows_of(word_variants.variants(df, pieces=pieces)) == expected(n)


def test_odd_documents(spark):
    rows = [(None, "Résumé résume RESUME"), (None, None), (5, ""), (6, "été " * 3), (6, "naïve Naïve naive " * 40),
            (7, "x" * 2000 + " ") , (8, "x" * 2000), (9, "x" * 2000 + " naives naïve"), (10, "ÀÉÎõü àéîõü " * 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "1 AS n", "2 AS rank")
    got = rows_of(word_variants.variants(queries.misspelt_words(df)))
    assert got == expected(counted(rows)) and got
    assert rows_of(word_variants.variants(queries.misspelt_words(df.limit(0)))) == set()


def test_very_long_words(spark):
    a = "xy" * 150_000
    rows = [(a, 9), (a[:-1], 3), (a[:100] + "z" + a[101:], 4), ("y" + a, 20), (a[1:] + "q", 5)]
    got = rows_of(word_variants.variants(spark.createDataFrame(rows, "word string, n int"), pieces=3))
    near_n = {r[0]: (r[4], r[5]) for r in got}
    # a is near its shorter, its changed and its longer form; "y" + a less its last letter is not in the list.
    assert [near_n[r[0]] for r in rows] == [(3, 20), (1, 9), (1, 9), (1, None), (0, None)]


def test_numbers_are_trie_nodes(spark):
    """A prefix has one number, a number one prefix, whatever the ranges."""
    words = sorted({f"{a}{b}{c}" for a in ("", "ab", "abc") for b in "xyz" for c in ("", "1", "12", "2")})
    df = spark.createDataFrame([(w, 1) for w in words], "key string, n long")
    seen = {}
    for r in word_variants.numbered(df, False, 9).collect():
        for k, node in enumerate(r["nodes"]):
            assert seen.setdefault(r["key"][:k], node) == node
        assert words[r["rank"]] == r["key"]
    assert len(set(seen.values())) == len(seen)
