"""Polarity against a plain loop, and how often its terms move."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bookfeel.operators import topics


def scored(rows, held_of):
    """Naive Bayes of each text by the texts outside the fold it holds out."""
    grams = [(i, t, f, Counter(text.split())) for i, text, t, f in rows]
    v, out = len({w for *_, c in grams for w in c}), {}
    for i, _, f, own in grams:
        seen = [g for g in grams if g[2] != held_of(f)]
        n = {t: Counter() for t in (0, 1)}
        for _, t, _, c in seen:
            n[t].update(c)
        k = {t: sum(n[t].values()) for t in (0, 1)}
        e = sum(m * (math.log((n[1][w] + 1) / (k[1] + v)) - math.log((n[0][w] + 1) / (k[0] + v))) for w, m in own.items())
        out[i] = int(e + math.log(sum(g[1] == 1 for g in seen) / sum(g[1] == 0 for g in seen)) > 0)
    return out


@pytest.mark.parametrize("other", [False, True])
def test_polarity_against_a_loop(spark, other):
    draw = random.Random(3)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rows = [(i, " ".join(draw.choice(words[t:t + 5]) for _ in range(draw.randrange(1, 9))), t, i % 3)
            for i, t in enumerate(draw.choice([0, 1]) for _ in range(60))]
    rows.append((99, "", 1, 0))
    df = spark.createDataFrame(rows, "id long, text string, target int, f long")
    held = (F.col("id") + 1) % 3 if other else None
    found = topics.polarity_scores(df, 1, F.col("f"), held)
    want = scored(rows, (lambda f: (f + 1) % 3) if other else (lambda f: f))
    assert {r["id"]: r["predicted"] for r in found.collect()} == want and len(set(want.values())) == 2


def test_terms_move_once(spark):
    df = spark.createDataFrame([(i, "good book " * (i % 4 + 1), i % 2) for i in range(40)], "id long, text string, target int")
    plan = topics.train_polarity(df, 2)._jdf.queryExecution().executedPlan().toString()
    # The rows, and the words of the vocabulary: a plan shows a sub-query wherever it is used.
    assert len(set(re.findall(r"hashpartitioning\((term#[^)]*)\)", plan))) <= 2
