"""Place recognition: decoding and slopes against all taggings, F1 on generated sentences; the name trie."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL

from bookfeel.checks import searches
from bookfeel.operators import places, recogniser as rc
from bookfeel.operators.name_trie import NameTrie, free_spans


def some_field(seed):
    draw = np.random.default_rng(seed)
    field = rc.Field.of(np.zeros(rc.SLOTS * 3 + 12))
    field.weights += draw.normal(size=field.weights.shape)
    field.steps += draw.normal(size=(3, 3))
    field.start += draw.normal(size=3)
    return field


@pytest.mark.parametrize("seed", range(5))
def test_against_all_taggings(seed):
    field = some_field(seed)
    slots = rc.features("She went to New York .".split()[:6 - seed % 3])
    own, steps = field.parts(slots)
    scores = {t: own[np.arange(len(t)), list(t)].sum() + sum(steps[a, b] for a, b in zip(t, t[1:]))
              for t in itertools.product(range(3), repeat=len(slots))}
    assert tuple(field.decode(slots)) == max(scores, key=scores.get)
    whole, tag, pairs = field.marginals(slots)
    total = np.log(np.sum(np.exp(list(scores.values()))))
    assert whole == pytest.approx(total)
    for i in range(len(slots)):
        for k in range(3):
            assert tag[i, k] == pytest.approx(sum(np.exp(s - total) for t, s in scores.items() if t[i] == k), abs=1e-9)
    assert pairs.sum() == pytest.approx(len(slots) - 1)


def test_slope_numerically():
    field, slots, tags = some_field(9), rc.features("They left Oslo for Cape Town".split()), np.array([0, 0, 1, 0, 1, 2])
    after = rc.Field.of(field.flat())
    after.step(slots, tags, 1.0)
    slope = field.flat() - after.flat()
    places_ = [*(slots[2] * 3 + 1), *(slots[5] * 3 + 2), *range(rc.SLOTS * 3, rc.SLOTS * 3 + 12)]
    for i in places_:
        flat = field.flat()
        flat[i] += 1e-5
        up = rc.Field.of(flat).loss(slots, tags)
        flat[i] -= 2e-5
        assert slope[i] == pytest.approx((up - rc.Field.of(flat).loss(slots, tags)) / 2e-5, abs=1e-5)


def sentences(n, names, seed):
    draw = random.Random(seed)
    people, things = ["Ann", "Bo Lee", "Doctor Kay"], ["Honda", "Linux", "Monday", "bread"]
    shapes = ["{p} moved to {n} .", "{p} was born in {n} and likes {t} .", "From {n} to {n} , {p} carried {t} .", "{p} sold {t} .",
              "Near {n} they met {p} .", "On {t} {p} slept ."]
    out = []
    for _ in range(n):
        words, tags = [], []
        for piece in draw.choice(shapes).split():
            if piece == "{n}":
                name = draw.choice(names).split()
                words, tags = words + name, tags + [1] + [2] * (len(name) - 1)
            else:
                more = draw.choice(people if piece == "{p}" else things).split() if piece in ("{p}", "{t}") else [piece]
                words, tags = words + more, tags + [0] * len(more)
        out.append((words, tags))
    return out


def test_f1_on_unseen_names(spark):
    seen = ["Paris", "New York", "Oslo", "Cape Town", "San Jose del Cabo", "Lima", "Kyoto", "Port Said", "Costa de Oro", "Villa del Mar", "Cruz de Malta"]
    unseen = ["Berlin", "Los Angeles", "Quito", "Rio de Janeiro"]
    rows = spark.createDataFrame(sentences(800, seen, 1), "words array<string>, tags array<int>").repartition(3)
    field = rc.fit(places.written(rows, "sentences"))
    test = sentences(300, unseen, 2)
    df = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(test)], "book_id int, text string")
    found = {r["book_id"]: r["entities"] for r in places.extract_entities(df, "text", rc.entity_model(field)).collect()}
    hits = got = want = 0
    for i, (words, tags) in enumerate(test):
        true = {(" ".join([words[k]] + [w for w, _ in itertools.takewhile(lambda x: x[1] == 2, zip(words[k + 1:], tags[k + 1:]))]))
                for k, t in enumerate(tags) if t == 1}
        mine = {e["word"] for e in found[i]}
        hits, got, want = hits + len(true & mine), got + len(mine), want + len(true)
        assert all(0 < e["score"] <= 1 + 1e-9 for e in found[i])
    f1 = 2 * hits / (got + want)
    print("F1", f1)
    assert f1 > 0.9
    assert rc.recognise(field, "") == [] and rc.recognise(field, "word " * 3000) == []
    assert rc.fit(rows.limit(0)).weights.any() == False  # noqa: E712


def test_trie_against_all_runs(spark):
    draw = random.Random(4)
    names = [[draw.choice("abcd") for _ in range(draw.randrange(1, 5))] for _ in range(12)]
    trie = NameTrie.of(names)
    texts = [[draw.choice("abcde") for _ in range(draw.randrange(0, 30))] for _ in range(60)]
    flat, row = [w for t in texts for w in t], np.repeat(range(60), [len(t) for t in texts])
    after = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    length = trie.longest(pa.array(flat, pa.string()), after)
    spans, at = [], 0
    for r, t in enumerate(texts):
        mine = []
        for i in range(len(t)):
            n = max((len(x) for x in names if t[i:i + len(x)] == x), default=0)
            assert length[at + i] == n
            if n and not any(i + n <= e for e in mine):
                spans.append(at + i)
            if n:
                mine.append(i + n)
        at += len(t)
    assert free_spans(length, row).tolist() == spans
    # Both ways of the extractor agree.
    rows = [(i, " ".join(t) + ("." if i % 2 else "")) for i, t in enumerate(texts)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, "book_id int, t string")
    listed = spark.createDataFrame([(" ".join(n).upper(),) for n in names] + [(None,), ("!",)], "name string")
    held, joined = (
        {r["book_id"]: [tuple(e) for e in r["entities"]] for r in places.known_place_entities(df, "t", listed, name_words=n).collect()}
        for n in (1000, 3))
    assert held == joined and any(held.values()) and held[99] == held[98] == []


def test_texts_are_decoded_side_by_side(monkeypatch):
    """A batch gives what each text gives alone, and what each sentence's own marginals say, in few steps."""
    draw, field = random.Random(3), some_field(2)
    texts = [" ".join(draw.choice(["Oslo", "went", "to", "New", "York", "x7", "It."]) for _ in range(draw.randrange(0, 40))) for _ in range(60)]
    texts += ["", " \n", "Lima " * 900, "One. Two\nThree"]
    decoded, real = [], rc.Field.decode_all

    def counted(self, sentences):
        decoded.append(len(sentences))
        return real(self, sentences)

    monkeypatch.setattr(rc.Field, "decode_all", counted)
    monkeypatch.setattr(rc, "MANY", 1000)
    together = rc.entity_model(field)()(texts)
    assert len(decoded) <= 4 and sum(decoded) > 100
    for text, found in zip(texts, together):
        alone = rc.recognise(field, text)
        assert [e["word"] for e in alone] == [e["word"] for e in found]
        assert [e["score"] for e in alone] == pytest.approx([e["score"] for e in found])
    slots = rc.features("Ann left New York for Oslo".split())
    tags, chances = real(field, [slots[:2], slots, slots[:1]])[1]
    assert tags.tolist() == field.decode(slots).tolist()
    assert chances.tolist() == pytest.approx(field.marginals(slots)[1][np.arange(6), tags].tolist())


def test_sentences_of_a_small_file_are_read_on_all_cores(spark, monkeypatch):
    parts, real = [], places.extract_entities

    def extract(df, *rest):
        parts.append(df.rdd.getNumPartitions())
        return real(df, *rest)

    monkeypatch.setattr(places, "extract_entities", extract)
    assert tuple(searches.recognise_places(spark, SMALL).first())[1:] == (1, 1)
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_sentences_side_by_side_take_the_mean_step_of_each_weight():
    texts = ["Ann left Oslo", "She went to New York .", "Bo", "They left Oslo for Cape Town", "x"]
    tagged = [[0, 0, 1], [0, 0, 0, 1, 2, 0], [0], [0, 0, 1, 0, 1, 2], [1]]
    coded, before, after = [rc.features(t.split()) for t in texts], some_field(4), some_field(4)
    after.step_all(np.concatenate(coded), np.concatenate(tagged), np.array([len(t) for t in tagged]), 0.5)
    slopes, held = np.zeros_like(before.weights), np.zeros(rc.SLOTS)
    steps, start = np.zeros((3, 3)), np.zeros(3)
    for slots, tags in zip(coded, tagged):
        alone = some_field(4)
        alone.step(slots, np.array(tags), 0.5)
        slopes += before.weights - alone.weights
        held[np.unique(slots)] += 1
        steps, start = steps + before.steps - alone.steps, start + before.start - alone.start
    assert np.allclose(before.weights - after.weights, slopes / np.maximum(held, 1)[:, None])
    assert np.allclose(before.steps - after.steps, steps / 3) and np.allclose(before.start - after.start, start / 5)


def test_the_recogniser_is_trained_on_all_customers(spark, tmp_path, monkeypatch):
    customers = [(k, "HOUSEHOLD", k % 7) for k in range(2990, 3010)]
    spark.createDataFrame(customers, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"NATION {k}") for k in range(7)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    seen, real = [], rc.fit
    monkeypatch.setattr(rc, "fit", lambda rows: seen.append({r["c_custkey"] for r in rows.collect()}) or real(rows))
    assert searches.recognise_places(spark, str(tmp_path)).first()["sentences"] == 20
    assert seen == [{k for k, _, nation in customers if nation % 5}]


def test_runs_of_words_move_a_few_times_only(spark):
    texts = [(i, f"Common words, all alike; {'Rare' if i % 20 < 3 else 'odd'}{i // 20} end") for i in range(60)]
    texts += [(0, "common Again"), (None, "again nobody"), (None, "rare0"), (61, ""), (62, None), (63, "one")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["name"]) for r in places.word_runs(df, "text", "doc_id", 3, 4).collect()]
    want = {}
    for key, text in texts:
        words = text.lower().replace(",", "").replace(";", "").split() if text else []
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                want.setdefault(" ".join(words[i:i + n]), set()).add(key)
    assert len(got) == len(set(got))
    for name, keys in want.items():
        mine = {k for k, x in got if x == name}
        assert mine <= keys and len(mine) == min(4, len(keys)), name
    assert {x for _, x in got} == set(want) and len(want["common words"]) == 60
