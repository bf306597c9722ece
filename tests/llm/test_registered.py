"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SMALL
from test_table_operators import water_fill

import __spark_entry__ as entry
import corpus_pipeline
from bookfeel.cluster import written
from bookfeel.llm import bpe, near_text, queries, registry

KEYS = {"op1": "documents", "op2": "documents", "op3": "documents", "op4": "documents", "op5": "pages", "op6": "pages",
        "op7": "documents", "op8": "documents", "op9": "documents", "op10": "embeddings",
        "op11": "conversations", "op13": "documents"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_row_comes_back(spark, name):
    df = entry.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name.startswith("op12"):  # its rows are words
        return
    table = spark.read.parquet(f"{SMALL}/{KEYS[name.split('_')[0]]}.parquet")
    key = table.columns[0]
    if name.startswith("op11"):  # one row a conversation
        table = table.select(key).distinct()
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())


def test_vectors_against_sql(spark):
    from compare import duck

    rows = entry.queries()["op10_near_vectors"](spark, SMALL).collect()
    found = duck(SMALL).execute(entry.oracle_sql()["op10_near_vectors"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(found)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "mix", "encode"]
    stage = corpus_pipeline.classify(spark, docs, SMALL)
    assert stage.columns == docs.columns and 0.7 * len(ids) < stage.count() < len(ids)
    stage = corpus_pipeline.deduplicate(spark, docs, SMALL)
    assert stage.columns == docs.columns
    kept = {r["doc_id"] for r in entry.queries()["op7_near_text"](spark, SMALL).where("kept").collect()}
    assert {r["doc_id"] for r in stage.collect()} == kept
    out = entry.queries()["pipeline"](spark, SMALL)
    assert {r["doc_id"] for r in out.collect()} <= ids


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on what the one before kept: held-out accuracy, all pairs, shared targets, the library."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()}
    kept = written(corpus_pipeline.classify(spark, docs, SMALL), "kept")
    rows = kept.orderBy("doc_id").collect()
    ids = {r["doc_id"] for r in rows}
    unseen = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(unseen) > 15 and sum((i in ids) == bool(labels[i]) for i in unseen) >= 0.9 * len(unseen)

    # One document of each group linked at 0.8, by all pairs.
    texts = [r["text"] or "" for r in rows]
    df = Counter(w for x in texts for w in set(near_text.words(x).tolist()))
    many = {w: c for w, c in df.items() if c > len(texts) / near_text.RARE}
    idf = near_text.Idf(np.array(list(many), np.uint64), np.array(list(many.values()), float), len(texts))
    sets = [near_text.shingles(near_text.words(x), idf) for x in texts]
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and near_text.similarity(sets[i], sets[j]) >= 0.8:
                lead[root(i)] = root(j)
    single = written(corpus_pipeline.deduplicate(spark, kept, SMALL), "single")
    left = single.collect()
    group = {r["doc_id"]: root(i) for i, r in enumerate(rows)}
    assert sorted(group[r["doc_id"]] for r in left) == sorted(set(group.values())) and len(left) < len(rows)

    # Words by source come near the shared targets; nothing is taken more than three times.
    def n_words(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    size, longest = Counter(), max(n_words(r["text"]) for r in left)
    for r in left:
        size[r["source"]] += n_words(r["text"])
    mixed = written(corpus_pipeline.mix(spark, single, SMALL), "mixed")
    found, times = Counter(), Counter()
    for r in mixed.collect():
        found[r["source"]] += n_words(r["text"])
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3 and set(times) <= {r["doc_id"] for r in left}
    assert all(abs(found[s] - t) <= longest for s, t in water_fill(dict(size)).items())

    # The whole pipeline: these documents as often, encoded as the library does.
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(queries.vocabulary("byte_bpe_50k.tiktoken")))
    text = {r["doc_id"]: r["text"] or "" for r in left}
    out = entry.queries()["pipeline"](spark, SMALL).collect()
    assert Counter(r["doc_id"] for r in out) == times
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(text[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_repeated_bytes_against_sql(spark):
    from compare import difference, duck

    name = "op13_repeated_bytes"
    assert difference(entry.queries()[name](spark, SMALL), duck(SMALL), entry.oracle_sql()[name]) is None


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
