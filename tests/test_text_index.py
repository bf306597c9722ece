"""Contains search by trigrams, and look-ups by key."""

import random

from pyspark.sql import functions as F

from bookfeel.checks import searches
from bookfeel.cluster import work_path
from bookfeel.operators import search, text_index
from bookfeel.sources import tables


def rows_read(df):
    """Rows that the scans of a collected query gave on."""
    def of(plan):
        if plan.nodeName() == "AdaptiveSparkPlan":
            return of(plan.executedPlan())
        if plan.nodeName().endswith("QueryStage"):
            return of(plan.plan())
        leaves = plan.collectLeaves()
        if leaves.size() == 1 and leaves.apply(0).equals(plan):
            return plan.metrics().apply("numOutputRows").value() if plan.nodeName().startswith("Scan") else 0
        return sum(of(leaves.apply(i)) for i in range(leaves.size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_patterns_against_a_scan(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PART", 20)
    draw = random.Random(0)
    rows = [(i, " ".join("".join(draw.choice("abcDé") for _ in range(4)) for _ in range(6)), i % 3) for i in range(400)]
    rows += [(400, None, 0), (401, "", 0), (402, "ab", 0), (403, "100% sure_thing", 0)]
    df = spark.createDataFrame(rows, "id long, t string, n int")
    index = text_index.build(df, work_path(spark, "index"), "id", "t", ["n"])
    assert index.texts.columns == ["id", "t", "n"]
    for p in ["abc", "ABC", "dé", "a b", "cab%bad", "a_c", "éda", "% ", "100%", "zzz", "abcd abcd abcd", "sure_thing", "", "bcd%a_c%dab"]:
        want = {r["id"] for r in df.filter(search.contains(F.col("t"), p)).collect()}
        assert {r["id"] for r in index.search(p).collect()} == want, p
    assert index.plan("ab") == index.plan("a_b%cd") == []
    assert len(index.plan("abcdabcé")) == text_index.ASKED
    empty = text_index.build(df.limit(0), work_path(spark, "index"), "id", "t")
    assert empty.search("abc").count() == 0


def test_postings_are_lists_where_the_texts_are_read(spark, monkeypatch):
    monkeypatch.setattr(text_index, "PART", 7)
    monkeypatch.setattr(text_index, "CHARS", 60)
    rows = [(f"k{i}", t) for i, t in enumerate(["Abcabc", "ab", None, "", "é\U0001F600x\U0001F600", "ABC abc", "a\nb\u0000c"] * 5 + ["x" * 200])] + [(None, "abc")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(2)
    found = text_index._postings(df, "k", "t")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    want, got = set(), []
    for k, t in rows:
        want |= {((t or "").lower()[i:i + 3], k) for i in range(len(t or "") - 2) if k}
    for r in found.collect():
        assert 0 < len(r["keys"]) <= 7
        got += [(r["gram"], k) for k in r["keys"]]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_question_reads_its_postings_only(spark):
    df = spark.range(60_000).selectExpr("id", "concat('title ', md5(CAST(id AS STRING))) AS t")
    index = text_index.build(df, work_path(spark, "index"), "id", "t")
    mark = df.where("id = 31234").first()["t"][10:30]
    hits = index.candidates(index.plan(mark))
    assert [r["id"] for r in hits.collect()] == [31234]
    postings = index._table("postings")
    assert rows_read(hits) < 0.25 * postings.count()
    found = index.search(mark)
    assert [r["id"] for r in found.collect()] == [31234]
    assert rows_read(found) <= 2000  # a page or two of 60,000 rows


def test_look_up_reads_one_group(spark):
    df = spark.range(200_000).selectExpr("id * 7 AS book_id", "sha2(CAST(id AS STRING), 256) AS title")
    stored = tables.write_keyed(df.repartition(6), work_path(spark, "books"), "book_id", group_bytes=1 << 20)
    one = search.get_book(stored.select("book_id", "title"), 70_007)
    assert [r["book_id"] for r in one.collect()] == ["70007"]
    assert rows_read(one) <= 2000
    assert search.get_book(stored, 70_008).collect() == []
    few = spark.createDataFrame([(7,), (8,), (1_399_993,)], "book_id long")
    assert sorted(r["book_id"] for r in tables.look_up(stored, "book_id", few).collect()) == [7, 1_399_993]
    many = spark.range(3000).selectExpr("id * 14 AS book_id")
    assert tables.look_up(stored, "book_id", many).count() == 3000


def test_the_title_index_holds_no_lists_of_editions(spark, tmp_path, monkeypatch):
    """Two groups of editions, one of them found by its titles, and single books."""
    parts = [(k, f"{'bored' if k % 2 else 'grey'} book", "Brand#1", "type", k) for k in range(60)]
    parts += [(100 + k, f"Red {k}", "Brand#2", "type", k) for k in range(4)] + [(200, None, None, None, 1), (None, "red none", "Brand#3", "type", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, flag) for k in (1, 3, 3, 101, 102, 102, 102) for flag in "AN"]
    spark.createDataFrame(lines, "l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, real = [], text_index.build
    monkeypatch.setattr(searches.text_index, "build", lambda df, *rest: kept.append(df.columns) or real(df, *rest))
    found = searches.search_title_index(spark, str(tmp_path))
    rows = [tuple(r) for r in found.collect()]
    assert kept and "similar_books" not in kept[0]
    # The group of the odd books once, all books that stand alone as one cluster.
    assert [r[0] for r in rows] == [102, 3]
    scanned = [tuple(r) for r in searches.search_title(spark, str(tmp_path)).collect()]
    assert [r for r in scanned if r[0] is not None] == rows
