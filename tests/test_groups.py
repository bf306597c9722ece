"""Joins and aggregations with hot keys, nulls and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bookfeel.operators import custom, joins, ordering, rollups, scaling, search
from bookfeel.sources import tables
from bookfeel.cluster import work_path


def bag(df):
    return sorted(df.collect(), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(no_broadcast, monkeypatch, how):
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    spark = no_broadcast
    # Key 1 holds most rows, 2 and 3 some, 4 has no partner, null is there too.
    keys = [1] * 3000 + [2] * 50 + [3] * 5 + [4] * 20 + [None] * 700
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (5, "e"), (None, "f")], "k int, w string")
    got = joins.skew_join(left, right, "k", how, ["v"])
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
    assert bag(got) == bag(left.join(right, "k", how).select(*got.columns))


@pytest.mark.parametrize("how", ["right", "full", "cross"])
def test_skew_join_refuses_other_joins(spark, how):
    df = spark.range(3).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        joins.skew_join(df, df, "k", how)


@pytest.mark.parametrize("most", [1, 1000])
def test_every_long_group_is_split(no_broadcast, monkeypatch, most):
    """Also when very many groups are long, and for rows without a key."""
    monkeypatch.setattr(joins, "TASK_ROWS", most)
    df = no_broadcast.range(12_000).select(
        F.when(F.col("id") % 300 > 0, F.col("id") % 300).alias("k"), F.col("id").alias("i"))
    lists = rollups.collect_parts(df, "k", "i", [], "e", size=10).select("k", "part", F.size("e").alias("n"))
    assert lists.agg(F.sum("n")).first()[0] == 12_000
    assert lists.groupBy("k").agg(F.max("part").alias("p")).filter("p < 1").count() == 0
    assert lists.agg(F.max("n")).first()[0] <= 40  # 10, up to the spread of the hash


def test_skew_join_spreads_a_hot_key(no_broadcast, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    left = no_broadcast.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    right = no_broadcast.createDataFrame([(1, "a")], "k int, w string")
    joined = joins.skew_join(left, right, "k", "inner", ["v"]).select(F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    assert sum(sizes) == 20000


def test_author_names(spark):
    refs = "book_id int, authors array<struct<author_id: string, role: string>>"
    books = spark.createDataFrame([(1, [("7", ""), ("5", "")]), (2, []), (3, [("5", ""), ("5", "")])], refs)
    names = spark.createDataFrame([(5, "Eve"), (7, "Zoe"), (7, "Ann")], "author_id long, name string")
    got = {r["book_id"]: r["author_names"] for r in joins.add_author_names(books, names).collect()}
    assert got == {1: ["Ann", "Eve"], 2: [], 3: ["Eve", "Eve"]}
    stray = spark.createDataFrame([(4, [("9", ""), ("5", "")])], refs)
    assert joins.add_author_names(stray, names, strict=False).first()["author_names"] == ["Eve"]
    with pytest.raises(Exception, match="no name for author 9"):
        joins.add_author_names(stray, names).collect()


def test_rollup_medians_and_sums(spark):
    rows = [
        (1, "a", 4, 1, 10.0), (1, "b", 2, -3, 20.0), (1, "c", 3, 0, None), (1, "d", 3, 0, 10.0), (1, "e", 3, 0, 40.0),
        (2, "f", 5, None, None), (3, "g", 1, 2, 7.5), (3, "h", 2, 2, 8.5),
    ]
    df = spark.createDataFrame(rows, "book_id int, review_id string, rating long, n_votes long, read_duration double")
    got = {r["book_id"]: tuple(r)[1:] for r in rollups.rollup_reviews(df).collect()}
    assert got == {1: (5, 3.0, -2, 15.0), 2: (1, 5.0, 0, None), 3: (2, 1.5, 4, 8.0)}
    mean = {r["book_id"]: r["read_duration"] for r in rollups.rollup_reviews(df, "mean").collect()}
    assert mean == {1: 20.0, 2: None, 3: 8.0}


def test_hot_group_is_listed_in_parts_and_stays_whole(spark):
    df = spark.createDataFrame([(1 if i % 3 else i, i, f"t{i}") for i in range(6000)], "k int, i int, t string")
    lists = rollups.collect_parts(df, "k", "i", ["t"], "e", size=100).cache()
    assert lists.agg(F.max(F.size("e"))).first()[0] < 200
    assert lists.filter("k = 1").count() == 40
    flat = lists.select("k", F.explode("e").alias("e")).select("k", "e.i", "e.t")
    assert bag(flat) == bag(df)
    assert all(r["e"] == sorted(r["e"]) for r in lists.limit(20).collect())


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(int(k), float(v)) for k, v in zip(rng.integers(0, 4, 3000), np.round(rng.lognormal(2, 2, 3000), 2))]
    df = spark.createDataFrame([*data, (1, None)], "k int, v double")
    probs = {"a": 0.25, "b": 0.5, "c": 0.9}
    for r in rollups.keyed_quantiles(df, "k", "v", probs).collect():
        mine = [v for k, v in data if k == r["k"]]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(np.quantile(mine, [0.25, 0.5, 0.9])))
    whole = scaling.column_quantiles(df.select("v", F.lit(5.0).alias("one")), ["v", "one"], probs).collect()
    got = {r["name"]: [r["a"], r["b"], r["c"]] for r in whole}
    assert got["v"] == pytest.approx(list(np.quantile([v for _, v in data], [0.25, 0.5, 0.9])))
    assert got["one"] == [5.0, 5.0, 5.0]


def test_order_codes_are_sorted_ranks(spark):
    words = [("x", f"w{i % 700:04d}") for i in range(2000)] + [("y", v) for v in ("b", "a", "c", "a")]
    got = ordering.order_codes(spark.createDataFrame(words, "g string, v string"), "g", "v").collect()
    for g in ("x", "y"):
        want = {v: i for i, v in enumerate(sorted({v for k, v in words if k == g}))}
        assert {r["v"]: r["code"] for r in got if r["g"] == g} == want


def test_one_hot_of_an_unseen_value_is_empty(spark):
    seen = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "book_id int, c string, d string")
    new = spark.createDataFrame([(3, "zz", "x"), (4, "a", "new")], "book_id int, c string, d string")
    fitted = scaling.fit_categorical(seen, ["c", "d"])
    got = {r["book_id"]: r["slots"] for r in scaling.apply_categorical(new, fitted, ["c", "d"]).collect()}
    assert got == {3: [3], 4: [0]}


def test_numeric_scaling_fills_with_the_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    params = scaling.fit_numeric(df, ["v"])
    assert params["v"]["mean"] == 2.0 and params["v"]["scale"] == pytest.approx((2 / 3) ** 0.5)
    assert [round(r[1], 6) for r in scaling.apply_numeric(df, params).collect()] == [-1.224745, 0.0, 1.224745]
    constant = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert scaling.fit_numeric(constant, ["v"])["v"]["scale"] == 1.0


EDITIONS = [
    (1, "A", [1, 2], 5, 9, "u1", 4.0), (2, "A", [1, 2], 8, 1, "u2", 3.0), (3, "B", [], 7, 1, None, 3.0),
    (4, "C", [], 6, 1, "u4", 5.0), (123, "D", [], 1, 1, "u5", 1.0), (5, "E", [123], 1, 2, "u6", 1.0),
]


def editions(spark):
    return spark.createDataFrame(
        EDITIONS, "book_id int, title string, similar_books array<long>, total_shelves_count int, ratings_count int, "
        "image_url string, average_rating double")


def test_editions(spark):
    kept = [r["book_id"] for r in search.dedupe_editions_guarded(editions(spark), None).collect()]
    assert kept == [2, 3, 4, 123, 5]  # an id never meets a one-element list
    assert {r["book_id"] for r in search.dedupe_editions(editions(spark)).collect()} == {2, 3, 5}


def test_edition_filter_limits_groups_before_the_shuffle(spark):
    for df in (search.dedupe_editions(editions(spark)), search.dedupe_editions_guarded(editions(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_order_by_resolution(spark):
    how = {1: "not_found", 2: "geocoded", 3: "direct_country", 4: "geocoded"}
    places = spark.createDataFrame(list(how.items()), "book_id int, resolved_as string")
    rows = search.order_by_resolution(places.join(editions(spark), "book_id")).collect()
    assert [r["book_id"] for r in rows] == [3, 2, 4, 1]


def test_title_wildcards_and_find(spark):
    base = editions(spark)
    assert [r["book_id"] for r in search.search_title(base, "a").collect()] == [2]
    assert search.search_title(base, "%").count() == 3
    assert search.find_book(base, "123").first()["title"] == "D"
    assert search.find_book(base, "999").count() == 0


def test_filter_without_criteria_is_empty(spark):
    features = spark.createDataFrame([(1, ["joy"])], "book_id int, emotions array<string>")
    assert search.filter_books(features, editions(spark), {}).count() == 0
    assert search.filter_books(features, editions(spark), {"emotions": []}).count() == 0
    assert [r[0] for r in search.filter_books(features, editions(spark), {"emotions": ["JOY"]}).collect()] == [1]


def test_append_unique_keeps_repeats_of_a_new_batch(spark):
    path = work_path(spark, "t")
    tables.append_unique(spark.createDataFrame([(1, "a"), (1, "b")], "book_id int, v string"), path)
    again = tables.append_unique(spark.createDataFrame([(1, "c"), (2, "d"), (2, "e")], "book_id int, v string"), path)
    assert bag(again) == bag(spark.createDataFrame([(1, "a"), (1, "b"), (2, "d"), (2, "e")], "book_id int, v string"))


def test_apply_groups_slices_a_hot_group(spark):
    df = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k int, i int")

    def rows(frame):
        return frame.assign(n=len(frame))[["k", "i", "n"]]

    got = custom.apply_groups(df, "k", rows, "k int, i int, n int", "i", size=100).collect()
    assert sorted(r["i"] for r in got) == list(range(1000))
    assert max(r["n"] for r in got) < 200


def test_apply_groups_hands_over_many_groups_at_once(spark):
    """Equal to a call a group through Spark, kinds of columns included, without an Arrow batch for each group."""
    df = spark.range(3000).selectExpr(
        "CASE WHEN id % 7 > 0 THEN id DIV 3 END AS k", "id AS i",
        "CASE WHEN id % 50 > 0 THEN id + 9007199254740993 END AS big", "CASE WHEN id % 60 > 0 THEN id % 2 = 0 END AS flag",
        "CASE WHEN id % 40 > 0 THEN CAST(id AS DOUBLE) END AS x", "CASE WHEN id % 30 > 0 THEN concat('s', id) END AS s")

    def told(frame):
        if frame["i"].sum() % 5 == 0:
            return frame.head(0).assign(said="", first=0)[["k", "i", "said", "first"]]
        ordered = frame.sort_values("i")
        said = repr([str(t) for t in frame.dtypes]) + repr(ordered.values.tolist()) + str(sorted(frame.index) == list(range(len(frame))))
        return frame.assign(said=said, first=int(frame["i"].min()))[["k", "i", "said", "first"]]

    schema = "k long, i long, said string, first long"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = bag(df.groupBy("k").applyInPandas(told, schema))
    try:
        for rows in ("10000", "7"):  # groups within a batch, and across several
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = custom.apply_groups(df, "k", told, schema, "i")
            assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
            assert bag(got) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_fold_groups_gives_one_answer(spark):
    """A group of 250,000 rows, small ones and the null key, against pandas."""
    class Moments:
        """Rows, sum and largest value: a small state of any number of rows."""

        def init(self):
            return 0, 0, None

        def update(self, state, frame):
            return self.merge(state, (len(frame), int(frame["v"].sum()), frame["v"].max()))

        def merge(self, one, other):
            return one[0] + other[0], one[1] + other[1], max(x for x in (one[2], other[2]) if x is not None)

        def finish(self, state):
            return pd.DataFrame({"n": [state[0]], "mean": [state[1] / state[0]], "top": [int(state[2])]})

    df = spark.range(251_000).selectExpr(
        "CASE WHEN id < 250000 THEN 7 WHEN id % 3 > 0 THEN id % 5 END AS k", "id * 31 % 1009 AS v", "id")
    got = custom.fold_groups(df, "k", Moments(), "n bigint, mean double, top bigint", "id", size=1000)
    want = df.toPandas().groupby("k", dropna=False)["v"].agg(["size", "mean", "max"])
    found = {None if r["k"] is None else r["k"]: (r["n"], pytest.approx(r["mean"]), r["top"]) for r in got.collect()}
    assert found == {None if np.isnan(k) else k: tuple(v) for k, v in zip(want.index, want.itertuples(index=False, name=None))}
    assert custom.fold_groups(df.limit(0), "k", Moments(), "n bigint, mean double, top bigint", "id").count() == 0


def test_distinct_in_order_over_a_whole_key(spark):
    df = spark.createDataFrame([(1, f"v{i * 7 % 30}", i) for i in range(900)] + [(2, "b", 5), (2, "a", 5), (2, "b", 1)],
                               "k int, v string, at int")
    got = rollups.distinct_in_order(df, "k", "v", "at", "values", size=1000).collect()
    assert {r["k"]: r["values"] for r in got} == {1: [f"v{i * 7 % 30}" for i in range(30)], 2: ["b", "a"]}
    parts = rollups.distinct_in_order(df, "k", "v", "at", "values", size=10).where("k = 1").collect()
    assert len(parts) == 3 and sorted(v for r in parts for v in r["values"]) == sorted({f"v{i}" for i in range(30)})


def test_quantiles_with_an_outlier(spark):
    values = [float(i % 1000) for i in range(20_000)] + [1e9]
    df = spark.createDataFrame([(v, None if v > 900 else v) for v in values], "a double, b double")
    found = {r["name"]: r for r in scaling.column_quantiles(df, ["a", "b"], {"q": 0.25, "m": 0.5, "h": 0.999}).collect()}
    for name, column in (("a", values), ("b", [v for v in values if v <= 900])):
        assert [found[name][p] for p in ("q", "m", "h")] == pytest.approx(list(np.quantile(column, [0.25, 0.5, 0.999])))


def test_size_subsets_by_rank(spark):
    df = spark.range(1, 2001).withColumnRenamed("id", "book_id").repartition(5)
    found = {r["subset"]: r["count"] for r in ordering.size_subsets(
        df, {"few": 3, "many": 1500, "more": 5000, "all": None}).groupBy("subset").count().collect()}
    assert found == {"few": 3, "many": 1500, "more": 2000, "all": 2000}
    assert ordering.size_subsets(df.limit(0), {"few": 3}).count() == 0
