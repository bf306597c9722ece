"""The test tables as logical tables: lists of editions."""

from pyspark.sql import functions as F

from bookfeel.operators import search
from bookfeel.sources import driver_tables as d

# Keys that repeat, in one group and in two, a key without a value, and names without one.
PARTS = [
    (1, "a", "x"), (2, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "x"), (5, None, "x"), (6, None, None),
    (7, "c", "y"), (7, "d", "y"), (8, "d", "y"), (None, "a", "x"), (9, "", "x"),
]


def parts(spark, folder):
    rows = [(*p, "t", 1, 1.0) for p in PARTS]
    spark.createDataFrame(
        rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def expected():
    groups = {}
    for key, *group in PARTS:
        groups.setdefault(tuple(group), []).extend([key] if key is not None else [])
    listed = [(k, sorted(m) if len(m) > 1 else []) for m in groups.values() for k in m]
    books = []
    for key, *_ in PARTS:
        books += [(key, m) for k, m in listed if k == key] or [(key, None)]
    return listed, books


def test_lists_of_editions_with_repeated_and_missing_keys(spark, tmp_path):
    folder = parts(spark, tmp_path)
    listed, books = expected()
    got = d.editions(spark, folder)
    assert sorted(map(repr, [tuple(r) for r in got.collect()])) == sorted(map(repr, listed))
    got = d.books(spark, folder, "similar_books").select("book_id", "similar_books")
    assert sorted(map(repr, [tuple(r) for r in got.collect()])) == sorted(map(repr, books))


def test_lists_of_editions_are_joined_by_group_and_last(spark, tmp_path):
    """No list is repeated for each book before it has to be."""
    folder = parts(spark, tmp_path)
    spark.createDataFrame([(1, "N")], "l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    plan = d.books(spark, folder, "similar_books", "popular_shelves")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "_g_name" in joins[0] and not any("_g_name" in line for line in joins[1:])


def test_a_base_stored_for_feature_searches_holds_no_lists_of_editions(spark, tmp_path):
    """Rows as in the base, repeated keys too, in as much space a book however large its group."""
    from bookfeel.checks import searches

    folder = parts(spark, tmp_path)
    spark.createDataFrame([(1, "N")], "l_partkey long, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(8, "view", 2.0)], "event_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    _, base = searches.stored(spark, folder)
    assert "array<bigint>" not in dict(base.dtypes).values()
    want = d.base(spark, folder).drop("similar_books")
    assert base.columns == want.columns and sorted(map(repr, base.collect())) == sorted(map(repr, want.collect()))


def test_editions_are_grouped_by_a_short_key(spark):
    lists = spark.createDataFrame([([*range(5000)],), ([*range(5001)],), ([7],), ([],), (None,)], "s array<long>")
    keys = [r[0] for r in lists.select(search.list_key(F.col("s"))).collect()]
    assert len(set(keys)) == 5 and keys[-1] is None
    assert {len(k) for k in keys[:-1]} == {64}


def test_no_key_of_a_large_table_is_broadcast(spark, tmp_path):
    """Orders under the reviews and parts under the descriptions: their files are small, their keys in memory are not."""
    parts(spark, tmp_path)
    spark.range(9).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40).selectExpr(
        "id % 12 AS l_orderkey", "id % 5 AS l_partkey", "id AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber",
        "CAST(id AS DOUBLE) AS l_quantity", "DATE'1995-03-05' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE'1995-03-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    few = d.reviews(spark, str(tmp_path), text=False).select("book_id", "rating")
    described = d.descriptions(spark, str(tmp_path))
    for df in (few, described):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert few.count() == sum(i % 12 < 10 for i in range(40))
    assert sorted(r["book_id"] for r in described.collect()) == [1, 2, 2, 3, 4, 5, 6, 7, 7, 8, 9]
