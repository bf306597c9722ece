"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import broadcast_limit, plan_bytes

# Rows of one key that a task should get at most. A table so large that more than
# MAX_HOT keys could exceed it gets a higher mark, which bounds the broadcast list
# of hot keys; the result is the same, the tasks are larger.
TASK_ROWS = 1_000_000
MAX_HOT = 200_000
NULL_SALTS = 500  # rows without a key match nothing and are only spread


def skew_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", spread: list[str] | None = None
) -> DataFrame:
    """Equi-join for a left side that may be skewed on ``key``.

    A right side whose estimated size is under Spark's own broadcast limit is
    joined plainly. Otherwise the rows of hot keys are spread over salts taken
    from a hash of ``spread`` (columns that differ between rows of one key) and
    the matching right rows are repeated once per salt. Nothing is dropped.

    The second way reads ``left`` twice (count, then join): give it a stored table
    or a cheap plan, and do not chain it. Right and full joins aren't offered: a
    repeated right row without a match would come back once per salt.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"skew_join has no {how} join")
    if plan_bytes(right) <= broadcast_limit(left.sparkSession):
        return _in_order(left, left.join(right, key, how), how)
    counts = left.groupBy(key).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    most = F.greatest(F.lit(TASK_ROWS), total / MAX_HOT)
    hot = counts.filter(F.col("_rows") > most).select(
        key, F.ceil(F.col("_rows") / most).cast("int").alias("_salts")
    )
    hot = F.broadcast(hot)  # at most MAX_HOT rows, see above
    spread_by = [c for c in (spread or left.columns) if c != key] or [key]
    salted = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_salts") > 1, F.pmod(F.xxhash64(*spread_by), F.col("_salts")))
        .when(F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(NULL_SALTS)))
        .otherwise(0).cast("int"),
    ).drop("_salts")
    repeated = right.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))
    ).drop("_salts")
    return _in_order(left, salted.join(repeated, [key, "_salt"], how).drop("_salt"), how)


def _in_order(left: DataFrame, joined: DataFrame, how: str) -> DataFrame:
    """Semi and anti joins give back the left columns in their own order."""
    return joined.select(*left.columns) if how in ("left_semi", "left_anti") else joined


def reviews_for_books(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Reviews whose book is among ``books``."""
    return skew_join(reviews, books.select("book_id"), "book_id", "left_semi", ["review_id"])


def add_book_features(rollup: DataFrame, books: DataFrame) -> DataFrame:
    """Book attributes onto the per-book review roll-up; both have one row per book."""
    return rollup.join(books, "book_id", "left")


def first_names(authors: DataFrame) -> DataFrame:
    """One name per author id: the first by name where ids repeat."""
    return authors.groupBy("author_id").agg(F.min("name").alias("name"))


def add_author_names(df: DataFrame, authors: DataFrame, strict: bool = True) -> DataFrame:
    """Ordered ``author_names`` in place of ``authors``.

    ``strict`` fails the job on an author id that has no name; otherwise such an
    entry is left out. Only (book, position, id) travels through the name join.
    """
    refs = df.select(
        "book_id", F.posexplode("authors").alias("pos", "ref")
    ).select("book_id", "pos", F.col("ref.author_id").cast("long").alias("author_id"))
    named = skew_join(refs, first_names(authors), "author_id", "left", ["book_id", "pos"])
    name = F.col("name")
    if strict:
        name = F.when(name.isNotNull(), name).otherwise(
            F.raise_error(F.concat(F.lit("no name for author "), F.col("author_id").cast("string")))
        )
    lists = (
        named.select("book_id", F.struct("pos", name.alias("name")).alias("entry"))
        .filter("entry.name is not null")
        .groupBy("book_id")
        .agg(F.array_sort(F.collect_list("entry")).alias("entries"))
        .select("book_id", F.col("entries.name").alias("author_names"))
    )
    return (
        df.drop("authors")
        .join(lists, "book_id", "left")
        .withColumn(
            "author_names", F.coalesce("author_names", F.array().cast("array<string>"))
        )
    )


def merge_features(tables: list[DataFrame], key: str = "book_id") -> DataFrame:
    """Inner join of the feature tables on the book. Merged, not broadcast: a stored table of
    labels is far smaller than its rows in memory."""
    return reduce(lambda a, b: a.join(b.hint("merge"), key), tables)


def only_new(df: DataFrame, done: DataFrame, key: str = "book_id") -> DataFrame:
    """Rows whose key is not among the processed ones."""
    return df.join(done.select(key), key, "left_anti").select(*df.columns)


def first_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key in ``order``.

    The rank filter becomes a group limit before the shuffle, so a hot key sends
    one row per input partition.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def extended(base: DataFrame, features: DataFrame, locations: DataFrame) -> DataFrame:
    """Model input: base, features and the first location of each book."""
    order = [F.col(c) for c in ("resolved_as", "country", "region") if c in locations.columns]
    place = first_per_key(locations, "book_id", order).select("book_id", "country", "region")
    return base.join(features, "book_id", "left").join(place, "book_id", "left")
