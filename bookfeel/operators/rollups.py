"""Aggregations: per-book roll-up, counts, histograms, quantiles, record lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import fields, text
from .joins import skew_join

LIST_SIZE = 1000


def stable_bucket(c: Column, buckets: Column) -> Column:
    """Bucket number from an md5 prefix: the same in every engine and retry."""
    prefix = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(prefix, buckets)


def deal_parts(df: DataFrame, key: str, order_by: str, size: int, out: str) -> DataFrame:
    """Add the part of its group that a row falls into: 0 for a group of up to
    ``size`` rows, else one of ``ceil(rows / size)`` by a hash of ``order_by``.

    The long groups are stored, so that their true size decides how they are joined: mostly
    they are few and broadcast, otherwise hot keys are salted.
    """
    parts = F.ceil(F.col("_rows") / size)
    sizes = written(df.groupBy(key).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > size), "long-groups")
    keyless = sizes.filter(F.col(key).isNull()).agg(F.max(parts)).scalar()  # null matches no key
    dealt = skew_join(df, sizes.select(key, parts.alias("_parts")), key, "left", [order_by])
    parts = F.when(F.col(key).isNull(), keyless).otherwise(F.col("_parts"))
    return dealt.withColumn(
        out, F.when(parts > 1, stable_bucket(F.col(order_by), parts)).otherwise(0).cast("long")
    ).drop("_parts")


def collect_parts(
    df: DataFrame, key: str, order_by: str, fields_: list[str], out: str, size: int = LIST_SIZE
) -> DataFrame:
    """Group records into lists of bounded length.

    A group of up to ``size`` rows gives one list (``part`` 0). A larger group
    gives ``ceil(rows / size)`` lists, its rows dealt out by a hash of
    ``order_by``, so a hot group never meets in one task or one cell; together
    the parts hold every row. Lists are sorted by ``order_by``.
    """
    dealt = deal_parts(df, key, order_by, size, "part")
    entry = F.struct(order_by, *[f for f in fields_ if f != order_by])
    return dealt.groupBy(key, "part").agg(F.array_sort(F.collect_list(entry)).alias(out))


def distinct_in_order(df: DataFrame, key: str, value: str, order_by: str, out: str, size: int = LIST_SIZE) -> DataFrame:
    """``key, part, out``: the distinct values of each key by their first place in ``order_by``
    (equal places by value). Repeats go before anything is collected, over the whole key;
    more than ``size`` distinct values come in parts, each value in one of them."""
    first = df.groupBy(key, value).agg(F.struct(F.min(order_by).alias("at"), F.first(value).alias("value")).alias("_first"))
    parts = collect_parts(first.drop(value), key, "_first", ["_first"], "_entries", size)
    return parts.select(key, "part", F.transform("_entries", lambda e: e["_first"]["value"]).alias(out))


def keyed_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per key; nulls are skipped.

    Equal values are counted before the shuffle; the running count that follows
    streams through a sorted, spillable window.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts_quantiles(counts, key, value, "_n", probs)


def quantile_columns(value: str, n: str, cum: str, total: str, probs: dict[str, float]) -> list[Column]:
    """Aggregates picking each quantile from rows carrying running counts."""
    picked = []
    for name, p in probs.items():
        place = (F.col(total) - 1) * F.lit(p)

        def at(rank: Column) -> Column:
            covers = (F.col(cum) - F.col(n) <= rank) & (rank < F.col(cum))
            return F.max(F.when(covers, F.col(value)))

        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        picked.append((low + (high - low) * share).alias(name))
    return picked


def counts_quantiles(
    counts: DataFrame, key: str, value: str, n: str, probs: dict[str, float]
) -> DataFrame:
    """Quantiles per key from (key, value, count) rows."""
    by_key = Window.partitionBy(key)
    running = counts.withColumn("_cum", _running(F.col(n), by_key.orderBy(value))).withColumn(
        "_total", F.sum(n).over(by_key)
    )
    return running.groupBy(key).agg(*quantile_columns(value, n, "_cum", "_total", probs))


def _running(c: Column, window) -> Column:
    return F.sum(c).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def clean_reviews(reviews: DataFrame, min_words: int = 50) -> DataFrame:
    """Reviews with more than ``min_words`` words and their read duration."""
    kept = reviews.filter(text.longer_than(F.col("review_text"), min_words))
    start, end = fields.dump_date(F.col("started_at")), fields.dump_date(F.col("read_at"))
    return kept.withColumn("read_duration", fields.read_hours(start, end)).drop(
        "started_at", "read_at", "user_id", "date_added", "date_updated", "n_comments"
    )


def rollup_reviews(reviews: DataFrame, duration: str = "median") -> DataFrame:
    """Per book: review count, mean rating, summed votes, median (or mean)
    read duration. The texts are listed by :func:`review_lists`.

    Rows shrink to one per (book, duration) before the first shuffle. The second
    one carries these counts, ordered per book for the median.
    """
    pre = reviews.groupBy("book_id", "read_duration").agg(
        F.count("*").alias("_n"),
        F.sum("rating").alias("_rating"),
        F.count("rating").alias("_rated"),
        F.sum("n_votes").alias("_votes"),
    )
    # Null durations sort first and add nothing to the running count.
    by_book = Window.partitionBy("book_id")
    in_order = by_book.orderBy(F.asc_nulls_first("read_duration"))
    running = (
        pre.withColumn("_known", F.when(F.col("read_duration").isNotNull(), F.col("_n")).otherwise(0))
        .withColumn("_cum", _running(F.col("_known"), in_order))
        .withColumn("_total", F.sum("_known").over(by_book))
    )
    if duration == "median":
        value = quantile_columns("read_duration", "_known", "_cum", "_total", {"read_duration": 0.5})[0]
    else:
        value = (
            F.try_divide(F.sum(F.col("read_duration") * F.col("_known")), F.sum("_known"))
        ).alias("read_duration")
    return running.groupBy("book_id").agg(
        F.sum("_n").alias("n_reviews"),
        F.try_divide(F.sum("_rating"), F.sum("_rated")).alias("rating"),
        F.coalesce(F.sum("_votes"), F.lit(0)).alias("n_votes"),
        value,
    )


def review_lists(reviews: DataFrame, size: int = LIST_SIZE) -> DataFrame:
    """The review texts of each book as lists of bounded length, by review id."""
    lists = collect_parts(reviews, "book_id", "review_id", ["review_text"], "_entries", size)
    return lists.select("book_id", "part", F.col("_entries.review_text").alias("review_text"))


def remove_outliers_iqr(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of their group's quartiles."""
    from .joins import skew_join

    bounds = keyed_quantiles(df, key, value, {"_q1": 0.25, "_q3": 0.75})
    reach = (F.col("_q3") - F.col("_q1")) * 1.5
    bounds = bounds.select(
        key, (F.col("_q1") - reach).alias("_low"), (F.col("_q3") + reach).alias("_high")
    )
    return skew_join(df, bounds, key).filter(F.col(value).between(F.col("_low"), F.col("_high"))).drop(
        "_low", "_high"
    )


def country_counts(locations: DataFrame) -> DataFrame:
    """Books per country with the capital's coordinates."""
    return locations.filter("country is not null").groupBy("country").agg(
        F.min("capital_latlng").alias("capital_latlng"),
        F.countDistinct("book_id").alias("count_books"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(
        F.desc("count"), F.asc_nulls_first(column)
    )


def count_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def votes_per_review(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("review_id").agg(F.sum("n_votes").alias("n_votes")).orderBy(
        F.desc("n_votes"), F.asc("review_id")
    )


def most_reviewed(rollup: DataFrame, n: int) -> DataFrame:
    """The ``n`` books with the most reviews."""
    return rollup.select("book_id", "n_reviews").orderBy(F.desc("n_reviews"), F.asc("book_id")).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts in equal-width bins over the column's range; empty bins absent."""
    # One scan for both ends of the range.
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("r")).scalar()
    low, high = ends["lo"], ends["hi"]
    width = F.when(high > low, (high - low) / F.lit(float(bins))).otherwise(1.0 / bins)
    start = F.when(high > low, low.cast("double")).otherwise(low - 0.5)
    place = F.least(F.floor((F.col(column) - start) / width), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).select(place.cast("long").alias("bin")).groupBy("bin").agg(
        F.count("*").alias("count")
    )


def group_records(df: DataFrame, key: str, order_by: str, size: int = LIST_SIZE) -> DataFrame:
    """Rows of a key as lists of records, each list of bounded length."""
    others = [c for c in df.columns if c not in (key, order_by)]
    return collect_parts(df, key, order_by, others, "book_cards", size)


def share_of_max(df: DataFrame, column: str) -> DataFrame:
    """Whole per cent of the column's maximum (of 1 when no value is positive)."""
    top = df.agg(F.max(column)).scalar()
    share = F.col(column) / F.when(top > 0, top).otherwise(1) * 100
    return df.withColumn("share", share.cast("int").cast("long"))


def compare_models(similarities: DataFrame, ids: DataFrame, models: list[str]) -> DataFrame:
    """Neighbour lists of several models side by side for the given books, with
    the number of neighbours each pair of models shares."""
    chosen = similarities.join(ids.select("book_id"), "book_id", "left_semi")
    wide = chosen.groupBy("book_id").pivot("model", models).agg(F.first("similar_books"))
    for i, a in enumerate(models):
        for b in models[i + 1:]:
            wide = wide.withColumn(
                f"{a}_{b}_shared", F.size(F.array_intersect(a, b)).cast("long")
            )
    return wide
