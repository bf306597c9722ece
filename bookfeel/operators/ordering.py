"""Sorting, first rows, size subsets, samples, top-k and distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import checkpointed

# The named subset sizes.
SUBSET_SIZES = {
    "10k": 10_000, "20k": 20_000, "50k": 50_000, "100k": 100_000, "150k": 150_000,
    "200k": 200_000, "all": None,
}


def sort_by_book(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Globally ordered by book when written: range partitions, sorted inside."""
    ranged = (
        df.repartitionByRange(partitions, "book_id") if partitions
        else df.repartitionByRange("book_id")
    )
    return ranged.sortWithinPartitions("book_id")


def first_n(df: DataFrame, n: int, keys: list[str | Column]) -> DataFrame:
    return df.orderBy(*keys).limit(n)


def size_subsets(df: DataFrame, sizes: dict[str, int | None], key: str = "book_id") -> DataFrame:
    """Every row once per subset it belongs to, the first N keys each.

    One cut-off key per size replaces repeated limits over wide rows; the copies
    are written with ``partitionBy('subset')``. The cut-offs are read off the ranks of
    the distinct keys, which range partitions give without one large sort.
    """
    ranks = order_codes(df.select(F.lit(0).alias("_all"), key).filter(F.col(key).isNotNull()), "_all", key)
    wanted = [n - 1 for n in sizes.values() if n is not None]
    cuts = {r["code"]: r[key] for r in ranks.filter(F.col("code").isin(wanted)).collect()}  # one row per size
    tags = []
    for name, n in sizes.items():
        if n is None or n - 1 not in cuts:  # all, or more than there are
            tags.append(F.lit(name))
        else:
            tags.append(F.when(F.col(key) <= F.lit(cuts[n - 1]), F.lit(name)))
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*tags))))


def sample_ids(df: DataFrame, n: int, seed: int = 42, key: str = "book_id") -> DataFrame:
    """``n`` ids drawn by a seeded hash; the same ones in every engine and run."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.select(key).distinct().orderBy(draw, key).limit(n)


def top_k_per_group(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def order_codes(values: DataFrame, group: str, value: str) -> DataFrame:
    """Code of each distinct value by its order within the group, from 0.

    Sorting is by range partition. Each row takes its place inside its own
    partition plus the rows of the group before it, known from one count per
    partition, so no group is ever sorted in one task. The ranged rows are
    checkpointed once: range bounds are sampled, and both passes must see the
    same ones.
    """
    ranged = checkpointed(
        values.select(group, value).distinct()
        .repartitionByRange(group, value)
        .sortWithinPartitions(group, value)
        .select(
            group, value, F.spark_partition_id().alias("_piece"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    pieces = ranged.groupBy(group, "_piece").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n")
    )
    before = F.sum("_n").over(
        Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and partition: bounded by the partition count.
    offsets = pieces.select(group, "_piece", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), [group, "_piece"]).select(
        group, value, (F.col("_place") - F.col("_first") + F.col("_before")).alias("code")
    )
