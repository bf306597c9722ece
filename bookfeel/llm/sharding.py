"""Shards of near equal bytes by sampled splitters.

Records are ordered by a key of two parts: a hash of their group (equal texts in the
query), which lies evenly, then their id. Size-weighted key samples give splitters of
many fine ranges; ranges that turn out overfull, as under a very large group, are
subdivided by samples of their own. Exact bytes per range then give every record its
place in the whole order, and the places are cut into shards of equal bytes: a record
goes where its middle byte lies. A group smaller than ``whole`` of a shard stays in
one shard, a larger one may be cut between ids.

A null group or size counts as empty or 0. Null ids come first. Records equal in group
and id are told apart by no key: they stay in one range, are cut by place all the same,
and are interchangeable. An empty table gives an empty result. Columns named in
``keep`` are carried through; inner columns begin with ``_s_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written

RANGE_ROWS = 20_000  # rows aimed at in one range
LEAST_RANGES = 256
SAMPLES = 8  # per range
DEPTH = 4  # of subdividing
COARSE = 12  # bits of the hash that find the splitters near a key


def _draw(rows: DataFrame, rate: Column) -> DataFrame:
    """Keys drawn with a chance of size times ``rate``, by a hash and so repeatably."""
    chance = F.xxhash64("_s_hash", "_s_id", F.lit(11)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return rows.where(chance < F.col("_s_size") * rate)


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """``rows`` with ``_s_range``: how many splitters are at or before their key.

    Splitters are bounded in number (``SAMPLES`` by range); those that share the
    upper bits of a key are looked at, the count of those before comes along.
    """
    coarse = F.shiftright("_s_hash", 64 - COARSE)
    grouped = splitters.select(coarse.alias("_s_coarse"), "_s_hash", "_s_id").groupBy("_s_coarse").agg(
        F.sort_array(F.collect_list(F.struct("_s_hash", "_s_id"))).alias("_s_near"))
    every = splitters.sparkSession.range(-(1 << (COARSE - 1)), 1 << (COARSE - 1)).withColumnRenamed("id", "_s_coarse")
    before = F.sum(F.coalesce(F.size("_s_near"), F.lit(0))).over(
        Window.orderBy("_s_coarse").rowsBetween(Window.unboundedPreceding, -1))
    lookup = every.join(grouped, "_s_coarse", "left").select(
        "_s_coarse", "_s_near", F.coalesce(before, F.lit(0)).alias("_s_before"))
    key = F.struct("_s_hash", "_s_id")
    near = F.coalesce(F.size(F.filter("_s_near", lambda s: s <= key)), F.lit(0))
    return rows.withColumn("_s_coarse", coarse).join(F.broadcast(lookup), "_s_coarse").withColumn(
        "_s_range", F.col("_s_before") + F.greatest(near, F.lit(0))).drop("_s_coarse", "_s_near", "_s_before")


def _splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Keys that cut ``rows`` into about ``ranges`` parts of equal size, overfull parts again."""
    spark = rows.sparkSession
    share = total / ranges
    drawn = written(_draw(rows, F.lit(SAMPLES / share)).select("_s_hash", "_s_id").distinct(), "splitters")
    # Every SAMPLES-th key of the ordered sample; its size is bounded by SAMPLES per range.
    place = F.row_number().over(Window.orderBy("_s_hash", "_s_id"))
    chosen = written(drawn.withColumn("_s_n", place).where(F.col("_s_n") % SAMPLES == 0).drop("_s_n"), "splitters")
    for depth in range(1, DEPTH + 1):
        by_range = _ranged(rows, chosen)
        overfull = by_range.groupBy("_s_range").agg(
            F.sum("_s_size").alias("_s_bytes"), F.count("*").alias("_s_rows"),
            F.min(F.struct("_s_hash", "_s_id")).alias("_s_low"), F.max(F.struct("_s_hash", "_s_id")).alias("_s_high"),
        ).where(((F.col("_s_bytes") > 4 * share) | (F.col("_s_rows") > 4 * RANGE_ROWS))
                & (F.col("_s_low") != F.col("_s_high")))
        overfull = written(overfull.select("_s_range", "_s_bytes", "_s_rows"), "overfull")
        if overfull.isEmpty():
            break
        inside = by_range.join(F.broadcast(overfull), "_s_range")  # at most a quarter of the ranges
        rate = F.greatest(SAMPLES / F.lit(share), SAMPLES * F.col("_s_rows") / RANGE_ROWS / F.col("_s_bytes")) * depth
        more = _draw(inside, rate).select("_s_hash", "_s_id").distinct()
        place = F.row_number().over(Window.orderBy("_s_hash", "_s_id"))
        more = more.withColumn("_s_n", place).where(F.col("_s_n") % SAMPLES == 0).drop("_s_n")
        chosen = written(chosen.union(more).distinct(), "splitters")
    return chosen


def shard(records: DataFrame, group: Column, ident: Column, size: Column, shards: int,
          keep: dict[str, Column], whole: float = 0.02) -> DataFrame:
    """``keep`` columns with ``size``, ``shard`` (0 to ``shards`` - 1) and ``slot``: the
    place within the shard, without gaps from 0. ``ident`` must be an integer."""
    rows = written(records.select(
        *(c.alias(f"_s_k_{name}") for name, c in keep.items()),
        F.xxhash64(F.coalesce(group, F.lit(""))).alias("_s_hash"),
        F.coalesce(ident.cast("bigint"), F.lit(-(1 << 63))).alias("_s_id"),
        F.coalesce(size.cast("bigint"), F.lit(0)).alias("_s_size"),
    ), "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("_s_size"), F.lit(0)), F.count("*")).first()
    ranges = max(LEAST_RANGES, count // RANGE_ROWS)
    ranged = written(_ranged(rows, _splitters(rows, max(1, total), ranges)), "shard-ranges")

    upto = Window.orderBy("_s_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("_s_range").agg(F.sum("_s_size").alias("_s_bytes")).select(
        "_s_range", F.coalesce(F.sum("_s_bytes").over(upto), F.lit(0)).alias("_s_offset"))
    inside = Window.partitionBy("_s_range").orderBy("_s_hash", "_s_id")
    along = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("_s_at", F.coalesce(F.sum("_s_size").over(along), F.lit(0)))
        .join(F.broadcast(offsets), "_s_range").withColumn("_s_at", F.col("_s_at") + F.col("_s_offset"))
    )
    same = Window.partitionBy("_s_range", "_s_hash")  # a part of one range
    share = F.lit(max(1, total) / shards)
    bytes_ = F.sum("_s_size").over(same)
    middle = F.when(bytes_ <= whole * share, F.min("_s_at").over(same) + bytes_ / 2).otherwise(
        F.col("_s_at") + F.col("_s_size") / 2)
    cut = F.least(F.lit(shards - 1), F.floor(middle / share)).cast("int")
    cuts = written(placed.withColumn("_s_shard", cut), "shard-cuts")

    pieces = cuts.groupBy("_s_shard", "_s_range").agg(F.count("*").alias("_s_n"))  # ranges plus cuts at most
    earlier = Window.partitionBy("_s_shard").orderBy("_s_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("_s_shard", "_s_range", F.coalesce(F.sum("_s_n").over(earlier), F.lit(0)).alias("_s_first"))
    rank = F.row_number().over(Window.partitionBy("_s_range", "_s_shard").orderBy("_s_hash", "_s_id", "_s_at"))
    return cuts.withColumn("_s_rank", rank).join(F.broadcast(starts), ["_s_shard", "_s_range"]).select(
        *(F.col(f"_s_k_{name}").alias(name) for name in keep), F.col("_s_size").alias("size"),
        F.col("_s_shard").alias("shard"), (F.col("_s_first") + F.col("_s_rank") - 1).alias("slot"))


def write_shards(records: DataFrame, path: str, **how) -> None:
    """The records as files, one folder per shard, in slot order; ``how`` as in ``shard``."""
    shard(records, **how).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
