"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source, its documents in shuffled order, form a stream that is cut
into blocks of equal size. Slot ``k`` of the schedule takes the golden-ratio point
``frac(k * phi)`` through the cumulative shares of the sources, laid out by code point
(so that the schedule is one however the rows are partitioned); the slots of a source
are ranked and the ``j``-th takes its ``j``-th block, going round again (in another
order) where the target exceeds the source. Slots that the points give beyond a
source's need stay unused, the few they fall short by are added at their ideal place.

Weights go round 1, 2, 3 over the sources by code point, null last. Targets share the
size of all documents by weight; one that exceeds ``most`` times its source stops
there and the excess is shared again. No document is taken more than ``most`` times.

Null texts have size 0 and are never taken. Repeated rows count as often as they
occur. An empty table gives an empty result. Kept columns travel in a struct, so their
names clash with none; ``taken`` replaces columns of the names that it returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..operators.ordering import order_codes

BLOCK = 256  # words
GOLDEN = 0.6180339887498949
CELLS = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


@dataclass
class Mix:
    rows: DataFrame  # the documents in _m_kept, numbered in _m_row, with _m_source and _m_size
    sources: DataFrame  # _m_source, _m_source_size, _m_target, _m_take (whole words), _m_blocks ...
    segments: DataFrame  # _m_row by block: _m_block, _m_from (in the block), _m_words
    slots: DataFrame  # _m_slot, _m_source, _m_epoch, _m_block, _m_part (words of the block taken)


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Number (``_m_id``, by code point, null last), weight and target per row of
    ``_m_source, _m_source_size``, one row per source."""
    named = sizes.where("_m_source IS NOT NULL").select(F.lit(0).alias("_m_all"), "_m_source")
    codes = order_codes(named, "_m_all", "_m_source").select("_m_source", "code")
    rank = F.coalesce("code", sizes.where("_m_source IS NOT NULL").agg(F.count("*")).scalar())
    weighed = written(sizes.join(codes, "_m_source", "left").select(
        "_m_source", "_m_source_size", rank.cast("bigint").alias("_m_id"),
        (1 + rank % 3).cast("double").alias("_m_weight")), "mix-weights")
    total = weighed.agg(F.coalesce(F.sum("_m_source_size"), F.lit(0))).first()[0]
    full, level, before = most * F.col("_m_source_size"), 0.0, -1.0
    while level != before:  # each round caps a source more, or ends
        capped, before = full < F.lit(level) * F.col("_m_weight"), level
        used, free = weighed.agg(
            F.coalesce(F.sum(F.when(capped, full)), F.lit(0)), F.sum(F.when(~capped, F.col("_m_weight")))).first()
        level = (total - used) / free if free else before
    target = F.least(full.cast("double"), F.lit(level) * F.col("_m_weight"))
    return weighed.withColumn("_m_target", target)


def _streamed(rows: DataFrame) -> DataFrame:
    """``_m_row, _m_source, _m_size, _m_at``: the words of the source before the row, in
    shuffled order. Running sums are taken inside range partitions, so that no source
    is summed in one task; one row per partition and source carries them on."""
    ranged = rows.select("_m_row", "_m_source", "_m_size", F.xxhash64("_m_tie", F.lit(5)).alias("_m_order")) \
        .repartitionByRange("_m_source", "_m_order", "_m_row").sortWithinPartitions("_m_source", "_m_order", "_m_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            out, sizes = [], batch.column("_m_size").to_pylist()
            for source, size in zip(batch.column("_m_source").to_pylist(), sizes):
                at = at if source == last else 0
                out.append(at)
                at, last = at + size, source
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_m_row", "_m_source", "_m_size")]
                + [pa.array(np.full(len(out), piece, np.int32)), pa.array(out, pa.int64())],
                names=["_m_row", "_m_source", "_m_size", "_m_piece", "_m_inside"])

    kind = rows.schema["_m_source"].dataType.simpleString()
    placed = written(ranged.mapInArrow(
        run, f"_m_row bigint, _m_source {kind}, _m_size bigint, _m_piece int, _m_inside bigint"), "mix-stream")
    before = Window.partitionBy("_m_source").orderBy("_m_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_m_source", "_m_piece").agg(F.sum("_m_size").alias("_m_n")).select(
        F.col("_m_source").alias("_m_s"), F.col("_m_piece").alias("_m_p"),
        F.coalesce(F.sum("_m_n").over(before), F.lit(0)).alias("_m_offset"))
    return placed.join(offsets, (F.col("_m_piece") == F.col("_m_p")) & F.col("_m_source").eqNullSafe(F.col("_m_s"))) \
        .select("_m_row", "_m_source", "_m_size", (F.col("_m_offset") + F.col("_m_inside")).alias("_m_at"))


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots with the source, epoch and block that each takes."""
    n_slots, n_sources = sources.agg(F.coalesce(F.sum("_m_slots"), F.lit(0)), F.count("*")).first()
    cells = max(CELLS, n_sources)
    upto = Window.orderBy("_m_id").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    shares = sources.where("_m_slots > 0").withColumn("_m_to", F.sum("_m_slots").over(upto))
    shares = shares.select(
        "_m_id", "_m_slots", ((F.col("_m_to") - F.col("_m_slots")) / max(1, n_slots)).alias("_m_low"),
        (F.col("_m_to") / max(1, n_slots)).alias("_m_high"))
    by_cell = shares.withColumn("_m_cell", F.explode(F.sequence(
        F.floor(F.col("_m_low") * cells), F.floor(F.col("_m_high") * cells))))
    point = F.col("_m_slot") * GOLDEN - F.floor(F.col("_m_slot") * GOLDEN)
    drawn = sources.sparkSession.range(n_slots).withColumnRenamed("id", "_m_slot").withColumn("_m_point", point) \
        .withColumn("_m_cell", F.floor(F.col("_m_point") * cells)).join(by_cell, "_m_cell") \
        .where("_m_point >= _m_low AND _m_point < _m_high").select("_m_slot", "_m_id")

    # Ranks by chunks of slots: no source is ranked in one task.
    chunk = max(1024, int(n_slots ** 0.5))
    drawn = written(drawn.withColumn("_m_chunk", F.floor(F.col("_m_slot") / chunk)), "mix-slots")
    before = Window.partitionBy("_m_id").orderBy("_m_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("_m_id", "_m_chunk").agg(F.count("*").alias("_m_n"))
    offsets = counts.withColumn("_m_before", F.coalesce(F.sum("_m_n").over(before), F.lit(0))).drop("_m_n")
    rank = F.row_number().over(Window.partitionBy("_m_chunk", "_m_id").orderBy("_m_slot")) - 1
    ranked = drawn.withColumn("_m_rank", rank).join(offsets, ["_m_chunk", "_m_id"]).select(
        "_m_slot", "_m_id", (F.col("_m_rank") + F.col("_m_before")).alias("_m_j"))

    had = counts.groupBy("_m_id").agg(F.sum("_m_n").alias("_m_had"))
    short = shares.join(had, "_m_id", "left").withColumn("_m_had", F.coalesce("_m_had", F.lit(0))).where("_m_had < _m_slots")
    added = short.withColumn("_m_j", F.explode(F.sequence(F.col("_m_had"), F.col("_m_slots") - 1))).select(
        F.floor((F.col("_m_j") + 0.5) / F.col("_m_slots") * n_slots).alias("_m_slot"), "_m_id", "_m_j")

    whole = F.floor(F.col("_m_take") / F.greatest(F.col("_m_source_size"), F.lit(1)))  # epochs taken whole
    epoch = F.floor(F.col("_m_j") / F.col("_m_blocks"))
    turned = F.when(F.col("_m_epoch") < whole, F.col("_m_epoch") * 7919).otherwise(0)
    length = F.least(F.lit(block), F.col("_m_source_size") - F.col("_m_block") * block)
    rest = F.col("_m_take") - whole * F.col("_m_source_size") - F.col("_m_block") * block
    return ranked.unionByName(added).join(sources, "_m_id").where("_m_j < _m_slots") \
        .withColumn("_m_epoch", epoch) \
        .withColumn("_m_block", (F.col("_m_j") % F.col("_m_blocks") + turned) % F.col("_m_blocks")) \
        .withColumn("_m_part", F.when(F.col("_m_epoch") < whole, length).otherwise(F.least(length, rest))) \
        .select("_m_slot", "_m_id", "_m_epoch", "_m_block", "_m_part", length.alias("_m_length"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id",
        most: int = 3, block: int = BLOCK, keep: list[str] | None = None) -> Mix:
    """Plan the mix of ``docs``; ``keep`` names the columns to carry (all by default)."""
    rows = written(docs.select(
        F.struct(*(docs.columns if keep is None else keep)).alias("_m_kept"),
        F.monotonically_increasing_id().alias("_m_row"),
        F.col(source).alias("_m_source"), word_count(F.col(text)).alias("_m_size"),
        F.xxhash64(key, text).alias("_m_tie"),
    ), "mix-rows")
    sizes = rows.groupBy("_m_source").agg(F.sum("_m_size").alias("_m_source_size"))
    take = F.least(F.round("_m_target").cast("bigint"), most * F.col("_m_source_size"))
    blocks = F.ceil(F.col("_m_source_size") / block)
    whole = F.floor(F.col("_m_take") / F.greatest(F.col("_m_source_size"), F.lit(1)))
    slots = whole * F.col("_m_blocks") + F.ceil((F.col("_m_take") - whole * F.col("_m_source_size")) / block)
    sources = written(
        targets(sizes, most).withColumn("_m_take", take).withColumn("_m_blocks", blocks).withColumn("_m_slots", slots),
        "mix-sources")
    at, last = F.col("_m_at"), F.col("_m_at") + F.col("_m_size")
    streamed = _streamed(rows.where("_m_size > 0"))
    begin = F.greatest(at, F.col("_m_block") * block)
    ids = sources.select(F.col("_m_source").alias("_m_s"), "_m_id")
    segments = streamed.join(ids, F.col("_m_source").eqNullSafe(F.col("_m_s"))) \
        .withColumn("_m_block", F.explode(F.sequence(F.floor(at / block), F.floor((last - 1) / block)))) \
        .select("_m_row", "_m_id", "_m_block", (begin - F.col("_m_block") * block).alias("_m_from"),
                (begin - at).alias("_m_word"),
                (F.least(last, (F.col("_m_block") + 1) * block) - begin).alias("_m_words"))
    return Mix(rows, sources, written(segments, "mix-segments"), written(_schedule(sources, block), "mix-schedule"))


def _rounds(plan: Mix) -> DataFrame:
    """Per block: how often it is taken whole, and the words taken in the last, cut round."""
    whole = F.col("_m_part") >= F.col("_m_length")
    return plan.slots.groupBy("_m_id", "_m_block").agg(
        F.count(F.when(whole, 1)).alias("_m_times"),
        F.coalesce(F.max(F.when(~whole, F.col("_m_part"))), F.lit(0)).alias("_m_cut"))


def taken(plan: Mix) -> DataFrame:
    """The documents with ``source_size``, ``target``, ``size`` and ``taken`` words."""
    words = F.col("_m_words") * F.col("_m_times") + F.greatest(
        F.lit(0), F.least(F.col("_m_words"), F.col("_m_cut") - F.col("_m_from")))
    sums = plan.segments.join(_rounds(plan), ["_m_id", "_m_block"]).groupBy("_m_row").agg(F.sum(words).alias("_m_taken"))
    per = plan.sources.select(F.col("_m_source").alias("_m_s"), "_m_source_size", "_m_target")
    kept = [F.col(f"_m_kept.{c}") for c in plan.rows.schema["_m_kept"].dataType.names
            if c not in ("size", "source_size", "target", "taken")]
    return plan.rows.join(sums, "_m_row", "left").join(per, F.col("_m_source").eqNullSafe(F.col("_m_s"))).select(
        *kept, F.col("_m_size").alias("size"), F.col("_m_source_size").alias("source_size"),
        F.col("_m_target").alias("target"), F.coalesce("_m_taken", F.lit(0)).cast("bigint").alias("taken"))


def sequence(plan: Mix, key: str = "doc_id") -> DataFrame:
    """The mix itself, ordered by ``slot``, ``source``, ``from_word``: which words of
    which document come when."""
    words = F.least(F.col("_m_words"), F.col("_m_part") - F.col("_m_from"))
    parts = plan.slots.join(plan.segments, ["_m_id", "_m_block"]).where(words > 0)
    return parts.join(plan.rows.select("_m_row", f"_m_kept.{key}", F.col("_m_source").alias("source")), "_m_row").select(
        F.col("_m_slot").alias("slot"), "source", F.col("_m_epoch").alias("epoch"), F.col("_m_block").alias("block"),
        key, F.col("_m_word").alias("from_word"), words.alias("words"))


def repeated(plan: Mix) -> DataFrame:
    """Whole documents as often as the mix takes their middle word; texts without words
    cost nothing and stay once. A source is off its target by a part of the one
    document that the cut goes through."""
    middle = F.floor(F.col("_m_size") / 2)
    inside = middle - F.col("_m_word") + F.col("_m_from")
    times = F.col("_m_times") + F.when(inside < F.col("_m_cut"), 1).otherwise(0)
    hit = plan.segments.join(plan.rows.select("_m_row", "_m_size"), "_m_row") \
        .where((middle >= F.col("_m_word")) & (middle < F.col("_m_word") + F.col("_m_words"))) \
        .join(_rounds(plan), ["_m_id", "_m_block"]).select("_m_row", times.alias("_m_n"))
    n = F.when(F.col("_m_size") == 0, 1).otherwise(F.coalesce("_m_n", F.lit(0))).cast("int")
    return plan.rows.join(hit, "_m_row", "left").where(n > 0) \
        .withColumn("_m_again", F.explode(F.sequence(F.lit(1), n))).select("_m_kept.*")
