"""Removal of repeated byte strings by refining the buckets of a sampled suffix array.

Wanted is every start of a string of ``LENGTH`` bytes that occurs twice or more in all
texts. Every such window names one anchor: the leftmost of its 151 starts of 50-byte
grams that has the least hash. Equal windows name the same place in them, so that only
anchors have to be sorted, about one in 76 bytes. The windows of one anchor are
consecutive.

1. Initial buckets: anchors by their 50-byte gram. Sorted in a bucket by the identifiers
   of the 200-byte grams 150 bytes before and at the anchor (all that its windows can
   reach): anchors equal in this are repeated with all their windows; an anchor alone in
   its bucket has no repeated window. What is left are anchors near an end of a repeated
   passage.
2. These are refined by steps of 17 windows: buckets by the 184 bytes that the windows of
   a step share (gram bucket and identifier at a later offset), sorted by the up to 32
   bytes around them. Again equal ones are settled, and those alone.
3. Steps with an end inside go window by window, refined by the bytes around.

Each round takes the buckets of the one before and only those not yet settled; a settled
class sends one row on, which stands for at least two. Identifiers are 64-bit hashes
inside a 64-bit bucket, so two strings are taken as equal on 128 equal bits.

Equal texts are one row with a number of copies from the start. Buckets and classes that
a hashed sample shows to be large are spread over salts: a large class is known to be
repeated, a row alone in its class in a large bucket is known to have others beside it,
so nothing needs to meet. The sample decides on the layout only.

What is defined: a null text is empty; texts under 200 bytes keep all bytes; matches end
at the ends of a text; rows with equal texts get equal results; an empty table gives no
rows; columns to carry along are kept in a struct, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import work_path, written
from ..operators.joins import skew_join
from .pieces import slices

LENGTH, GRAM, STEP = 200, 50, 17
REACH = LENGTH - GRAM  # the furthest window start before an anchor
SHARED = LENGTH - STEP + 1  # bytes that the windows of a step share
PIECE = 1 << 17  # bytes hashed at once
PAD = LENGTH + REACH + STEP  # bytes around a piece of a long text
PLACE = np.uint64((1 << 24) - 1)  # low bits of a sort key: place in the piece
SAMPLE, OFTEN = 64, 64  # one text in SAMPLE is looked at for classes of at least OFTEN rows there


def _word(n: int) -> np.uint64:
    return np.uint64(n & (1 << 64) - 1)


A, B = _word(0x9E3779B97F4A7C15), _word(0xBF58476D1CE4E5B9)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of two neighbouring pieces from theirs."""
    z = x * A
    z += y
    z ^= z >> np.uint64(32)
    z *= B
    z ^= z >> np.uint64(29)
    return z


_BYTE = joined(joined(np.arange(1, 257, dtype=np.uint64), np.full(256, A)), np.full(256, B))


class Grams:
    """Identifiers of the grams that start at each byte."""

    def __init__(self, data: np.ndarray):
        x = _BYTE[data]
        levels = {1: x}
        for k in (1, 2, 4, 8, 16, 32, 64):
            x = joined(x[:-k], x[k:])
            levels[2 * k] = x
        n = len(data) - GRAM + 1
        self.gram = joined(joined(levels[32][:n], levels[16][32:32 + n]), levels[2][48:48 + n])
        self.half = x  # 128 bytes

    def long(self, at: np.ndarray, size: int) -> np.ndarray:
        return joined(self.half[at], self.half[at + size - 128])


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours."""
    n = len(keys)
    full = np.full(-(-n // width) * width, ~np.uint64(0))
    full[:n] = keys
    blocks = full.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n - width + 1], before[width - 1:n])


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Anchors of the windows that start in ``first`` up to ``last`` of texts from ``begin`` to ``end``
    (places in ``data``; a text may begin before and end after it): text, anchor, first and last
    window, gram and context identifiers."""
    use = last > first
    if len(data) < LENGTH or not use.any():
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    grams = Grams(data)
    keys = (grams.gram & ~PLACE) | np.arange(len(grams.gram), dtype=np.uint64)
    least = least_in_windows(keys, REACH + 1)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, first[use], 1)
    np.add.at(inside, last[use], -1)
    starts = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    text = np.repeat(np.flatnonzero(use), (last - first)[use])
    place = (least[starts] & PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(place, prepend=-1))
    to = np.append(new[1:], len(starts)) - 1
    text, at = text[new], place[new]
    left, right = np.maximum(begin[text], at - REACH), np.minimum(end[text], at + LENGTH)
    clip = ((at - left) * 1024 + right - at).astype(np.uint64)
    context = joined(joined(grams.long(left, LENGTH), grams.long(right - LENGTH, LENGTH)), clip)
    return [text, at, starts[new], starts[to], grams.gram[at], context]


def groups_of(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of together about a piece, or one long text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_anchors(data: np.ndarray, offsets: np.ndarray, i: int, j: int):
    """``anchors`` of texts i to j, in places of their own text; a long text goes piece by piece."""
    if j - i > 1 or offsets[j] - offsets[i] <= 2 * PIECE:
        begin, end = offsets[i:j] - offsets[i], offsets[i + 1:j + 1] - offsets[i]
        out = anchors(data[offsets[i]:offsets[j]], begin, end, begin, np.maximum(end - LENGTH + 1, begin))
        shift = begin[out[0]]
        return [out[0] + i, out[1] - shift, out[2] - shift, out[3] - shift, *out[4:]]
    size = int(offsets[j] - offsets[i])
    found = []
    for at in range(0, size - LENGTH + 1, PIECE):
        low, high = max(0, at - PAD), min(size, at + PIECE + PAD)
        one = anchors(
            data[offsets[i] + low:offsets[i] + high], np.array([-low]), np.array([size - low]),
            np.array([at - low]), np.array([min(at + PIECE, size - LENGTH + 1) - low]))
        found.append([one[0] + i, one[1] + low, one[2] + low, one[3] + low, *one[4:]])
    text, at, lo, hi, gram, context = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor whose windows lie in two pieces
    to = np.append(new[1:], len(at)) - 1
    return [text[new], at[new], lo[new], hi[to], gram[new], context[new]]


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


ROWS = "key binary, n int, at int, lo int, hi int, gram long, context long"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts; of those equal in one text a single row that counts them, and their
    windows as rows without a gram."""
    for batch in slices(batches, "text"):
        data, offsets = _buffer(batch.column("text"))
        copies = np.asarray(batch.column("n"))
        for i, j in groups_of(offsets):
            text, at, lo, hi, gram, context = text_anchors(data, offsets, i, j)
            if not len(text):
                continue
            same = joined(joined(gram, context), text.astype(np.uint64))
            _, head, which, n = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
            count = np.minimum(n * copies[text[head]], 2)
            text_, at_, lo_, hi_, gram_, context_ = (x[head] for x in (text, at, lo, hi, gram, context))
            twin = np.flatnonzero(n[which] > 1)
            first = np.ones(len(twin), bool)
            first[1:] = (text[twin][1:] != text[twin][:-1]) | (lo[twin][1:] != hi[twin][:-1] + 1)
            at_run = np.flatnonzero(first)
            end_run = np.append(at_run[1:], len(twin)) - 1 if len(twin) else at_run
            t, low, high = text[twin][at_run], lo[twin][at_run], hi[twin][end_run]
            texts = np.concatenate([text_, t])
            nothing = np.concatenate([np.zeros(len(text_), bool), np.ones(len(t), bool)])
            zero = np.zeros(len(t), np.int64)

            def whole(x, fill, kind):
                return pa.array(np.concatenate([x, fill]).astype(kind))

            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(pa.array(texts)), whole(count, zero + 2, np.int32), whole(at_, low, np.int32),
                whole(lo_, low, np.int32), whole(hi_, high, np.int32),
                pa.array(np.concatenate([gram_.view(np.int64), zero]), mask=nothing),
                pa.array(np.concatenate([context_.view(np.int64), zero]), mask=nothing),
            ], [x.split()[0] for x in ROWS.split(", ")])


def marked(rows: DataFrame, sample: DataFrame, bucket: list[str], label: str | None) -> DataFrame:
    """``rows`` (``key``, ``at``, ``n``, bucket and label columns) with ``twice`` (its class, the rows of one
    bucket and label, counts two or more), ``others`` (its bucket has other classes) and
    ``head`` (one row of each class that is ``twice``). Rows with a null in the bucket are ``twice`` and no head.

    Classes that are large in ``sample`` are spread over salts by row, buckets that are by label."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    label = label or "_one"
    if label == "_one":
        rows, sample = rows.withColumn(label, F.lit(0)), sample.withColumn(label, F.lit(0))
    drawn = written(sample.where(F.col(bucket[0]).isNotNull()).select(*bucket, label, "key", "at"), "drawn")
    # At most 4 * parts buckets, and as many classes, reach this.
    often = F.greatest(F.lit(OFTEN), drawn.agg(F.count("*")).scalar() / (4 * parts))
    classes = drawn.groupBy(*bucket, label).agg(
        F.count("*").alias("_rows"), F.min(F.struct("key", "at")).alias("_head")).where(F.col("_rows") >= often)
    buckets = drawn.groupBy(*bucket).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= often)
    known = rows.join(F.broadcast(classes.drop("_rows")), [*bucket, label], "left").join(
        F.broadcast(buckets.withColumn("_large", F.lit(True)).drop("_rows")), bucket, "left")
    spread = known.withColumn("_salt", F.when(
        F.col("_head").isNotNull() | F.col(bucket[0]).isNull(), F.pmod(F.xxhash64("key", "at"), F.lit(parts)),
    ).when(F.col("_large"), F.pmod(F.xxhash64(label), F.lit(parts))).otherwise(0).cast("int"))
    of_bucket, of_class = Window.partitionBy(*bucket, "_salt"), Window.partitionBy(*bucket, "_salt", label)
    counted = spread.withColumns({
        "_sum": F.sum("n").over(of_class), "_nth": F.row_number().over(of_class.orderBy("key", "at")),
        "_low": F.min(label).over(of_bucket), "_high": F.max(label).over(of_bucket)})
    hot, plain = F.col("_head").isNotNull(), F.col(bucket[0]).isNotNull()
    return counted.withColumns({
        "twice": hot | ~plain | (F.col("_sum") >= 2),
        "others": plain & (hot | F.coalesce("_large", F.lit(False)) | (F.col("_low") != F.col("_high"))),
        "head": plain & F.when(hot, F.col("_head") == F.struct("key", "at")).otherwise(
            (F.col("_nth") == 1) & (F.col("_sum") >= 2)),
    }).drop("_head", "_large", "_salt", "_sum", "_nth", "_low", "_high", "_one")


STEPS = ("key binary, n int, need boolean, at int, step int, low int, high int, gram long, core long, "
         "before binary, after binary")


def _byte_slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at].tobytes())])


def _step_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of the windows of the anchors listed."""
    for batch in slices(batches, "text"):
        data, offsets = _buffer(batch.column("text"))
        lists = batch.column("anchors")
        edges = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        at, lo, hi, n, need = (np.asarray(flat.field(k)) for k in range(5))
        at, lo, hi = at.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64)
        edges = edges - edges[0]
        text = np.repeat(np.arange(batch.num_rows), np.diff(edges))
        order = np.lexsort((at, text))  # in pieces of a long text one after another
        at, lo, hi, n, need = at[order], lo[order], hi[order], n[order], need[order]
        for i, j in groups_of(offsets):
            a, b = edges[i], edges[j]
            for k in ([(a, b, 0, int(offsets[j] - offsets[i]))] if j - i > 1 or offsets[j] - offsets[i] <= 2 * PIECE
                      else _cuts(at, a, b, int(offsets[j] - offsets[i]))):
                u, v, low, high = k
                if u == v:
                    continue
                block = data[offsets[i] + low:offsets[i] + high]
                grams = Grams(block)
                shift = offsets[text[u:v]] - offsets[i] - low
                first, last = (at[u:v] - hi[u:v]) // STEP, (at[u:v] - lo[u:v]) // STEP
                which = np.repeat(np.arange(u, v), last - first + 1)
                count = np.cumsum(last - first + 1)
                step = np.arange(len(which)) - np.repeat(count - (last - first + 1), last - first + 1) + np.repeat(first, last - first + 1)
                here = at[which] + shift[which - u]
                core = here - step * STEP
                least = np.maximum(step * STEP, at[which] - hi[which])
                most = np.minimum(step * STEP + STEP - 1, at[which] - lo[which])
                before, after = most - step * STEP, STEP - 1 - (least - step * STEP)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(pa.array(text[which])), pa.array(n[which].astype(np.int32)), pa.array(need[which]),
                    pa.array(at[which].astype(np.int32)), pa.array(step.astype(np.int32)),
                    pa.array(least.astype(np.int32)), pa.array(most.astype(np.int32)),
                    pa.array(grams.gram[here].view(np.int64)), pa.array(grams.long(core, SHARED).view(np.int64)),
                    _byte_slices(block, core - before, before), _byte_slices(block, core + SHARED, after),
                ], [x.split()[0] for x in STEPS.split(", ")])


def _cuts(at: np.ndarray, a: int, b: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Anchors a to b of a long text by pieces, with the bytes that they reach."""
    for low in range(0, size, PIECE):
        u, v = a + np.searchsorted(at[a:b], [low, low + PIECE])
        yield int(u), int(v), max(0, low - PAD), min(size, low + PIECE + PAD)


RESULT = ("key binary, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, "
          "kept_sha256 string")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, offsets = _buffer(batch.column("text"))
        lists = batch.column("windows")
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        flat = lists.flatten()
        lo, hi = (np.asarray(flat.field(k)).astype(np.int64) for k in range(2))
        removed, spans, starts, ends, shas = [], [], [], [], []
        for k in range(batch.num_rows):
            whole = data[offsets[k]:offsets[k + 1]]
            begin = finish = np.empty(0, np.int64)
            if sizes[k]:
                order = np.argsort(lo[edges[k]:edges[k + 1]], kind="stable")
                first = lo[edges[k]:edges[k + 1]][order]
                after = np.maximum.accumulate(hi[edges[k]:edges[k + 1]][order] + LENGTH)
                new = np.ones(len(first), bool)
                new[1:] = first[1:] > after[:-1]
                begin, finish = first[new], after[np.append(np.flatnonzero(new)[1:], len(first)) - 1]
            sha, at = hashlib.sha256(), 0
            for s, e in zip(begin.tolist(), finish.tolist()):
                sha.update(whole[at:s])
                at = e
            sha.update(whole[at:])
            removed.append(int((finish - begin).sum()))
            spans.append(len(begin))
            starts.append(begin)
            ends.append(finish)
            shas.append(sha.hexdigest())
        bounds = pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            batch.column("key"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(starts))),
            pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ends))), pa.array(shas, pa.string()),
        ], [x.split()[0] for x in RESULT.split(", ")])


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """Each text once with its copies, stored by buckets of its key, so that later joins leave it where it is."""
    spark = keyed.sparkSession
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    name = f"distinct_texts_{uuid.uuid4().hex}"
    (texts.select("key", F.col("text").cast("binary").alias("text"), F.least("n", F.lit(2)).cast("int").alias("n"))
     .write.format("parquet").option("compression", "zstd").option("path", work_path(spark, "distinct-texts"))
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").saveAsTable(name))
    return spark.table(name)


def _drawn(df: DataFrame) -> DataFrame:
    return df.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0)


def repeated_windows(texts: DataFrame) -> DataFrame:
    """``key, lo, hi``: runs of starts of repeated windows, of ``texts`` by ``_distinct_texts``."""
    source = texts.select("key", "text", "n")
    rounds = [marked(
        source.mapInArrow(_anchor_rows, ROWS), _drawn(source).mapInArrow(_anchor_rows, ROWS), ["gram"], "context")]
    first = written(rounds[0].where("twice or others").select(
        "key", "at", "lo", "hi", "twice", (F.col("others") & (F.col("head") | ~F.col("twice"))).alias("open")), "anchor-marks")
    listed = first.where("open").groupBy("key").agg(F.collect_list(F.struct(
        "at", "lo", "hi", F.when(F.col("twice"), 2).otherwise(1).alias("n"), (~F.col("twice")).alias("need"))).alias("anchors"))
    steps = written(texts.join(listed, "key").select("key", "text", "anchors").mapInArrow(_step_rows, STEPS), "steps")
    around = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("before")), 2, "0")), F.col("before"), F.col("after"))
    steps = steps.withColumn("around", around)
    second = marked(steps, _drawn(steps), ["gram", "core", "step"], "around")
    second = written(second.where("twice or others").select(
        "key", "at", "need", "step", "low", "high", "gram", "core", "before", "after", "twice",
        (F.col("others") & (F.col("head") | ~F.col("twice"))).alias("open")), "step-marks")
    back = F.col("back") - F.col("step") * STEP
    single = second.where("open").withColumn("back", F.explode(F.sequence("low", "high"))).select(
        "key", "at", (F.col("need") & ~F.col("twice")).alias("need"), "gram", "core", "back",
        F.when(F.col("twice"), 2).otherwise(1).alias("n"),
        F.substring("before", F.octet_length("before") - back + 1, back).alias("before"),
        F.substring("after", F.lit(1), STEP - 1 - back).alias("after"))
    third = marked(single, _drawn(single), ["gram", "core", "back", "before", "after"], None)
    return (
        first.where("twice").select("key", "lo", "hi")
        .unionByName(second.where("twice and need").select(
            "key", (F.col("at") - F.col("high")).alias("lo"), (F.col("at") - F.col("low")).alias("hi")))
        .unionByName(third.where("twice and need").select(
            "key", (F.col("at") - F.col("back")).alias("lo"), (F.col("at") - F.col("back")).alias("hi"))))


def without_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``row`` (a struct of the columns ``keep``, by default all but the text),
    ``n_bytes``, ``n_removed``, ``n_spans``, ``starts`` and ``ends`` of the removed runs of bytes, ``kept_sha256``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    whole = F.coalesce(F.col(text), F.lit(""))
    # 96 bits of a digest stand for a text.
    keyed = docs.select(
        F.struct(*keep).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"),
        F.unhex(F.substring(F.md5(whole), 1, 24)).alias("key"), whole.alias("text"))
    texts = _distinct_texts(keyed)
    windows = repeated_windows(texts).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("windows"))
    results = written(
        texts.join(windows, "key", "left").select("key", "text", "windows").mapInArrow(_results, RESULT), "kept")
    return skew_join(keyed.select("row", "key"), results, "key", "left", ["row"]).drop("key")
