"""Sums of long arrays over all partitions, without sending every partition's array to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 4096  # numbers that one row carries


def summed(df: DataFrame, size: int, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray:
    """The sum of what ``part`` makes of the batches of each partition, ``size`` numbers each (None: nothing).

    The arrays travel in blocks and meet block by block, where a task keeps one running
    sum of each; the driver gets ``size`` numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part(batches)
        if own is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(0, size, BLOCK), pa.int64()),
                 pa.array([own[i:i + BLOCK] for i in range(0, size, BLOCK)], pa.list_(pa.float64()))], ["block", "sums"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                new = np.asarray(batch.column("sums")[i].values)
                sums[block] = sums[block] + new if block in sums else new
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(sums, pa.int64()), pa.array(sums.values(), pa.list_(pa.float64()))], ["block", "sums"])

    schema, out = "block bigint, sums array<double>", np.zeros(size)
    for row in df.mapInArrow(run, schema).repartition("block").mapInArrow(meet, schema).collect():
        out[row["block"]:row["block"] + BLOCK] = row["sums"]
    return out
