"""User functions over rows and groups, Arrow-batched."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cluster import written
from .joins import skew_join
from .rollups import deal_parts


def apply_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to Arrow batches of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(run, schema)


def apply_groups(
    df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
    order_by: str, context: DataFrame | None = None, size: int = 100_000,
) -> DataFrame:
    """Apply ``fn`` group by group; a group above ``size`` rows comes in slices. A function
    of the whole group is a job for :func:`fold_groups`.

    What ``fn`` needs to know of the whole group (quartiles, a maximum, ...) is
    given as ``context``, one row per key, whose columns are joined on. That way
    no group has to fit into one task.
    """
    own = [c for c in df.columns if c != key]
    if context is not None:
        df = skew_join(df, context, key, "left", own)
    columns = df.columns
    # A null makes a column of whole numbers or flags another kind of column, in its own group
    # only: it travels as a mark, so that the other groups of a batch keep theirs.
    marked = {f"_null_{f.name}": f for f in df.schema.fields if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))}
    plain = {f.name: f.dataType for f in marked.values()}
    dealt = deal_parts(df, key, order_by, size, "_part")

    def own_kind(frame: pd.DataFrame) -> pd.DataFrame:
        missing = {m: frame.pop(m).to_numpy() for m in marked}
        for mark, f in marked.items():
            if missing[mark].any():
                wide = frame[f.name].astype("float64" if isinstance(f.dataType, T.IntegralType) else object)
                frame[f.name] = wide.mask(missing[mark], None)
        return frame

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the group at hand, from the batches before
        for frame in frames:
            starts = np.flatnonzero(frame.pop("_first").to_numpy())
            odd = any(frame[m].any() for m in marked)
            whole = frame if odd else frame.drop(columns=list(marked))
            done: list[pd.DataFrame] = []
            at = 0
            for edge in starts:
                if edge > at:
                    held.append(whole.iloc[at:edge])
                if held:
                    done.append(answer(held))
                held, at = [], edge
            if len(whole) > at:
                held.append(whole.iloc[at:])
            yield from joined(done)
        if held:
            yield from joined([answer(held)])

    def answer(parts: list[pd.DataFrame]) -> pd.DataFrame:
        if len(parts) > 1 and len({len(p.columns) for p in parts}) > 1:  # marks in some batches only
            parts = [p if marked.keys() <= set(p.columns) else p.assign(**dict.fromkeys(marked, False)) for p in parts]
        group = pd.concat(parts) if len(parts) > 1 else parts[0].copy(deep=False)
        group.index = pd.RangeIndex(len(group))
        return fn(own_kind(group) if len(group.columns) > len(columns) else group)

    def joined(results: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Results of one kind in one frame: a kind of its own stays apart, as no value may change."""
        results = [r for r in results if len(r)]
        for _, alike in itertools.groupby(results, lambda r: [*zip(r.columns, r.dtypes)]):
            alike = list(alike)
            yield pd.concat(alike, ignore_index=True) if len(alike) > 1 else alike[0]

    # The function's cost does not show in the data size, so the partition count
    # is given: adaptive execution would merge small data into few tasks.
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(least, -(-df.count() // size))
    # Groups follow one another in a partition, many to an Arrow batch: a batch for each
    # costs far more than most functions do.
    first = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_part")) == 1
    filled = [F.coalesce(c, F.lit(0).cast(plain[c])).alias(c) if c in plain else c for c in columns]
    rows = dealt.repartition(pieces, key, "_part").withColumn("_first", first).select(
        *filled, *[F.col(f.name).isNull().alias(m) for m, f in marked.items()], "_first")
    return rows.mapInPandas(run, schema)


class Fold(Protocol):
    """A function of a whole group by states that can be merged. States are pickled, and should
    stay small whatever the group holds."""

    def init(self) -> Any:
        """The state of no rows."""

    def update(self, state: Any, frame: pd.DataFrame) -> Any:
        """The state with the rows of ``frame`` (without the key) added."""

    def merge(self, one: Any, other: Any) -> Any:
        """The state of the rows of both, in whatever order."""

    def finish(self, state: Any) -> pd.DataFrame:
        """The group's rows of the result, without the key."""


ROUND = 64  # states that one task merges


def fold_groups(
    df: DataFrame, key: str, fold: Fold, schema: str, order_by: str, size: int = 100_000,
) -> DataFrame:
    """One true answer per group, however many rows it has; ``schema`` describes what
    ``finish`` gives, which comes back behind the key.

    A group above ``size`` rows is folded slice by slice in as many tasks, and the states
    are merged ``ROUND`` at a time, so no task meets the group. A null key is a group.
    """
    kind = df.schema[key].dataType.simpleString()
    columns = f"{key} {kind}, _part bigint, _state binary"

    def fold_slice(keys: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = fold.init()
        for frame in frames:  # in Arrow batches
            state = fold.update(state, frame.drop(columns=[key, "_part"]))
        yield pd.DataFrame({key: [keys[0]], "_part": [keys[1]], "_state": [pickle.dumps(state)]})

    def merged(keys: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for frame in frames:
            for packed in frame["_state"]:
                other = pickle.loads(packed)
                state = other if state is None else fold.merge(state, other)
        yield pd.DataFrame({key: [keys[0]], "_part": [keys[1]], "_state": [pickle.dumps(state)]})

    def finished(frame: pd.DataFrame) -> pd.DataFrame:
        out = fold.finish(pickle.loads(frame["_state"].iloc[0]))
        out.insert(0, key, frame[key].iloc[0])
        return out

    states = deal_parts(df, key, order_by, size, "_part").groupBy(key, "_part").applyInPandas(fold_slice, columns)
    states = written(states, "fold-states")
    most = states.agg(F.max("_part")).first()[0] or 0
    while most:
        most //= ROUND
        step = states.withColumn("_part", F.floor(F.col("_part") / ROUND))
        states = written(step.groupBy(key, "_part").applyInPandas(merged, columns), "fold-states")
    return states.groupBy(key).applyInPandas(finished, f"{key} {kind}, {schema}")
