"""Stored tables: write modes, unique appends, build-once stages, fitted models."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """True for a finished table: its success marker or, where markers are switched
    off, a data file is there."""
    files, target = _file(spark, f"{path}/_SUCCESS")
    if files.exists(target):
        return True
    setting = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    if spark._jsc.hadoopConfiguration().get(setting, "true").lower() != "false":
        return False
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{{part-*,*/part-*}}")
    return bool(files.globStatus(pattern))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "replace", partition_by: str | None = None) -> bool:
    """Store a table; nothing happens for an empty one. True when written."""
    if df.isEmpty():
        return False
    writer = df.write.mode(MODES[mode])
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return True


def write_keyed(df: DataFrame, path: str, key: str, group_bytes: int = 4 << 20, mode: str = "replace") -> DataFrame:
    """Store a table in the order of ``key``, in small row groups that carry the range of their keys and,
    by page, too, so that a look-up of a key reads the group that can hold it and skips the others."""
    (df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode(MODES[mode])
     .option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", 1000)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))
    return read(df.sparkSession, path)


LISTED = 1000  # keys that a filter names; more are joined


def look_up(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of a ``write_keyed`` table whose key is among the distinct ``keys``. Few keys go into the scan's
    filter, many meet the table in a join; the rows are the same."""
    few = [r[0] for r in keys.select(key).limit(LISTED + 1).collect()]  # LISTED + 1 values at most
    if len(few) <= LISTED:
        return table.filter(F.col(key).isin(few))
    return table.join(keys.select(key), key, "left_semi").select(*table.columns)


def append_unique(df: DataFrame, path: str, key: str = "book_id") -> DataFrame:
    """Append rows whose key is not stored yet; creates the table when absent.

    Repeated keys inside the new rows are all kept.
    """
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(read(spark, path).select(key), key, "left_anti").select(*df.columns)
    df.write.mode("append").parquet(path)
    return read(spark, path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stored result of a stage; built only when absent or forced."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return read(spark, path)


def save_params(spark: SparkSession, path: str, params: dict) -> None:
    """Keep the numbers of a fitted stage as a one-row table."""
    spark.range(1).select(F.lit(json.dumps(params)).alias("params")).write.mode("overwrite").parquet(path)


def train_or_load(spark: SparkSession, path: str, fit: Callable[[], object], force: bool = False):
    """A fitted stage: loaded when stored, else fitted and stored.

    ``fit`` returns a Spark ML pipeline model or a dict of numbers.
    """
    from pyspark.ml import PipelineModel

    if not force and exists(spark, f"{path}/metadata"):
        return PipelineModel.load(path)
    if not force and exists(spark, path):
        return json.loads(read(spark, path).first()["params"])
    fitted = fit()
    if isinstance(fitted, dict):
        save_params(spark, path, fitted)
    else:
        fitted.write().overwrite().save(path)
    return fitted
