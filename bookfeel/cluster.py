"""Session set-up, shared work folder and size checks."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "bookfeel", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session whose executors are threads of this process may do without
    (it gets a temporary folder, once per process); any other one fails here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or _local_root()).rstrip("/")


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="bookfeel-")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/bookfeel/{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table, under the application's own folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Delete the application's written tables. Results that still read them must
    have been stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives the optimizer real file
    sizes to plan with.
    """
    path = work_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: exact for a written table up to compression,
    too small for exploded arrays. Spark broadcasts by the same number."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes below which Spark itself broadcasts a join side; 0 when switched off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").strip().lower()
    digits = text.rstrip("kmgtpb")
    unit = text[len(digits):].rstrip("b")  # k and kb are one unit
    return max(0, int(digits) << (10 * " kmgtp".index(unit or " ")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a scan that comes in fewer pieces than there are cores, as
    a small file with one row group does. A large table is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def row_total(df: DataFrame):
    """Row count as a scalar sub-query, for use inside an expression."""
    return df.agg(F.count("*")).scalar()
