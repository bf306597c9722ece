"""Incremental review ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import drop_small_text
from ..schemas import REVIEWS_RAW
from ..sources import tables

# State on disk, a key at a time: a batch touches the keys it brings.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": STORE,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def _present(spark: SparkSession, path: str) -> bool:
    files, target = tables._file(spark, path)
    return files.exists(target)


def ingest_reviews(
    spark: SparkSession, landing: str, books: DataFrame, out: str, checkpoint: str,
    min_words: int = 50,
) -> None:
    """Take in the review files that arrived since the last run, then stop.

    Each review of a known book with enough words is stored once per ``review_id``,
    also when a file is delivered twice. The ids taken in are the query's state, which
    a batch asks for its own ids only; what is stored is not read again. A batch is
    written to a folder of its number (column ``batch``) in place of what is there, so
    that one replayed after a failure changes nothing.

    The state belongs to ``checkpoint``. Where that is gone but ``out`` holds
    reviews, nothing can tell which came before: the run is refused.
    """
    if _present(spark, out) and not _present(spark, f"{checkpoint}/commits"):
        raise ValueError(f"{out} holds reviews, but the ids taken in are not known in {checkpoint}")
    known = books.select(F.col("book_id")).distinct()
    reviews = drop_small_text(spark.readStream.schema(REVIEWS_RAW).json(landing), "review_text", min_words)
    fresh = reviews.join(known, "book_id", "left_semi").select(*reviews.columns).dropDuplicates(["review_id"])

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        query = (
            fresh.writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
