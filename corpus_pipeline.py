"""The training-data pipeline: stages over ``documents``, each written and reread.

Null and empty texts: the classifier scores them by its intercept, all of them are
copies of one another, the mix keeps them (they cost no words), and they encode to no
ids. Each stage works on every row that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookfeel.cluster import written
from bookfeel.llm import bpe, mixing, near_text, quality
from bookfeel.llm.queries import QUALITY_BAR, held_out, table, vocabulary


def classify(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Reject the documents that score below the quality bar."""
    model = quality.fit(docs, table(spark, folder, "labels").where(~held_out()))
    into = next(name for name in ("_quality", "_quality_of_stage") if name not in docs.columns)
    return quality.score(docs, model, into=into).where(f"{into} >= {QUALITY_BAR}").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return near_text.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Repeat or leave out documents so that sources come in their target weights."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encode every text by byte-level BPE, and decode it again."""
    import public_tokenizers

    return bpe.encode_documents(
        docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("ids",))


STAGES = [("quality", classify), ("near copies", deduplicate), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None  # a trained model and sampled signatures have no SQL


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages after one another, from ``documents`` on."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
