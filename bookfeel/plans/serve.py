"""The composed searches behind the served pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours, search


def filtered_books(features: DataFrame, base: DataFrame, criteria: dict, n: int | None = 10, parity: bool = False) -> DataFrame:
    """Multi-criteria filter straight to book rows, one lazy plan."""
    return search.hydrate(base, search.filter_books(features, base, criteria, parity), n)


def country_books(locations: DataFrame, base: DataFrame, country: str, n: int | None = 10) -> DataFrame:
    return search.hydrate(base, search.ids_by_country(locations, base, country), n)


def similar_book_rows(
    spark: SparkSession, book_id: int, model: str, stores: list[str], vectors: DataFrame,
    base: DataFrame, n: int = 10,
) -> DataFrame:
    found = neighbours.similar_books(spark, book_id, model, stores, vectors, n)
    return search.hydrate(base, found.select(F.col("neighbour").alias("book_id")), n)


def answer(vectors: DataFrame, base: DataFrame, question: str, embedder, k: int = 5) -> DataFrame:
    """Semantic search to book rows."""
    hits = neighbours.semantic_search(vectors, question, embedder, k)
    return search.hydrate(base, hits.select(F.col("id").alias("book_id")), k)
