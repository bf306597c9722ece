"""Structured records from model replies, and display records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, text
from ..schemas import METADATA
from .joins import only_new


def flat_columns(schema: T.StructType, parent: Column, prefix: str = "") -> list[Column]:
    """Leaves of a nested record under dotted names; lists as comma text."""
    out = []
    for field in schema.fields:
        name = f"{prefix}.{field.name}" if prefix else field.name
        value = parent[field.name]
        if isinstance(field.dataType, T.StructType):
            out += flat_columns(field.dataType, value, name)
        elif isinstance(field.dataType, T.ArrayType):
            out.append(F.array_join(value, ", ").alias(name))
        else:
            out.append(value.alias(name))
    return out


def flatten_record(df: DataFrame, column: str) -> DataFrame:
    """Replace a nested column by its leaves."""
    schema = df.schema[column].dataType
    others = [c for c in df.columns if c != column]
    return df.select(*others, *flat_columns(schema, F.col(column)))


def parse_metadata(
    replies: DataFrame, done: DataFrame | None = None, schema: T.StructType = METADATA
) -> DataFrame:
    """One flat row per usable reply of a book not done yet."""
    todo = replies if done is None else only_new(replies, done)
    found = todo.withColumn("_json", text.json_block(F.col("reply"))).filter("_json is not null")
    record = found.select("book_id", F.from_json("_json", schema).alias("record"))
    return flatten_record(record, "record")


def normalize_book(df: DataFrame) -> DataFrame:
    """Display fields with their defaults."""
    return df.select(
        F.coalesce("title", F.lit("Unknown title")).alias("title"),
        F.col("book_id").cast("string").alias("book_id"),
        F.coalesce("description", F.lit("No description available.")).alias("description"),
        fields.numeric_display(F.col("publication_year")).alias("publication_year"),
        F.coalesce("image_url", F.lit("")).alias("image_url"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("average_rating").cast("string"), F.lit("")).alias("average_rating"),
        fields.numeric_display(F.col("num_pages")).alias("num_pages"),
        F.coalesce(F.array_join("series", ", "), F.lit("")).alias("series"),
    )
