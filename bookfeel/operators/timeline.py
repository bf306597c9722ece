"""Eras with their books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import require_numeric
from .joins import skew_join
from .rollups import LIST_SIZE, group_records


def timeline(eras: DataFrame, era_books: DataFrame, size: int = LIST_SIZE) -> DataFrame:
    """Eras in order with ``book_cards``; an era without books has an empty list.

    A crowded era comes as several rows, one per ``part`` of its list. The lists
    are the streamed side of the join, so they are not gathered by era again.
    """
    known = require_numeric(eras, "era_order")
    lists = group_records(require_numeric(era_books, "era_order"), "era_order", "book_id", size)
    lists = lists.filter("era_order is not null")
    with_books = skew_join(lists, known, "era_order", "inner", ["part"])
    none = known.join(lists.select("era_order").distinct(), "era_order", "left_anti").select(
        "*", F.lit(0).cast("long").alias("part"),
        F.array().cast(lists.schema["book_cards"].dataType).alias("book_cards"),
    )
    return with_books.unionByName(none).orderBy("era_order", "part")
