"""Look-ups and searches over the served tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the cover that stands for "no picture".
NO_COVER = (
    "https://s.gr-assets.com/assets/nophoto/book/"
    "111x148-bcc042a9c91a29c1d680899eff700a03.png"
)

BOOK_CARD = [
    "book_id", "title", "image_url", "series", "url", "num_pages", "description",
    "average_rating", "publication_year",
]


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text; arrays read as a comma list."""
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(name, ", ")
    return F.col(name).cast("string")


def get_book(base: DataFrame, book_id: int) -> DataFrame:
    """The card of one book, every field as text; no row for an unknown id."""
    card = [as_text(base, c).alias(c) for c in BOOK_CARD if c in base.columns]
    return base.filter(F.col("book_id") == F.lit(book_id)).select(*card)


def filter_ids(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows whose key is listed: a literal list, or a DataFrame of ids."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column), column, "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(list(ids)))


def contains(c: Column, text: str) -> Column:
    """Case-insensitive ``LIKE '%text%'``; ``%`` and ``_`` in it act as wildcards."""
    return F.like(F.lower(c), F.lit(f"%{text.lower()}%"))


def list_key(c: Column) -> Column:
    """A digest of the list as text: short, however long the list is that rows are
    grouped by, and never equal to an id."""
    return F.sha2(F.to_json(c), 256)


def _first_of(df: DataFrame, cluster: Column, order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_editions(df: DataFrame, *ties: Column) -> DataFrame:
    """One row per ``similar_books`` list; all empty lists form one cluster."""
    order = [F.desc("total_shelves_count"), F.desc("ratings_count"), F.asc("book_id"), *ties]
    return _first_of(df, list_key(F.col("similar_books")), order)


def dedupe_editions_guarded(df: DataFrame, n: int | None = 10) -> DataFrame:
    """One edition per cluster; a book with an empty list stands for itself."""
    similar = F.col("similar_books")
    cluster = F.when(F.size(similar) == 0, F.col("book_id").cast("string")).otherwise(
        list_key(similar)
    )
    order = [F.desc("total_shelves_count"), F.asc_nulls_first("image_url"), F.asc("book_id")]
    kept = _first_of(df, cluster, order).orderBy(
        F.desc("total_shelves_count"), F.asc_nulls_first("image_url"), F.desc("average_rating"),
        F.asc("book_id"),
    )
    return kept if n is None else kept.limit(n)


def search_title(
    base: DataFrame, title: str, n: int | None = 10, index=None,
    complete: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Books whose title contains the text, one per cluster, best first. An ``index``
    (:class:`.text_index.TextIndex` of the titles, with the columns of ``base``) spares the scan;
    ``complete`` adds to the rows found the columns that are not stored with them."""
    found = base.filter(contains(F.col("title"), title)) if index is None else index.search(title)
    if complete:
        found = complete(found)
    hits = dedupe_editions(found)
    ranked = hits.orderBy(F.desc("total_shelves_count"), F.desc("average_rating"), F.asc("book_id"))
    return ranked if n is None else ranked.limit(n)


def find_book(base: DataFrame, text: str) -> DataFrame:
    """Digits are an id, anything else a title."""
    text = text.strip()
    if text.isdecimal():
        return get_book(base, int(text))
    hits = search_title(base, text)
    return hits.select(*[as_text(hits, c).alias(c) for c in BOOK_CARD if c in hits.columns])


def _with_cover(features: DataFrame, base: DataFrame) -> DataFrame:
    covered = base.filter(F.col("image_url") != NO_COVER)
    return features.join(
        covered.select("book_id", "total_shelves_count", "ratings_count"), "book_id"
    )


def ids_by_feature(
    features: DataFrame, base: DataFrame, feature: str, value: str,
    n: int | None = 10, descending: bool = False, index=None,
) -> DataFrame:
    """Ids of books whose feature contains the text and that have a cover,
    least shelved first unless ``descending``. An ``index`` of the feature as text
    spares the scan of ``features``."""
    if index is None:
        matching = features.filter(contains(as_text(features, feature), value)).select("book_id")
    else:
        matching = index.search(value).select("book_id")
    hits = _with_cover(matching, base)
    direction = F.desc if descending else F.asc
    ranked = hits.orderBy(
        direction("total_shelves_count"), direction("ratings_count"), F.asc("book_id")
    ).select("book_id")
    return ranked if n is None else ranked.limit(n)


def _resolution() -> Column:
    how = F.col("resolved_as")
    return F.when(how == "direct_country", 1).when(how == "geocoded", 2).otherwise(3)


def order_by_resolution(df: DataFrame) -> DataFrame:
    """Direct matches before geocoded ones before the rest, then most shelved."""
    return df.orderBy(
        _resolution(), F.desc("total_shelves_count"), F.desc("average_rating"), F.asc("book_id")
    )


def ids_by_country(locations: DataFrame, base: DataFrame, country: str) -> DataFrame:
    """Books set in a country, one per cluster, best resolution first."""
    there = locations.filter(F.lower("country") == F.lower(F.lit(country)))
    # A book may have several places in the country; its best resolved one stays.
    hits = dedupe_editions(there.join(base, "book_id"), _resolution(), F.col("region"))
    return order_by_resolution(hits).select(
        "book_id", "title", "country", "region", "resolved_as", "average_rating",
        "total_shelves_count",
    )


def filter_books(
    features: DataFrame, base: DataFrame, criteria: dict[str, str | list[str]],
    parity: bool = False, n: int | None = None,
) -> DataFrame:
    """OR inside a multi-select category, AND across categories.

    ``parity`` combines the ten-row answers of each single criterion; the
    default tests every book against the whole predicate in one pass.
    """
    wanted = {
        name: values if isinstance(values, (list, tuple)) else [values]
        for name, values in criteria.items() if values
    }
    if not wanted:
        return features.select("book_id").filter(F.lit(False))
    if parity:
        per_category = [
            reduce(
                DataFrame.union,
                [ids_by_feature(features, base, name, v) for v in values],
            ).distinct()
            for name, values in wanted.items()
        ]
        return reduce(DataFrame.intersect, per_category)
    predicate = reduce(
        lambda a, b: a & b,
        [
            reduce(lambda a, b: a | b, [contains(as_text(features, name), v) for v in values])
            for name, values in wanted.items()
        ],
    )
    hits = _with_cover(features.filter(predicate).select("book_id"), base)
    if n is None:
        return hits.select("book_id")
    return hits.orderBy(
        F.desc("total_shelves_count"), F.desc("ratings_count"), F.asc("book_id")
    ).select("book_id").limit(n)


def hydrate(base: DataFrame, ids: DataFrame, n: int | None = 10) -> DataFrame:
    """Result ids to book rows, one edition per cluster."""
    return dedupe_editions_guarded(filter_ids(base, "book_id", ids), n)
