"""Declared schemas of the logical tables; nothing is inferred on read."""

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SHELVES = T.ArrayType(_table(count=_S, name=_S))
AUTHOR_REFS = T.ArrayType(_table(author_id=_S, role=_S))
SCORES = T.ArrayType(_table(label=_S, score=_D))
ENTITIES = T.ArrayType(_table(entity_group=_S, score=_D, word=_S))

BOOKS_RAW = _table(
    book_id=_L, language_code=_S, text_reviews_count=_L, series=T.ArrayType(_S),
    popular_shelves=SHELVES, is_ebook=_S, average_rating=_D, similar_books=T.ArrayType(_L),
    description=_S, format=_S, link=_S, authors=AUTHOR_REFS, publisher=_S, num_pages=_L,
    publication_year=_L, url=_S, image_url=_S, ratings_count=_L, title=_S,
    title_without_series=_S,
)
REVIEWS_RAW = _table(
    user_id=_S, book_id=_L, review_id=_S, rating=_L, review_text=_S, date_added=_S,
    date_updated=_S, read_at=_S, started_at=_S, n_votes=_L, n_comments=_L,
)
AUTHORS = _table(author_id=_L, name=_S)
BOOK_LOCATIONS = _table(
    book_id=_L, country=_S, region=_S, capital_latlng=T.ArrayType(_D), resolved_as=_S
)
COUNTRIES = _table(name=_S, region=_S, capital_latlng=T.ArrayType(_D))
GAZETTEER = _table(place=_S, country=_S)
SIMILARITIES = _table(book_id=_L, similar_books=T.ArrayType(_L), model=_S)

# The nested record a metadata reply must follow.
METADATA = _table(
    location=_table(city=_S, country=_S, world=_S),
    period=_table(century=_S, decade=_S, era=_S),
    hobbies=T.ArrayType(_S),
    main_characters=T.ArrayType(_S),
    mood=T.ArrayType(_S),
    target_audience=_S,
    themes=T.ArrayType(_S),
    original_language=_S,
)

# The model inputs of the similarity encoders.
NUMERIC_FEATURES = [
    "n_votes", "read_duration", "average_rating", "num_pages", "ratings_count",
    "total_shelves_count",
]
CATEGORY_FEATURES = [
    "is_series", "author_names", "emotions", "content_intensity", "romance_heat_level", "character_type",
    "main_themes", "pace", "sentiment", "country", "region",
]
