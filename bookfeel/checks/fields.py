"""Filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import written
from ..functions import fields as fx
from ..functions import text as tx
from ..operators import filters, lemmas, metadata
from ..schemas import SHELVES
from ..sources import driver_tables as d
from .registry import check


def docs(spark, sf):
    return d.documents(spark, sf)


@check("f01_filter_language", "SELECT doc_id, lang FROM documents WHERE starts_with(lang, 'en')")
def filter_language(spark, sf):
    return filters.filter_language(docs(spark, sf), "en", "lang").select("doc_id", "lang")


@check("f02_split_languages", """
    SELECT doc_id, CASE WHEN lang = 'fr' THEN 'FRA' WHEN lang LIKE 'en%' THEN 'ENG' ELSE 'DUT' END AS lang_set
    FROM documents WHERE lang IN ('fr', 'nl') OR lang LIKE 'en%'""")
def split_languages(spark, sf):
    return filters.split_languages(docs(spark, sf), "lang", french="fr").select("doc_id", "lang_set")


@check("f03_drop_empty_text", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def drop_empty_text(spark, sf):
    return filters.drop_empty_text(docs(spark, sf), "text").select("doc_id")


@check("f04_drop_small_text", "SELECT doc_id FROM worded WHERE words > 50", ("worded",))
def drop_small_text(spark, sf):
    return filters.drop_small_text(docs(spark, sf), "text", 50).select("doc_id")


@check("f05_select_base", """
    SELECT book_id, title, publisher, num_pages, average_rating, ratings_count, publication_year,
      array_to_string(series, '|') AS series, image_url, url FROM book_facts""", ("book_facts",))
def select_base(spark, sf):
    kept = filters.select_base(d.books(spark, sf, "popular_shelves"))
    return kept.withColumn("series", F.array_join("series", "|"))


@check("f10_drop_any_null", """
    SELECT book_id, num_pages, image_url FROM book_facts
    WHERE num_pages IS NOT NULL AND image_url IS NOT NULL""", ("book_facts",))
def drop_any_null(spark, sf):
    books = d.book_facts(spark, sf).select("book_id", "num_pages", "image_url")
    return filters.drop_any_null(books, ["book_id", "num_pages", "image_url"])


@check("f11_require_numeric", """
    SELECT book_id, CAST(era_order AS DOUBLE) AS era_order FROM era_rows WHERE era_order <> 'x'""", ("era_rows",))
def require_numeric(spark, sf):
    return filters.require_numeric(d.era_books(spark, sf), "era_order").select("book_id", "era_order")


def latlng_text(spark, sf):
    """Customer rows with their nation's coordinates as text, some cut to one value."""
    pair = F.to_json("capital_latlng")
    one = F.concat(F.lit("["), F.get("capital_latlng", 0).cast("string"), F.lit("]"))
    return d.book_locations(spark, sf).select(
        "book_id", "country", F.when(F.col("resolved_as") == "geocoded", one).otherwise(pair).alias("capital_latlng"))


@check("f12_valid_latlng", """
    SELECT book_id, capital_latlng[1] AS lat, capital_latlng[2] AS lng
    FROM locations WHERE resolved_as <> 'geocoded'""", ("locations",))
def valid_latlng(spark, sf):
    kept = filters.valid_latlng(latlng_text(spark, sf))
    return kept.select("book_id", F.get("latlng", 0).alias("lat"), F.get("latlng", 1).alias("lng"))


@check("f13_value_predicates", """
    SELECT book_id, CAST(sum(CASE WHEN rating < 3 THEN 1 ELSE 0 END) AS BIGINT) AS low,
      CAST(sum(CASE WHEN n_votes - 3 < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
      CAST(sum(CASE WHEN rating > 3 THEN 1 ELSE 0 END) AS BIGINT) AS positive
    FROM reviews GROUP BY 1""", ("reviews",))
def value_predicates(spark, sf):
    reviews = d.reviews(spark, sf, text=False).select("book_id", "rating", (F.col("n_votes") - 3).alias("n_votes"))
    tagged = filters.with_target(reviews)
    parts = [
        filters.low_rated(tagged).select("book_id", F.lit(1).alias("low"), F.lit(0).alias("negative"), F.lit(0).alias("positive")),
        filters.negative_votes(tagged).select("book_id", F.lit(0), F.lit(1), F.lit(0)),
        tagged.select("book_id", F.lit(0), F.lit(0), "target"),
    ]
    union = parts[0].union(parts[1]).union(parts[2])
    return union.groupBy("book_id").agg(*[F.sum(c).alias(c) for c in ("low", "negative", "positive")])


@check("x01_word_count", "SELECT doc_id, words AS n_words FROM worded", ("worded",))
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@check("x02_dump_date", """
    SELECT review_id, coalesce(epoch_ms(started) // 1000, 15663600) AS started_at,
      coalesce(epoch_ms(finished) // 1000, 15663600) AS read_at FROM reviews""", ("reviews",))
def dump_date(spark, sf):
    reviews = d.reviews(spark, sf, text=False)
    return reviews.select("review_id", *[
        F.unix_seconds(fx.dump_date(F.col(c))).alias(c) for c in ("started_at", "read_at")])


@check("x03_read_hours", "SELECT review_id, read_duration FROM reviews", ("reviews",))
def read_hours(spark, sf):
    reviews = d.reviews(spark, sf, text=False)
    start, end = fx.dump_date(F.col("started_at")), fx.dump_date(F.col("read_at"))
    return reviews.select("review_id", fx.read_hours(start, end).alias("read_duration"))


@check("x04_shelves_total", """
    SELECT book_id, coalesce(total_shelves_count, 0) AS total_shelves_count
    FROM book_facts LEFT JOIN shelf_totals USING (book_id)""", ("book_facts", "shelf_totals"))
def shelves_total(spark, sf):
    return d.books(spark, sf, "popular_shelves").select(
        "book_id", fx.shelves_total(F.col("popular_shelves")).alias("total_shelves_count"))


@check("x05_series_flag", """
    SELECT p_partkey AS book_id, CASE WHEN p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS is_series FROM part""")
def series_flag(spark, sf):
    return d.book_facts(spark, sf).select("book_id", fx.series_flag(F.col("series")).alias("is_series"))


@check("x06_flag_to_int", """
    SELECT p_partkey AS book_id, CAST(p_size % 3 = 0 AS INTEGER) AS flag FROM part""")
def flag_to_int(spark, sf):
    text = F.concat(F.lit(" "), fx.series_flag(F.col("series")), F.lit(" "))
    return d.book_facts(spark, sf).select("book_id", fx.flag_to_int(text).alias("flag"))


@check("x07_count_bin", """
    SELECT c_custkey AS book_id,
      CASE WHEN v < 0 THEN NULL WHEN v <= 5 THEN '1-5' WHEN v <= 10 THEN '6-10' WHEN v <= 50 THEN '11-50'
        WHEN v <= 100 THEN '51-100' WHEN v <= 500 THEN '101-500' WHEN v <= 1000 THEN '501-1000'
        WHEN v <= 100000 THEN '1001+' END AS bin,
      CASE WHEN v < 0 THEN '#cccccc' WHEN v <= 5 THEN '#2c7bb6' WHEN v <= 10 THEN '#66c2a5'
        WHEN v <= 50 THEN '#abdda4' WHEN v <= 100 THEN '#ffffbf' WHEN v <= 500 THEN '#fdae61'
        WHEN v <= 1000 THEN '#f46d43' WHEN v <= 100000 THEN '#d73027' ELSE '#cccccc' END AS colour
    FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS v FROM customer)""")
def count_bin(spark, sf):
    v = F.floor("c_acctbal")
    return d.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("book_id"), fx.count_bin(v).alias("bin"), fx.bin_colour(v).alias("colour"))


@check("x08_parse_latlng", """
    SELECT book_id, CAST(CASE WHEN resolved_as = 'geocoded' THEN 1 ELSE 2 END AS BIGINT) AS n,
      capital_latlng[1] AS lat FROM locations""", ("locations",))
def parse_latlng(spark, sf):
    pair = fx.parse_latlng(F.col("capital_latlng"))
    return latlng_text(spark, sf).select("book_id", F.size(pair).cast("long").alias("n"), F.get(pair, 0).alias("lat"))


@check("x09_numeric_display", """
    SELECT book_id, replace(CAST(average_rating AS VARCHAR), '.0', '') AS rating,
      coalesce(CAST(num_pages AS VARCHAR), '') AS pages FROM book_facts""", ("book_facts",))
def numeric_display(spark, sf):
    return d.book_facts(spark, sf).select(
        "book_id", fx.numeric_display(F.col("average_rating")).alias("rating"),
        fx.numeric_display(F.col("num_pages")).alias("pages"))


@check("x10_clean_year", """
    SELECT book_id, CAST(year(o_orderdate) AS VARCHAR) AS year FROM era_rows""", ("era_rows",))
def clean_year(spark, sf):
    return d.era_books(spark, sf).select("book_id", fx.clean_year(F.col("year")).alias("year"))


@check("x11_century_label", """
    SELECT c_custkey, CASE WHEN c < 0 THEN -c || 'th c. BCE' ELSE c || 'th c. CE' END AS label
    FROM (SELECT c_custkey, c_nationkey - 12 AS c FROM customer)""")
def century_label(spark, sf):
    return d.table(spark, sf, "customer").select(
        "c_custkey", fx.century_label(F.col("c_nationkey") - 12).alias("label"))


@check("x12_era_anchor", """
    SELECT book_id, 'era-' || era_order AS anchor FROM era_rows WHERE era_order <> 'x'""", ("era_rows",))
def era_anchor(spark, sf):
    rows = filters.require_numeric(d.era_books(spark, sf), "era_order")
    return rows.select("book_id", fx.era_anchor(F.col("era_order")).alias("anchor"))


# Words of the test texts, so that look-ups and stop words have something to do.
VERBS = {"is": "be", "are": "be", "was": "be", "erst": "er"}
NOUNS = {"whther": "whth", "ations": "ation"}
_DROP_DIGITS = r"regexp_replace({}, '[\p{{Nd}}²³¹⁰-⁹₀-₉]', '', 'g')"
_DROP_PUNCT = """regexp_replace({}, '[!-/:-@\\[-`{{-~]', '', 'g')"""


def normal_sql(accents: bool, verbs: dict[str, str], nouns: dict[str, str]) -> str:
    """The normalised ``text`` as a SQL expression."""
    start = "lower(trim(text))"
    if accents:
        start = f"strip_accents({start})"
    cleaned = _DROP_PUNCT.format(_DROP_DIGITS.format(start))
    stop = ""
    if accents:
        words = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOP_WORDS)
        stop = f" AND w NOT IN ({words})"
    verb = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in verbs.items())
    noun = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in nouns.items())
    return rf"""array_to_string(
      [CASE v {noun} ELSE v END FOR v IN
        [CASE w {verb} ELSE w END FOR w IN regexp_split_to_array({cleaned}, '\s+') IF w <> ''{stop}]], ' ')"""


def _normal_sql(accents: bool) -> str:
    return f"SELECT doc_id, md5({normal_sql(accents, VERBS, NOUNS)}) AS digest FROM documents"


@check("x13_normalize_text", _normal_sql(False))
def normalize_text(spark, sf):
    clean = tx.normalize_text(F.col("text"), verbs=VERBS, nouns=NOUNS)
    return docs(spark, sf).select("doc_id", F.md5(clean).alias("digest"))


@check("x14_normalize_text_full", _normal_sql(True))
def normalize_text_full(spark, sf):
    clean = tx.normalize_text_full(F.col("text"), verbs=VERBS, nouns=NOUNS)
    return docs(spark, sf).select("doc_id", F.md5(clean).alias("digest"))


def _rules_sql(endings) -> str:
    return ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(endings))


def _bases_sql(name: str, words: str, rules: str, exceptions: dict[str, str]) -> str:
    """``<name>(word, base)`` of the words that have an exception or a candidate in the vocabulary."""
    listed = ", ".join(f"('{a}', '{b}')" for a, b in exceptions.items())
    return f"""
    {name}_c AS (SELECT word, place, substr(word, 1, length(word) - length(ending)) || new AS base
      FROM {words}, (VALUES {rules}) r(place, ending, new) WHERE ends_with(word, ending) AND length(word) + length(new) > length(ending)),
    {name}_r AS (SELECT word, arg_min(base, place) AS base FROM {name}_c WHERE base IN (SELECT word FROM vocabulary) GROUP BY 1),
    {name} AS (SELECT w.word, coalesce(e.base, r.base, w.word) AS base FROM {words} w
      LEFT JOIN {name}_r r ON r.word = w.word LEFT JOIN (VALUES {listed}) e(word, base) ON e.word = w.word)"""


@check("x14_lemmatized", f"""
    WITH texts AS (SELECT doc_id, string_split({normal_sql(True, {"": ""}, {"": ""})}, ' ') AS w FROM documents),
    placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
    vocabulary AS (SELECT DISTINCT word FROM placed WHERE word <> ''),
    {_bases_sql("verb", "vocabulary", _rules_sql(lemmas.VERB_ENDINGS), VERBS)},
    verbs AS (SELECT DISTINCT base AS word FROM verb),
    {_bases_sql("noun", "verbs", _rules_sql(lemmas.NOUN_ENDINGS), NOUNS)}
    SELECT doc_id, md5(string_agg(noun.base, ' ' ORDER BY i)) AS digest
    FROM placed JOIN verb ON verb.word = placed.word JOIN noun ON noun.word = verb.base GROUP BY 1
    UNION ALL SELECT doc_id, md5('') FROM texts WHERE w = [''] """)
def lemmatized(spark, sf):
    """Normalised texts with base forms by rules; the exceptions are tables."""
    rows = docs(spark, sf)
    verbs, nouns = (spark.createDataFrame(list(x.items()), "word string, base string") for x in (VERBS, NOUNS))
    table = written(lemmas.lemma_table(rows, "text", True, tx.STOP_WORDS, verbs, nouns), "lemmas")
    found = lemmas.lemmatized(rows, "doc_id", "text", table, True, tx.STOP_WORDS)
    return found.select("doc_id", F.md5("text").alias("digest"))


@check("x15_joined_categories", """
    SELECT book_id, concat(title, ' | ', publisher, ' | ', coalesce(image_url, 'nan')) AS text
    FROM book_facts""", ("book_facts",))
def joined_categories(spark, sf):
    columns = [F.col(c) for c in ("title", "publisher", "image_url")]
    return d.book_facts(spark, sf).select("book_id", tx.joined_categories(columns, " | ").alias("text"))


@check("x16_json_block", """
    SELECT c_custkey AS book_id, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE c_custkey % 13 <> 0""")
def json_block(spark, sf):
    found = d.replies(spark, sf).select("book_id", tx.json_block(F.col("reply")).alias("j")).filter("j is not null")
    return found.select("book_id", F.get_json_object("j", "$.location.country").alias("country"))


_FLAT_SQL = """
    SELECT c_custkey AS book_id, CAST(NULL AS VARCHAR) AS "location.city", n_name AS "location.country",
      'real' AS "location.world", '20' AS "period.century", CAST(NULL AS VARCHAR) AS "period.decade",
      CAST(NULL AS VARCHAR) AS "period.era", lower(c_mktsegment) || ', reading' AS hobbies,
      c_name AS main_characters, '' AS mood, 'adult' AS target_audience, 'trade' AS themes,
      CAST(NULL AS VARCHAR) AS original_language
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 13 <> 0"""


@check("x17_flatten_record", _FLAT_SQL)
def flatten_record(spark, sf):
    from ..schemas import METADATA

    found = d.replies(spark, sf).select("book_id", tx.json_block(F.col("reply")).alias("j")).filter("j is not null")
    return metadata.flatten_record(found.select("book_id", F.from_json("j", METADATA).alias("r")), "r")


@check("m25_parse_metadata", _FLAT_SQL + " AND c_acctbal > 0")
def parse_metadata(spark, sf):
    done = d.table(spark, sf, "customer").filter("c_acctbal <= 0").select(F.col("c_custkey").alias("book_id"))
    return metadata.parse_metadata(d.replies(spark, sf), done)


@check("x18_truncate", "SELECT doc_id, substr(text, 1, 1500) AS prompt, substr(text, 1, 1000) AS stored FROM documents")
def truncate(spark, sf):
    text = F.col("text")
    return docs(spark, sf).select("doc_id", tx.truncate(text, 1500).alias("prompt"), tx.truncate(text, 1000).alias("stored"))


@check("x19_char_length", "SELECT doc_id, length(text) AS n_chars FROM documents")
def char_length(spark, sf):
    return docs(spark, sf).select("doc_id", tx.char_length(F.col("text")).alias("n_chars"))


@check("x20_normalize_book", """
    SELECT title, CAST(book_id AS VARCHAR) AS book_id, coalesce(description, 'No description available.') AS description,
      CAST(publication_year AS VARCHAR) AS publication_year, coalesce(image_url, '') AS image_url, url,
      CAST(average_rating AS VARCHAR) AS average_rating, coalesce(CAST(num_pages AS VARCHAR), '') AS num_pages,
      array_to_string(series, ', ') AS series
    FROM book_facts LEFT JOIN described USING (book_id)""", ("book_facts", "described"))
def normalize_book(spark, sf):
    return metadata.normalize_book(d.books(spark, sf, "description"))


@check("x21_parse_literal", """
    SELECT book_id, CAST(count(*) AS BIGINT) AS shelves, CAST(max(n) AS BIGINT) AS top FROM shelf_counts GROUP BY 1""",
       ("shelf_counts",))
def parse_literal(spark, sf):
    text = F.translate(F.to_json("popular_shelves"), '"', "'")
    shelves = d.shelves(spark, sf).select("book_id", tx.parse_literal(text, SHELVES).alias("s"))
    return shelves.select(
        "book_id", F.size("s").cast("long").alias("shelves"),
        F.array_max(F.transform("s", lambda x: x["count"].cast("long"))).alias("top"))
