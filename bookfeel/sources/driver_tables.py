"""The test tables seen as the library's logical tables.

Each function is a plain projection/aggregation over the given parquet tables,
so its output grows with them. ``checks/logical.py`` holds the same mapping as
SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import row_total, spread
from ..functions import fields
from ..operators.search import NO_COVER


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, on all cores: work on their texts is heavy."""
    return spread(table(spark, folder, "documents"), "doc_id")


def book_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part; no join, no aggregate."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("book_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("publisher"),
        F.col("p_type").alias("format"),
        F.when(key % 13 != 0, F.col("p_size").cast("long")).alias("num_pages"),
        (F.lit(1.0) + (key * 7 % 41) / F.lit(10.0)).alias("average_rating"),
        (key * 37 % 1000).alias("ratings_count"),
        (F.lit(1950) + key % 70).cast("long").alias("publication_year"),
        F.when(F.col("p_size") % 3 == 0, F.array("p_brand"))
        .otherwise(F.array().cast("array<string>"))
        .alias("series"),
        F.when(key % 10 == 0, F.lit(NO_COVER))
        .when(key % 17 != 0, F.concat(F.lit("img/"), key.cast("string")))
        .alias("image_url"),
        F.concat(F.lit("book/"), key.cast("string")).alias("url"),
    )


def _edition_groups(spark: SparkSession, folder: str) -> DataFrame:
    """``similar_books`` once per name and brand: the ids of its parts, none where one stands alone."""
    ids = F.array_sort(F.collect_list("p_partkey"))
    groups = table(spark, folder, "part").groupBy("p_name", "p_brand").agg(ids.alias("members"))
    return groups.select(
        F.col("p_name").alias("_g_name"), F.col("p_brand").alias("_g_brand"),
        F.when(F.size("members") > 1, F.col("members"))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("similar_books"),
    )


def _edition_refs(spark: SparkSession, folder: str) -> DataFrame:
    """The name and brand of each part, by which it finds its list. Merged, not broadcast:
    the file is far smaller than its rows in memory."""
    return table(spark, folder, "part").filter("p_partkey IS NOT NULL").select(
        F.col("p_partkey").alias("book_id"), F.col("p_name").alias("_name"), F.col("p_brand").alias("_brand"),
        F.lit(True).alias("_listed"),
    ).hint("merge")


def _with_editions(spark: SparkSession, folder: str, refs: DataFrame) -> DataFrame:
    """``similar_books`` for rows with the columns of :func:`_edition_refs`; null where these are."""
    same = F.col("_listed") & F.col("_name").eqNullSafe(F.col("_g_name")) & F.col("_brand").eqNullSafe(F.col("_g_brand"))
    return refs.join(_edition_groups(spark, folder), same, "left").drop("_name", "_brand", "_listed", "_g_name", "_g_brand")


def editions(spark: SparkSession, folder: str) -> DataFrame:
    """``similar_books``: parts of one name and brand; empty where a part stands alone."""
    return _with_editions(spark, folder, _edition_refs(spark, folder))


def add_editions(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Rows with a ``book_id`` and its ``similar_books``, as :func:`base` has them."""
    return _with_editions(spark, folder, rows.join(_edition_refs(spark, folder), "book_id", "left"))


def shelves(spark: SparkSession, folder: str) -> DataFrame:
    """``popular_shelves``: line count per return flag, as text; three at most."""
    counts = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("book_id"), "l_returnflag")
        .agg(F.count("*").alias("n"))
    )
    return counts.groupBy("book_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("n").cast("string").alias("count"), F.col("l_returnflag").alias("name"))
            )
        ).alias("popular_shelves")
    )


def author_refs(spark: SparkSession, folder: str) -> DataFrame:
    """``authors``: distinct suppliers of a part's lines, ascending."""
    pairs = (
        table(spark, folder, "lineitem")
        .select(F.col("l_partkey").alias("book_id"), "l_suppkey")
        .distinct()
    )
    return pairs.groupBy("book_id").agg(
        F.transform(
            F.array_sort(F.collect_list("l_suppkey")),
            lambda k: F.struct(k.cast("string").alias("author_id"), F.lit("").alias("role")),
        ).alias("authors")
    )


def authors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name")
    )


def descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """``description`` and ``language_code`` per book, from the documents. Merged, not
    broadcast: the file of the parts is far smaller than their keys in memory."""
    docs = table(spark, folder, "documents")
    total = row_total(docs)
    return (
        table(spark, folder, "part")
        .select(F.col("p_partkey").alias("book_id"), (F.col("p_partkey") % total).alias("doc_id"))
        .hint("merge")
        .join(docs.select("doc_id", "text", "lang"), "doc_id")
        .select("book_id", F.col("text").alias("description"), F.col("lang").alias("language_code"))
    )


def books(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Books with only the wanted derived columns joined in.

    ``extra`` names any of: similar_books, popular_shelves, authors, description.
    """
    parts = {
        "similar_books": _edition_refs,
        "popular_shelves": shelves,
        "authors": author_refs,
        "description": descriptions,
    }
    df = book_facts(spark, folder)
    columns = [*df.columns]
    for name in extra:
        joined = parts[name](spark, folder)
        df = df.join(joined, "book_id", "left")
        columns += ["similar_books"] if name == "similar_books" else [c for c in joined.columns if c != "book_id"]
    for name in ("popular_shelves", "authors"):
        if name in extra:
            empty = F.array().cast(df.schema[name].dataType)
            df = df.withColumn(name, F.coalesce(F.col(name), empty))
    if "similar_books" in extra:
        # Last, from one list per group: a list as long as its group on every book is
        # too much to broadcast or to carry through the other joins.
        df = _with_editions(spark, folder, df)
    return df.select("book_id", *[c for c in columns if c != "book_id"])


def base(spark: SparkSession, folder: str) -> DataFrame:
    """The served base table without texts: what the searches read."""
    shelf = F.col("popular_shelves")
    return books(spark, folder, "similar_books", "popular_shelves").select(
        "*", fields.shelves_total(shelf).alias("total_shelves_count")
    ).drop("popular_shelves")


def reviews(spark: SparkSession, folder: str, text: bool = True) -> DataFrame:
    """One review per line item; with ``text`` its whole document is the review.

    The orders are merged, not broadcast: few of their columns seem small by the file,
    and are not in memory.
    """
    lines = spread(table(spark, folder, "lineitem"), "l_orderkey").join(
        table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"
        ).hint("merge"),
        "l_orderkey",
    )

    def dump_form(c):
        # Day names cannot be parsed back, so any fixed three letters do.
        return F.when(
            F.col("l_linenumber") != 7,
            F.concat(
                F.lit("Sun "), F.date_format(c, "MMM dd HH:mm:ss"), F.lit(" +0000 "),
                F.date_format(c, "yyyy"),
            ),
        ).otherwise("")

    out = [
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("review_id"),
        F.col("l_partkey").alias("book_id"),
        F.col("o_custkey").cast("string").alias("user_id"),
        (F.col("l_quantity").cast("long") % 6).alias("rating"),
        (F.col("l_linenumber") - 1).cast("long").alias("n_votes"),
        dump_form(F.col("o_orderdate")).alias("started_at"),
        dump_form(F.col("l_shipdate")).alias("read_at"),
    ]
    if not text:
        return lines.select(*out)
    docs = table(spark, folder, "documents")
    total = row_total(docs)
    return (
        lines.withColumn("doc_id", F.col("l_orderkey") % total)
        .join(docs.select("doc_id", "text"), "doc_id")
        .select(*out, F.col("text").alias("review_text"))
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Label scores per id: share of each event type in a run of eight events."""
    cents = (
        table(spark, folder, "events")
        .select(
            F.expr("event_id div 8").alias("id"),
            F.col("event_type").alias("label"),
            F.round(F.col("value") * 100).cast("long").alias("cents"),
        )
        .groupBy("id", "label")
        .agg(F.sum("cents").alias("cents"))
    )
    grouped = cents.groupBy("id").agg(
        F.sum("cents").alias("total"), F.collect_list(F.struct("label", "cents")).alias("parts")
    )
    return grouped.select(
        "id",
        F.transform(
            "parts",
            lambda p: F.struct(
                p["label"].alias("label"),
                F.coalesce(F.try_divide(p["cents"].cast("double"), F.col("total").cast("double")), F.lit(0.0))
                .alias("score"),
            ),
        ).alias("scores"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Named entities per id, in event order; eight at most."""
    names = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    rows = (
        table(spark, folder, "events")
        .withColumn("k", F.col("user_id") % 25)
        .join(names, "k")
        .select(
            F.expr("event_id div 8").alias("id"),
            F.struct(
                F.col("event_id"),
                F.when(F.col("event_type").isin("view", "click"), "LOC").otherwise("PER").alias("entity_group"),
                (F.col("value") / 500).alias("score"),
                F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")).alias("word"),
            ).alias("e"),
        )
    )
    return rows.groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list("e")),
            lambda e: F.struct(
                e["entity_group"].alias("entity_group"), e["score"].alias("score"), e["word"].alias("word")
            ),
        ).alias("entities")
    )


def _latlng(key):
    return F.array((key * 2.5 - 30.0), (key * 5.0 - 60.0)).cast("array<double>")


def countries(spark: SparkSession, folder: str) -> DataFrame:
    """Nations 0-14 under their own name, plus the targets of the gazetteer."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return (
        n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .filter("n_nationkey < 15")
        .select(
            F.col("n_name").alias("name"),
            F.col("r_name").alias("region"),
            _latlng(F.col("n_nationkey")).alias("capital_latlng"),
        )
    )


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Nations 15-21 as places: 15-19 lie in nation k-15, 20 has no country and
    21 lies in a country the countries table does not know."""
    k = F.col("n_nationkey")
    return table(spark, folder, "nation").filter("n_nationkey between 15 and 21").select(
        F.col("n_name").alias("place"),
        F.when(k < 20, F.concat(F.lit("NATION_"), (k - 15).cast("string")))
        .when(k == 21, F.lit("ATLANTIS"))
        .alias("country"),
    )


def book_locations(spark: SparkSession, folder: str) -> DataFrame:
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    segment = F.col("c_mktsegment")
    return (
        table(spark, folder, "customer")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("book_id"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            _latlng(F.col("n_nationkey")).alias("capital_latlng"),
            F.when(segment == "BUILDING", "direct_country")
            .when(segment == "AUTOMOBILE", "geocoded")
            .otherwise("not_found")
            .alias("resolved_as"),
        )
    )


def eras(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order year with its order count, and an unusable key ``x``."""
    year = F.year("o_orderdate")
    counted = (
        table(spark, folder, "orders")
        .groupBy(F.when(F.col("o_orderkey") % 50 != 0, year.cast("string")).otherwise("x").alias("era_order"))
        .agg(F.count("*").alias("books"))
    )
    return counted.select(
        "era_order",
        F.concat(F.lit("Era "), "era_order").alias("era"),
        (F.try_to_number(F.substring("era_order", 3, 2), F.lit("99")).cast("int") - 97).alias("century"),
        "books",
    )


def era_books(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 50 != 0, F.year("o_orderdate").cast("string"))
        .otherwise("x").alias("era_order"),
        F.col("o_orderkey").alias("book_id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("['"), F.year("o_orderdate").cast("string"), F.lit("']")).alias("year"),
        F.concat(F.lit("img/"), F.col("o_orderkey").cast("string")).alias("image_url"),
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Model replies per customer: fenced for even keys, wrapped in prose for
    odd ones, broken for multiples of 13."""
    key = F.col("c_custkey")
    n = table(spark, folder, "nation")
    record = F.concat(
        F.lit('{"location": {"city": null, "country": "'), F.col("n_name"),
        F.lit('", "world": "real"}, "period": {"century": "20", "decade": null, "era": null}, '
              '"hobbies": ["'), F.lower("c_mktsegment"),
        F.lit('", "reading"], "main_characters": ["'), F.col("c_name"),
        F.lit('"], "mood": [], "target_audience": "adult", "themes": ["trade"], '
              '"original_language": null}'),
    )
    return (
        table(spark, folder, "customer")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("book_id"),
            F.when(key % 13 == 0, F.concat(F.lit("Sorry {"), F.col("c_name")))
            .when(key % 2 == 0, F.concat(F.lit("```json\n"), record, F.lit("\n```")))
            .otherwise(F.concat(F.lit("Here it is: "), record, F.lit(" Enjoy.")))
            .alias("reply"),
        )
    )


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label, as (id, text, target)."""
    return documents(spark, folder).join(table(spark, folder, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("quality").alias("target"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
