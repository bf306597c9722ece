"""Joins, aggregations, windows and ordering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..cluster import work_path, written
from ..functions import fields as fx
from ..operators import custom, filters, joins, ordering, rollups, timeline
from ..plans import prepare
from ..sources import driver_tables as d
from .logical import bucket
from .registry import check


def timed_reviews(spark, sf):
    """Reviews with their duration, without texts."""
    start, end = fx.dump_date(F.col("started_at")), fx.dump_date(F.col("read_at"))
    return d.reviews(spark, sf, text=False).withColumn("read_duration", fx.read_hours(start, end))


def rollup(spark, sf):
    return rollups.rollup_reviews(timed_reviews(spark, sf))


@check("flagship_reviewed_books", """
    SELECT r.book_id, count(*) AS n_reviews, round(CAST(sum(r.rating) AS DOUBLE) / count(r.rating), 6) AS rating,
      CAST(sum(r.n_votes) AS BIGINT) AS n_votes, median(r.read_duration) AS read_duration,
      any_value(b.title) AS title, any_value(b.average_rating) AS average_rating,
      any_value(s.total_shelves_count) AS total_shelves_count,
      any_value(CASE WHEN len(b.series) > 0 THEN 'Y' ELSE 'N' END) AS is_series
    FROM clean_reviews r LEFT JOIN book_facts b USING (book_id) LEFT JOIN shelf_totals s USING (book_id)
    GROUP BY 1""", ("clean_reviews", "book_facts", "shelf_totals"))
def flagship(spark, sf):
    """Clean, count words, time, roll up and join the book features."""
    rolled = prepare.cleaned_rollup(d.reviews(spark, sf))
    books = prepare.book_features(d.books(spark, sf, "popular_shelves"))
    return joins.add_book_features(rolled, books).select(
        "book_id", "n_reviews", F.round("rating", 6).alias("rating"), "n_votes", "read_duration",
        "title", "average_rating", "total_shelves_count", "is_series",
    )


@check("base_table_pipeline", f"""
    SELECT r.book_id, r.part, r.n, r.chars, b.title, b.publisher,
      coalesce(a.names, '') AS author_names, s.total_shelves_count
    FROM (SELECT book_id, CAST(0 AS BIGINT) AS part, count(*) AS n, CAST(sum(length(review_text)) AS BIGINT) AS chars
          FROM clean_reviews GROUP BY 1) r
    JOIN book_facts b USING (book_id) JOIN described t USING (book_id) LEFT JOIN shelf_totals s USING (book_id)
    LEFT JOIN (SELECT book_id, string_agg(s_name, '|' ORDER BY author_id) AS names
               FROM author_pairs JOIN supplier ON s_suppkey = author_id GROUP BY 1) a USING (book_id)
    WHERE starts_with(t.language_code, 'en')""",
       ("clean_reviews", "book_facts", "described", "shelf_totals", "author_pairs"))
def base_pipeline(spark, sf):
    """The stored batch from language filter to base table, with its review lists."""
    books = d.books(spark, sf, "similar_books", "popular_shelves", "authors", "description")
    out = prepare.prepare(
        spark, work_path(spark, "prepare"), books, d.reviews(spark, sf), d.authors(spark, sf))
    full = prepare.with_reviews(out["base"], out["review_lists"])
    chars = F.aggregate("review_text", F.lit(0).cast("long"), lambda acc, t: acc + F.length(t))
    return full.select(
        "book_id", "part", F.size("review_text").cast("long").alias("n"), chars.alias("chars"),
        "title", "publisher", F.array_join("author_names", "|").alias("author_names"), "total_shelves_count")


@check("j01_reviews_for_books", """
    SELECT review_id FROM reviews JOIN described USING (book_id) WHERE starts_with(language_code, 'en')""",
       ("reviews", "described"))
def reviews_for_books(spark, sf):
    english = filters.filter_language(d.descriptions(spark, sf))
    return joins.reviews_for_books(d.reviews(spark, sf, text=False), english).select("review_id")


@check("j02_add_book_features", """
    SELECT book_id, n_reviews, n_votes, title, num_pages FROM rollup LEFT JOIN book_facts USING (book_id)""",
       ("rollup", "book_facts"))
def add_book_features(spark, sf):
    joined = joins.add_book_features(rollup(spark, sf), d.book_facts(spark, sf))
    return joined.select("book_id", "n_reviews", "n_votes", "title", "num_pages")


@check("j03_add_author_names", """
    SELECT book_id, coalesce(names, '') AS author_names FROM book_facts LEFT JOIN
      (SELECT book_id, string_agg(s_name, '|' ORDER BY author_id) AS names
       FROM author_pairs JOIN supplier ON s_suppkey = author_id GROUP BY 1) USING (book_id)""",
       ("book_facts", "author_pairs"))
def add_author_names(spark, sf):
    named = joins.add_author_names(d.books(spark, sf, "authors"), d.authors(spark, sf))
    return named.select("book_id", F.array_join("author_names", "|").alias("author_names"))


@check("j07_timeline", f"""
    WITH known AS (SELECT CAST(era_order AS DOUBLE) AS era_order, era_order AS era_text, book_id, title
                   FROM era_rows WHERE era_order <> 'x'),
    sized AS (SELECT era_order, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS parts, count(*) AS n FROM known GROUP BY 1)
    SELECT k.era_order, any_value('Era ' || era_text) AS era,
      CASE WHEN n > 1000 THEN {bucket("book_id", "parts")} ELSE 0 END AS part,
      count(*) AS cards, md5(string_agg(book_id || title, ',' ORDER BY book_id)) AS digest
    FROM known k JOIN sized USING (era_order) GROUP BY k.era_order, part""", ("era_rows",))
def eras(spark, sf):
    rows = timeline.timeline(d.eras(spark, sf), d.era_books(spark, sf))
    text = F.array_join(F.transform("book_cards", lambda c: F.concat(c["book_id"].cast("string"), c["title"])), ",")
    return rows.select(
        "era_order", "era", "part", F.size("book_cards").cast("long").alias("cards"), F.md5(text).alias("digest"))


@check("j08_only_new", """
    SELECT book_id FROM book_facts WHERE book_id NOT IN (SELECT id FROM cents)""", ("book_facts", "cents"))
def only_new(spark, sf):
    done = d.scores(spark, sf).select(F.col("id").alias("book_id"))
    return joins.only_new(d.book_facts(spark, sf).select("book_id"), done)


@check("a01_rollup_reviews", """
    SELECT book_id, n_reviews, round(rating, 6) AS rating, n_votes, read_duration FROM rollup""", ("rollup",))
def rollup_reviews(spark, sf):
    return rollup(spark, sf).withColumn("rating", F.round("rating", 6))


@check("a01_rollup_mean_duration", """
    SELECT book_id, round(avg(read_duration), 6) AS read_duration FROM reviews GROUP BY 1""", ("reviews",))
def rollup_mean(spark, sf):
    mean = rollups.rollup_reviews(timed_reviews(spark, sf), "mean")
    return mean.select("book_id", F.round("read_duration", 6).alias("read_duration"))


@check("a01_review_lists", f"""
    SELECT book_id, CASE WHEN n > 32 THEN {bucket("review_id", "CAST(ceil(n / 32.0) AS BIGINT)")} ELSE 0 END AS part,
      count(*) AS reviews, CAST(sum(length(review_text)) AS BIGINT) AS chars,
      md5(string_agg(review_text, ',' ORDER BY review_id)) AS digest
    FROM clean_reviews JOIN (SELECT book_id, count(*) AS n FROM clean_reviews GROUP BY 1) USING (book_id)
    GROUP BY 1, 2""", ("clean_reviews",))
def review_lists(spark, sf):
    """Lists of 32, so that many books need more than one."""
    lists = rollups.review_lists(rollups.clean_reviews(d.reviews(spark, sf)), size=32)
    return lists.select(
        "book_id", "part", F.size("review_text").cast("long").alias("reviews"),
        F.aggregate("review_text", F.lit(0).cast("long"), lambda acc, t: acc + F.length(t)).alias("chars"),
        F.md5(F.array_join("review_text", ",")).alias("digest"))


_IQR = """
    SELECT review_id, read_duration FROM reviews JOIN
      (SELECT book_id, quantile_cont(read_duration, 0.25) AS q1, quantile_cont(read_duration, 0.75) AS q3
       FROM reviews GROUP BY 1) USING (book_id)
    WHERE read_duration BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""


@check("f14_remove_outliers_iqr", _IQR, ("reviews",))
def remove_outliers(spark, sf):
    rows = written(timed_reviews(spark, sf).select("book_id", "review_id", "read_duration"), "reviews")
    kept = rollups.remove_outliers_iqr(rows, "book_id", "read_duration")
    return kept.select("review_id", "read_duration")


@check("v02_apply_groups", _IQR, ("reviews",))
def apply_groups(spark, sf):
    rows = written(timed_reviews(spark, sf).select("book_id", "review_id", "read_duration"), "reviews")
    quartiles = rollups.keyed_quantiles(rows, "book_id", "read_duration", {"q1": 0.25, "q3": 0.75})

    def inside(frame):
        q1, q3, v = (frame[c].to_numpy() for c in ("q1", "q3", "read_duration"))
        reach = 1.5 * (q3 - q1)
        kept = (v >= q1 - reach) & (v <= q3 + reach)
        return pd.DataFrame({c: frame[c].to_numpy()[kept] for c in ("review_id", "read_duration")})

    return custom.apply_groups(
        rows, "book_id", inside, "review_id string, read_duration double", "review_id", quartiles)


@check("v02_fold_groups", """
    SELECT l_returnflag, count(*) AS n, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, min(CAST(l_shipdate AS VARCHAR)) AS first,
      round(var_pop(CAST(l_quantity AS DOUBLE)), 6) AS spread FROM lineitem GROUP BY 1""")
def fold_groups(spark, sf):
    """Groups far above the slice size: one answer each."""
    class Spread:
        def init(self):
            return 0, 0.0, 0.0, set(), None  # rows, mean, squares, suppliers, least date

        def update(self, state, frame):
            v = frame["quantity"]
            mean = v.mean()
            return self.merge(state, (len(v), mean, ((v - mean) ** 2).sum(), set(frame["l_suppkey"]), frame["shipped"].min()))

        def merge(self, a, b):
            n = a[0] + b[0]
            apart = b[1] - a[1]
            least = min(x for x in (a[4], b[4]) if x is not None)
            return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart**2 * a[0] * b[0] / n, a[3] | b[3], least

        def finish(self, state):
            import pandas as pd

            n, _, squares, suppliers, least = state
            return pd.DataFrame({"n": [n], "suppliers": [len(suppliers)], "first": [least], "spread": [squares / n]})

    lines = d.table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("double").alias("quantity"), "l_suppkey", F.col("l_shipdate").cast("string").alias("shipped"),
        F.struct("l_orderkey", "l_linenumber").cast("string").alias("line"))
    found = custom.fold_groups(
        lines, "l_returnflag", Spread(), "n bigint, suppliers bigint, first string, spread double", "line", size=500)
    return found.withColumn("spread", F.round("spread", 6))


@check("v01_apply_rows", """
    SELECT p_partkey AS book_id, length(p_name) + p_size AS v FROM part""")
def apply_rows(spark, sf):
    parts = d.table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), "p_name", "p_size")

    def fn(frame):
        return frame.assign(v=frame["p_name"].str.len() + frame["p_size"])[["book_id", "v"]]

    return custom.apply_rows(parts, fn, "book_id bigint, v bigint")


@check("a02_country_counts", """
    SELECT country, capital_latlng[1] AS lat, capital_latlng[2] AS lng, n AS count_books FROM
      (SELECT country, any_value(capital_latlng) AS capital_latlng, count(DISTINCT book_id) AS n FROM locations GROUP BY 1)""",
       ("locations",))
def country_counts(spark, sf):
    counts = rollups.country_counts(d.book_locations(spark, sf))
    return counts.select(
        "country", F.get("capital_latlng", 0).alias("lat"), F.get("capital_latlng", 1).alias("lng"), "count_books")


@check("a03_value_counts", "SELECT rating, count(*) AS count FROM reviews GROUP BY 1", ("reviews",))
def value_counts(spark, sf):
    return rollups.value_counts(d.reviews(spark, sf, text=False), "rating")


@check("a04_votes_per_review", """
    SELECT review_id, CAST(sum(n_votes) AS BIGINT) AS n_votes FROM reviews GROUP BY 1""", ("reviews",))
def votes_per_review(spark, sf):
    return rollups.votes_per_review(d.reviews(spark, sf, text=False))


@check("a05_group_records", f"""
    SELECT o_custkey, CASE WHEN n > 16 THEN {bucket("o_orderkey", "CAST(ceil(n / 16.0) AS BIGINT)")} ELSE 0 END AS part,
      count(*) AS records, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) AS text
    FROM orders JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1, 2""")
def group_records(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    lists = rollups.group_records(orders, "o_custkey", "o_orderkey", size=16)
    text = F.transform("book_cards", lambda c: F.concat(c["o_orderkey"].cast("string"), c["o_orderstatus"]))
    return lists.select(
        "o_custkey", "part", F.size("book_cards").cast("long").alias("records"), F.array_join(text, ",").alias("text"))


@check("a06_count_by", "SELECT lang, count(*) AS count FROM documents GROUP BY 1")
def count_by(spark, sf):
    return rollups.count_by(d.table(spark, sf, "documents"), "lang")


@check("a07_most_reviewed", """
    SELECT book_id, count(*) AS n_reviews FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", ("reviews",))
def most_reviewed(spark, sf):
    return rollups.most_reviewed(rollup(spark, sf), 20)


@check("a08_histogram", """
    WITH e AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM documents)
    SELECT CAST(least(floor((length(text) - CAST(lo AS DOUBLE)) / (CAST(hi - lo AS DOUBLE) / CAST(50 AS DOUBLE))), 49) AS BIGINT) AS bin,
      count(*) AS count FROM documents, e GROUP BY 1""")
def histogram(spark, sf):
    sized = d.table(spark, sf, "documents").select(F.length("text").alias("n"))
    return rollups.histogram(sized, "n")


@check("a09_share_of_max", """
    SELECT era_order, count(*) AS books,
      CAST(trunc(CAST(count(*) AS DOUBLE) / max(count(*)) OVER () * 100) AS BIGINT) AS share
    FROM era_rows GROUP BY 1""", ("era_rows",))
def share_of_max(spark, sf):
    return rollups.share_of_max(d.eras(spark, sf).select("era_order", "books"), "books")


@check("a10_compare_models", """
    WITH top AS (SELECT l_partkey AS book_id, l_suppkey AS s,
        row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS r1,
        row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r2
      FROM lineitem GROUP BY 1, 2)
    SELECT book_id, string_agg(s, ',' ORDER BY r1) FILTER (r1 <= 10) AS by_sum,
      string_agg(s, ',' ORDER BY r2) FILTER (r2 <= 10) AS by_count,
      count(*) FILTER (r1 <= 10 AND r2 <= 10) AS shared
    FROM top WHERE book_id IN (SELECT p_partkey FROM part ORDER BY md5(p_partkey || '|42'), p_partkey LIMIT 50)
    GROUP BY 1""")
def compare_models(spark, sf):
    """Two rankings of each part's suppliers stand in for two models."""
    sums = d.table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("neighbour")
    ).agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))

    def lists(model, score):
        best = ordering.top_k_per_group(sums, "id", [F.desc(score), F.asc("neighbour")], 10)
        from ..operators.neighbours import as_lists

        return as_lists(best).withColumn("model", F.lit(model))

    both = lists("by_sum", "q").unionByName(lists("by_count", "n"))
    ids = ordering.sample_ids(d.book_facts(spark, sf), 50)
    wide = rollups.compare_models(both, ids, ["by_sum", "by_count"])
    return wide.select(
        "book_id", F.array_join("by_sum", ",").alias("by_sum"), F.array_join("by_count", ",").alias("by_count"),
        F.col("by_sum_by_count_shared").alias("shared"))


@check("w03_top_k_per_group", """
    SELECT o_custkey, o_orderkey, rank FROM
      (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
       FROM orders) WHERE rank <= 3""")
def top_k(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.top_k_per_group(
        orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@check("w04_first_per_key", """
    SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def first_per_key(spark, sf):
    orders = d.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return joins.first_per_key(orders, "o_custkey", [F.asc("o_orderkey")])
