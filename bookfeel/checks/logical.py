"""The logical tables as SQL over the test tables, for the oracle queries.

Written independently of the Spark adapters: each entry is one common table
expression with the names of those it reads.
"""

from __future__ import annotations

from ..operators.search import NO_COVER

_LATLNG = "[CAST(n_nationkey AS DOUBLE) * 2.5 - 30, CAST(n_nationkey AS DOUBLE) * 5 - 60]"

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "book_facts": ((), f"""
        SELECT p_partkey AS book_id, p_name AS title, p_brand AS publisher, p_type AS format,
          CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS BIGINT) END AS num_pages,
          CAST(1 AS DOUBLE) + CAST(p_partkey * 7 % 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS average_rating,
          CAST(p_partkey * 37 % 1000 AS BIGINT) AS ratings_count,
          CAST(1950 + p_partkey % 70 AS BIGINT) AS publication_year,
          CASE WHEN p_size % 3 = 0 THEN [p_brand] ELSE CAST([] AS VARCHAR[]) END AS series,
          CASE WHEN p_partkey % 10 = 0 THEN '{NO_COVER}'
               WHEN p_partkey % 17 <> 0 THEN 'img/' || p_partkey END AS image_url,
          'book/' || p_partkey AS url
        FROM part"""),
    "edition_groups": ((), """
        SELECT list_sort(list(p_partkey)) AS members FROM part GROUP BY p_name, p_brand"""),
    "editions": (("edition_groups",), """
        SELECT unnest(members) AS book_id,
          CASE WHEN len(members) > 1 THEN members ELSE CAST([] AS BIGINT[]) END AS similar_books
        FROM edition_groups"""),
    "shelf_counts": ((), """
        SELECT l_partkey AS book_id, l_returnflag AS name, count(*) AS n
        FROM lineitem GROUP BY 1, 2"""),
    "shelf_totals": (("shelf_counts",), """
        SELECT book_id, CAST(sum(n) AS BIGINT) AS total_shelves_count FROM shelf_counts GROUP BY 1"""),
    "base": (("book_facts", "editions", "shelf_totals"), """
        SELECT b.*, e.similar_books, coalesce(s.total_shelves_count, 0) AS total_shelves_count
        FROM book_facts b JOIN editions e USING (book_id) LEFT JOIN shelf_totals s USING (book_id)"""),
    "author_pairs": ((), """
        SELECT DISTINCT l_partkey AS book_id, l_suppkey AS author_id
        FROM lineitem"""),
    "described": ((), """
        SELECT p_partkey AS book_id, text AS description, lang AS language_code
        FROM part JOIN documents ON doc_id = p_partkey % (SELECT count(*) FROM documents)"""),
    # Dates at midnight, so hours are whole; line 7 has no dates.
    "reviews": ((), """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS review_id,
          l_partkey AS book_id, CAST(o_custkey AS VARCHAR) AS user_id, l_orderkey,
          CAST(l_quantity AS BIGINT) % 6 AS rating, CAST(l_linenumber - 1 AS BIGINT) AS n_votes,
          CASE WHEN l_linenumber <> 7 THEN o_orderdate END AS started,
          CASE WHEN l_linenumber <> 7 THEN l_shipdate END AS finished,
          CASE WHEN l_linenumber <> 7 AND l_shipdate >= o_orderdate
               THEN CAST(date_diff('second', o_orderdate, l_shipdate) AS DOUBLE) / 3600 END AS read_duration
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "worded": ((), r"""
        SELECT doc_id, text,
          len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words
        FROM documents"""),
    "clean_reviews": (("reviews", "worded"), """
        SELECT r.*, w.text AS review_text FROM reviews r
        JOIN worded w ON w.doc_id = r.l_orderkey % (SELECT count(*) FROM documents)
        WHERE w.words > 50"""),
    "rollup": (("reviews",), """
        SELECT book_id, count(*) AS n_reviews, CAST(sum(rating) AS DOUBLE) / count(rating) AS rating,
          CAST(coalesce(sum(n_votes), 0) AS BIGINT) AS n_votes, median(read_duration) AS read_duration
        FROM reviews GROUP BY 1"""),
    "cents": ((), """
        SELECT event_id // 8 AS id, event_type AS label,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM events GROUP BY 1, 2"""),
    "label_scores": (("cents",), """
        SELECT id, label,
          coalesce(CAST(cents AS DOUBLE) / nullif(CAST(sum(cents) OVER (PARTITION BY id) AS DOUBLE), 0), 0) AS score
        FROM cents"""),
    "ranked_scores": (("label_scores",), """
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r
        FROM label_scores"""),
    "features": (("ranked_scores",), """
        SELECT id AS book_id,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (score >= 0.4::DOUBLE OR r = 1), '') AS emotions,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (score >= 0.5::DOUBLE OR (r = 1 AND score >= 0.3::DOUBLE)), '') AS content_intensity,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (r = 1 AND score >= 0.6::DOUBLE), '') AS romance_heat_level,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (r = 1 AND score >= 0.3::DOUBLE), '') AS character_type,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (score >= 0.3::DOUBLE OR (r = 1 AND score >= 0.2::DOUBLE)), '') AS main_themes,
          coalesce(string_agg(label, ', ' ORDER BY r) FILTER (r = 1 AND score >= 0.25::DOUBLE), '') AS pace,
          max(CASE WHEN r = 1 THEN label END) AS sentiment
        FROM ranked_scores GROUP BY 1"""),
    "countries": ((), f"""
        SELECT n_name AS name, r_name AS region, {_LATLNG} AS capital_latlng
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 15"""),
    "locations": ((), f"""
        SELECT c_custkey AS book_id, n_name AS country, r_name AS region, {_LATLNG} AS capital_latlng,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'direct_country' WHEN 'AUTOMOBILE' THEN 'geocoded'
               ELSE 'not_found' END AS resolved_as
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    # What each nation name resolves to as a place.
    "atlas": ((), f"""
        SELECT n_name AS place, n_nationkey AS k,
          CASE WHEN n_nationkey < 15 THEN n_name WHEN n_nationkey < 20 THEN 'NATION_' || (n_nationkey - 15)
               WHEN n_nationkey = 21 THEN 'ATLANTIS' END AS country,
          CASE WHEN n_nationkey < 15 THEN 'direct_country' WHEN n_nationkey < 20 THEN 'geocoded'
               WHEN n_nationkey = 20 THEN 'country_not_found' WHEN n_nationkey = 21 THEN 'geocoded'
               ELSE 'not_found' END AS resolved_as
        FROM nation"""),
    "entities": ((), """
        SELECT event_id // 8 AS id, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'LOC' ELSE 'PER' END AS entity_group,
          value / 500 AS score, n_name AS word
        FROM events JOIN nation ON user_id % 25 = n_nationkey"""),
    "loc_ranked": (("entities",), """
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, event_id) AS best,
          count(*) FILTER (score > 0.8::DOUBLE) OVER (PARTITION BY id) AS strong
        FROM entities WHERE entity_group = 'LOC'"""),
    "places": (("loc_ranked",), """
        SELECT id, word, min(event_id) AS seen FROM loc_ranked
        WHERE CASE WHEN strong > 0 THEN score > 0.8::DOUBLE ELSE best = 1 END GROUP BY id, word"""),
    "extended": (("base", "features", "locations", "rollup"), """
        SELECT b.book_id, r.n_votes, r.read_duration, b.average_rating, b.num_pages, b.ratings_count,
          b.total_shelves_count, CASE WHEN len(b.series) > 0 THEN 'Y' ELSE 'N' END AS is_series,
          b.publisher AS author_names, f.emotions, f.content_intensity, f.romance_heat_level,
          f.character_type, f.main_themes, f.pace, f.sentiment, l.country, l.region
        FROM base b LEFT JOIN rollup r USING (book_id) LEFT JOIN features f USING (book_id)
        LEFT JOIN locations l USING (book_id)"""),
    "era_rows": ((), """
        SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'x' END AS era_order,
          o_orderkey AS book_id, o_orderpriority AS title, o_orderdate
        FROM orders"""),
    "labelled": ((), """
        SELECT doc_id AS id, text, quality AS target FROM documents JOIN labels USING (doc_id)"""),
}


def query(body: str, *needs: str) -> str:
    """The body with the logical tables it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in TABLES[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    body = body.strip()
    if not order:
        return body
    ctes = [f"{name} AS ({TABLES[name][1].strip()})" for name in order]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def bucket(expression: str, buckets: str) -> str:
    """The md5-prefix bucket in SQL."""
    return f"(CAST('0x' || substr(md5(CAST({expression} AS VARCHAR)), 1, 8) AS BIGINT) % ({buckets}))"
