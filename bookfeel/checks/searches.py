"""Look-ups, searches, places and label selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import spread, work_path, written
from ..operators import enrich, joins, places, recogniser, search, text_index, word_vectors
from ..plans import serve
from ..sources import driver_tables as d
from ..sources import tables
from .registry import check

# Thresholds at which the test scores fall on both sides.
CUTS = {
    "content_intensity": (True, 0.5, 0.3), "romance_heat_level": (False, 0.8, 0.6),
    "character_type": (False, 0.8, 0.3), "main_themes": (True, 0.3, 0.2), "pace": (False, 0.8, 0.25),
}


def scored(spark, sf):
    return d.scores(spark, sf).select(
        F.col("id").alias("book_id"), enrich.by_score(F.col("scores")).alias("scores"))


def feature_tables(spark, sf):
    rows = scored(spark, sf)
    out = [enrich.select_emotions(rows).select("book_id", "emotions")]
    for task, (multi, high, low) in CUTS.items():
        out.append(enrich.select_labels(rows, task, "scores", high, low, multi).select("book_id", task))
    out.append(enrich.top_label(rows).select("book_id", "sentiment"))
    return out


def features(spark, sf):
    """All seven features from one pass over the scores."""
    rows = enrich.select_emotions(scored(spark, sf))
    for task, (multi, high, low) in CUTS.items():
        rows = enrich.select_labels(rows, task, "scores", high, low, multi)
    rows = enrich.top_label(rows)
    return rows.select("book_id", "emotions", *CUTS, "sentiment")


def stored(spark, sf):
    """Features and base as stored tables, for queries that search them often. The lists of
    editions stay out: a search by features reads none, and on every book of a group they would
    take the square of its size."""
    return written(features(spark, sf), "features"), written(d.base(spark, sf).drop("similar_books"), "base")


def as_text(df: DataFrame) -> DataFrame:
    """Array columns as comma lists, for comparison."""
    return df.select(*[search.as_text(df, c).alias(c) if f.dataType.typeName() == "array" else F.col(c)
                       for c, f in zip(df.columns, df.schema.fields)])


@check("f06_get_book", """
    SELECT CAST(book_id AS VARCHAR) AS book_id, title, image_url, array_to_string(series, ', ') AS series, url,
      CAST(num_pages AS VARCHAR) AS num_pages, description, CAST(average_rating AS VARCHAR) AS average_rating,
      CAST(publication_year AS VARCHAR) AS publication_year
    FROM book_facts JOIN described USING (book_id) WHERE book_id = 7""", ("book_facts", "described"))
def get_book(spark, sf):
    return search.get_book(d.books(spark, sf, "description"), 7)


@check("f07_filter_ids", """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) OR o_orderstatus IN ('P')""")
def filter_ids(spark, sf):
    orders = d.table(spark, sf, "orders")
    rich = d.table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    listed = search.filter_ids(orders, "o_custkey", rich)
    pending = search.filter_ids(orders, "o_orderstatus", ["P"])
    return listed.union(pending).select("o_orderkey", "o_custkey").distinct()


_TITLE = """
    SELECT book_id, title, average_rating, total_shelves_count FROM (
      SELECT *, row_number() OVER (PARTITION BY similar_books
        ORDER BY total_shelves_count DESC, ratings_count DESC, book_id) AS rn
      FROM base WHERE lower(title) LIKE lower('%RED%')) WHERE rn = 1
    ORDER BY total_shelves_count DESC, average_rating DESC, book_id"""


@check("f08_search_title", _TITLE + " LIMIT 10", ("base",))
def search_title(spark, sf):
    hits = search.search_title(d.base(spark, sf), "RED")
    return hits.select("book_id", "title", "average_rating", "total_shelves_count")


@check("f08_search_title_index", _TITLE + " LIMIT 10", ("base",))
def search_title_index(spark, sf):
    """The same answer from the trigram index. The lists of editions are not stored with the titles, where
    they would take the square of a group's size; the rows found get theirs."""
    base = written(d.base(spark, sf).drop("similar_books"), "base")
    index = text_index.build(base, work_path(spark, "titles"), "book_id", "title", base.columns)
    hits = search.search_title(base, "RED", index=index, complete=lambda rows: d.add_editions(spark, sf, rows))
    return hits.select("book_id", "title", "average_rating", "total_shelves_count")


@check("f08_contains_texts", """
    SELECT p.pattern, doc_id FROM documents, (VALUES ('tion '), ('er%the'), ('hou'), ('q_u'), ('zz'), ('no such text')) p(pattern)
    WHERE lower(text) LIKE '%' || p.pattern || '%'""")
def contains_texts(spark, sf):
    """Patterns with and without wildcards, common and rare, in all documents."""
    index = text_index.build(d.documents(spark, sf), work_path(spark, "texts"), "doc_id", "text")
    return reduce(DataFrame.union, [
        index.search(p).select(F.lit(p).alias("pattern"), "doc_id") for p in ("tion ", "er%the", "hou", "q_u", "zz", "no such text")])


@check("f06_get_books_stored", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (7, 1, 33) OR o_orderkey = -5""")
def get_stored(spark, sf):
    """Rows by key from a table stored in its order."""
    orders = d.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    stored_ = tables.write_keyed(orders, work_path(spark, "orders"), "o_orderkey")
    keys = spark.createDataFrame([(7,), (1,), (33,), (-5,)], "o_orderkey long")
    return tables.look_up(stored_, "o_orderkey", keys)


@check("w02_dedupe_editions", _TITLE, ("base",))
def dedupe_editions(spark, sf):
    hits = search.search_title(d.base(spark, sf), "RED", n=None)
    return hits.select("book_id", "title", "average_rating", "total_shelves_count")


def _feature_sql(feature, value, limit="LIMIT 10", direction=""):
    return f"""
    SELECT '{feature}' AS feature, f.book_id FROM features f JOIN base b USING (book_id)
    WHERE lower(f.{feature}) LIKE lower('%{value}%') AND b.image_url <> '{search.NO_COVER}'
    ORDER BY b.total_shelves_count {direction}, b.ratings_count {direction}, f.book_id {limit}"""


_WANTED = {
    "emotions": "Click", "content_intensity": "view", "romance_heat_level": "error", "character_type": "sign",
    "main_themes": "purchase", "pace": "click", "sentiment": "e",
}


@check("f09_ids_by_feature", " UNION ALL ".join(f"SELECT * FROM ({_feature_sql(k, v)})" for k, v in _WANTED.items()),
       ("features", "base"))
def ids_by_feature(spark, sf):
    found, base = stored(spark, sf)
    return reduce(DataFrame.union, [
        search.ids_by_feature(found, base, k, v).select(F.lit(k).alias("feature"), "book_id")
        for k, v in _WANTED.items()])


@check("j06_features_with_base", _feature_sql("emotions", "click", "", "DESC"), ("features", "base"))
def features_with_base(spark, sf):
    ids = search.ids_by_feature(features(spark, sf), d.base(spark, sf), "emotions", "click", n=None, descending=True)
    return ids.select(F.lit("emotions").alias("feature"), "book_id")


@check("f15_find_book", f"""
    SELECT CAST(book_id AS VARCHAR) AS book_id, title, CAST(average_rating AS VARCHAR) AS average_rating
    FROM ({_TITLE} LIMIT 10) UNION ALL
    SELECT CAST(book_id AS VARCHAR), title, CAST(average_rating AS VARCHAR) FROM base WHERE book_id = 7""", ("base",))
def find_book(spark, sf):
    base = written(d.base(spark, sf), "base")
    columns = ["book_id", "title", "average_rating"]
    return search.find_book(base, " 7 ").select(*columns).union(search.find_book(base, "red").select(*columns))


@check("j05_ids_by_country", """
    SELECT book_id, title, country, region, resolved_as, average_rating, total_shelves_count FROM (
      SELECT *, row_number() OVER (PARTITION BY similar_books
        ORDER BY total_shelves_count DESC, ratings_count DESC, book_id) AS rn
      FROM locations JOIN base USING (book_id) WHERE lower(country) = lower('nation_3')) WHERE rn = 1""",
       ("locations", "base"))
def ids_by_country(spark, sf):
    return search.ids_by_country(d.book_locations(spark, sf), d.base(spark, sf), "nation_3")


@check("t03_order_by_resolution", """
    SELECT book_id, resolved_as, total_shelves_count FROM locations JOIN base USING (book_id)
    ORDER BY CASE resolved_as WHEN 'direct_country' THEN 1 WHEN 'geocoded' THEN 2 ELSE 3 END,
      total_shelves_count DESC, average_rating DESC, book_id""", ("locations", "base"))
def order_by_resolution(spark, sf):
    both = d.book_locations(spark, sf).join(d.base(spark, sf), "book_id")
    return search.order_by_resolution(both).select("book_id", "resolved_as", "total_shelves_count")


_W1 = """
    SELECT book_id, title, total_shelves_count, average_rating FROM (
      SELECT *, row_number() OVER (PARTITION BY
          CASE WHEN len(similar_books) = 0 THEN CAST(book_id AS VARCHAR) ELSE 'l' || array_to_string(similar_books, ',') END
        ORDER BY total_shelves_count DESC, image_url NULLS FIRST, book_id) AS rn
      FROM base {where}) WHERE rn = 1
    ORDER BY total_shelves_count DESC, image_url NULLS FIRST, average_rating DESC, book_id {limit}"""
_CARD = ["book_id", "title", "total_shelves_count", "average_rating"]


@check("w01_dedupe_editions_guarded", _W1.format(where="", limit=""), ("base",))
def dedupe_editions_guarded(spark, sf):
    return search.dedupe_editions_guarded(d.base(spark, sf), None).select(*_CARD)


@check("j10_hydrate", _W1.format(where="WHERE book_id IN (SELECT book_id FROM locations WHERE country = 'NATION_3')", limit="LIMIT 10"),
       ("base", "locations"))
def hydrate(spark, sf):
    ids = d.book_locations(spark, sf).filter("country = 'NATION_3'").select("book_id")
    return search.hydrate(d.base(spark, sf), ids).select(*_CARD)


_CRITERIA = {"emotions": ["click", "view"], "main_themes": ["purchase", "error"], "sentiment": "e"}


@check("u01_filter_books", f"""
    SELECT f.book_id FROM features f JOIN base b USING (book_id) WHERE b.image_url <> '{search.NO_COVER}'
      AND (emotions LIKE '%click%' OR emotions LIKE '%view%')
      AND (main_themes LIKE '%purchase%' OR main_themes LIKE '%error%') AND sentiment LIKE '%e%'""",
       ("features", "base"))
def filter_books(spark, sf):
    return search.filter_books(features(spark, sf), d.base(spark, sf), _CRITERIA)


def _ten(feature, value):
    return f"(SELECT book_id FROM ({_feature_sql(feature, value)}))"


@check("u01_filter_books_parity", f"""
    ({_ten("emotions", "click")} UNION {_ten("emotions", "view")} UNION {_ten("emotions", "e")})
    INTERSECT {_ten("sentiment", "e")}""", ("features", "base"))
def filter_books_parity(spark, sf):
    criteria = {"emotions": ["click", "view", "e"], "sentiment": "e"}
    return search.filter_books(*stored(spark, sf), criteria, parity=True)


@check("filtered_books_pipeline", _W1.format(where=f"""WHERE image_url <> '{search.NO_COVER}' AND book_id IN (
      SELECT book_id FROM features WHERE (emotions LIKE '%click%' OR emotions LIKE '%view%')
      AND (main_themes LIKE '%purchase%' OR main_themes LIKE '%error%') AND sentiment LIKE '%e%')""", limit="LIMIT 10"),
       ("features", "base"))
def filtered_books(spark, sf):
    return serve.filtered_books(features(spark, sf), d.base(spark, sf), _CRITERIA).select(*_CARD)


@check("u02_distinct_in_order", """
    SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY seen, l_returnflag) AS flags FROM
      (SELECT l_orderkey, l_returnflag, min(l_linenumber * 1000000 + l_suppkey) AS seen FROM lineitem GROUP BY 1, 2)
    GROUP BY 1""")
def distinct_in_order(spark, sf):
    from ..operators.rollups import distinct_in_order as distinct

    lines = d.table(spark, sf, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("place"), "l_returnflag")
    lists = distinct(lines, "l_orderkey", "l_returnflag", "place", "flags")
    return lists.select("l_orderkey", F.array_join("flags", ",").alias("flags"))


@check("m02_top_label", """
    SELECT id AS book_id, label AS sentiment, round(score, 6) AS sentiment_score FROM ranked_scores WHERE r = 1""",
       ("ranked_scores",))
def top_label(spark, sf):
    rows = enrich.top_label(scored(spark, sf))
    return rows.select("book_id", "sentiment", F.round("sentiment_score", 6).alias("sentiment_score"))


@check("m03_select_emotions", """
    SELECT f.book_id, f.emotions, label AS top_emotion, round(score, 6) AS top_score
    FROM features f JOIN ranked_scores s ON s.id = f.book_id AND r = 1""", ("features", "ranked_scores"))
def select_emotions(spark, sf):
    rows = as_text(enrich.select_emotions(scored(spark, sf)).drop("scores"))
    return rows.withColumn("top_score", F.round("top_score", 6))


@check("m04_select_labels", """
    SELECT book_id, content_intensity, romance_heat_level, character_type, main_themes, pace FROM features""",
       ("features",))
def select_labels(spark, sf):
    return as_text(features(spark, sf).select("book_id", *CUTS))


@check("j04_merge_features", "SELECT * FROM features", ("features",))
def merge_features(spark, sf):
    return as_text(joins.merge_features(feature_tables(spark, sf)))


@check("m05_select_locations", """
    SELECT id, coalesce(string_agg(word, '|' ORDER BY seen), '') AS places
    FROM (SELECT DISTINCT id FROM entities) LEFT JOIN places USING (id) GROUP BY 1""", ("entities", "places"))
def select_locations(spark, sf):
    rows = places.select_locations(d.entities(spark, sf))
    return rows.select("id", F.array_join("places", "|").alias("places"))


def customer_places(spark, sf):
    """The nation of every customer as a place, blank for some."""
    nations = d.table(spark, sf, "nation")
    place = F.when(F.col("c_mktsegment") == "HOUSEHOLD", " ").otherwise(F.lower("n_name"))
    return d.table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(F.col("c_custkey").alias("book_id"), place.alias("place"))


def resolved_columns(df):
    return df.select("book_id", "country", "region", F.get("capital_latlng", 0).alias("lat"), "resolved_as")


@check("j11_resolve_country", """
    SELECT c_custkey AS book_id, name AS country, region, capital_latlng[1] AS lat,
      CASE WHEN name IS NOT NULL THEN 'direct_country' END AS resolved_as
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN countries ON name = n_name AND c_mktsegment <> 'HOUSEHOLD'""", ("countries",))
def resolve_country(spark, sf):
    return resolved_columns(places.resolve_country(customer_places(spark, sf), d.countries(spark, sf)))


@check("j12_resolve_place", """
    SELECT c_custkey AS book_id, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN a.country END AS country, c.region,
      c.capital_latlng[1] AS lat, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'empty' ELSE a.resolved_as END AS resolved_as
    FROM customer JOIN atlas a ON c_nationkey = k
    LEFT JOIN countries c ON c.name = a.country AND c_mktsegment <> 'HOUSEHOLD'""", ("countries", "atlas"))
def resolve_place(spark, sf):
    countries = d.countries(spark, sf)
    direct = places.resolve_country(customer_places(spark, sf), countries)
    return resolved_columns(places.resolve_place(direct, d.gazetteer(spark, sf), countries))


@check("m06_book_locations", """
    SELECT p.id AS book_id, a.country, c.region, c.capital_latlng[1] AS lat, a.resolved_as
    FROM places p JOIN atlas a ON p.word = a.place LEFT JOIN countries c ON c.name = a.country""",
       ("places", "atlas", "countries"))
def book_locations(spark, sf):
    extracted = d.entities(spark, sf).withColumnRenamed("id", "book_id")
    return resolved_columns(places.locate(extracted, d.countries(spark, sf), d.gazetteer(spark, sf)))


@check("m06_known_places", r"""
    WITH worded AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: w <> '') AS w FROM documents),
    grams AS (SELECT doc_id, n, i AS pos, array_to_string(w[i:i + n - 1], ' ') AS word
              FROM worded, range(1, 4) t(n), unnest(range(1, CAST(greatest(len(w) - n + 2, 1) AS BIGINT))) u(i)),
    names AS (SELECT lower(word) AS name FROM grams GROUP BY 1 HAVING count(DISTINCT doc_id) BETWEEN 2 AND 3),
    found AS (SELECT doc_id, n, pos, word FROM grams JOIN names ON lower(word) = name),
    free AS (SELECT doc_id, word FROM found f WHERE NOT EXISTS (
      SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.n > f.n AND o.pos BETWEEN f.pos - 2 AND f.pos AND o.pos + o.n >= f.pos + f.n))
    SELECT doc_id, count(DISTINCT word) AS places FROM free GROUP BY 1""")
def known_places(spark, sf):
    """Runs of up to three words held by two or three documents stand in for place names."""
    docs = d.documents(spark, sf)
    # One move of the runs: the two steps of the count below need no other.
    runs = places.word_runs(docs, "text", "doc_id", 3, 4).repartition("name")
    names = runs.groupBy("name").agg(F.countDistinct("doc_id").alias("n")).filter("n between 2 and 3")
    found = places.select_locations(places.known_place_entities(docs, "text", names, key="doc_id"))
    return found.filter("size(places) > 0").select("doc_id", F.size("places").cast("long").alias("places"))


@check("m06_recogniser", """
    SELECT count(*) AS sentences, CAST(1 AS INTEGER) AS precise, CAST(1 AS INTEGER) AS complete FROM customer""")
def recognise_places(spark, sf):
    """A recogniser trained on sentences about customers of four nations in five finds all nations in all of them."""
    nation = F.col("n_name")
    said = F.array(
        F.array(F.lit("Clerk"), F.concat(F.lit("C"), F.col("c_custkey")), F.lit("lives"), F.lit("in"), nation, F.lit(".")),
        F.array(F.lit("They"), F.lit("sold"), F.col("c_mktsegment"), F.lit("near"), nation, F.lit("and"), F.lit("left"), F.lit(".")),
        F.array(F.lit("The"), F.lit("customer"), F.lit("came"), F.lit("from"), nation, F.lit("with"), F.col("c_mktsegment"), F.lit(".")),
        F.array(F.lit("No"), F.lit("place"), F.lit("for"), F.col("c_mktsegment"), F.lit("was"), F.lit("named"), F.lit(".")))
    rows = d.table(spark, sf, "customer").join(
        d.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_nationkey", nation, (F.col("c_custkey") % 4).alias("kind"),
        F.flatten(F.transform(F.get(said, (F.col("c_custkey") % 4).cast("int")), lambda w: F.split(w, " "))).alias("words"))
    name = F.split(nation, " ")
    first = F.array_position("words", F.get(name, 0)).cast("int")
    tags = F.transform("words", lambda w, i: F.when(F.col("kind") == 3, 0).when(i + 1 == first, 1).when(
        (i + 1 > first) & (i + 1 < first + F.size(name)), 2).otherwise(0))
    rows = written(rows.withColumn("tags", tags), "sentences")
    # On all cores: the stored sentences are a small file, the work on them is heavy.
    field = recogniser.fit(spread(rows.where("n_nationkey % 5 > 0"), "c_custkey"))
    texts = spread(rows, "c_custkey").select(
        "c_custkey", F.when(F.col("kind") != 3, nation).alias("true"), F.array_join("words", " ").alias("text"))
    found = written(places.extract_entities(texts, "text", recogniser.entity_model(field), "c_custkey"), "recognised")
    both = found.join(texts, "c_custkey").select(
        F.size("entities").alias("n"), F.col("true").isNotNull().cast("int").alias("wanted"),
        F.exists("entities", lambda e: F.coalesce(e["word"] == F.col("true"), F.lit(False))).cast("int").alias("hit"))
    return both.agg(
        F.count("*").alias("sentences"), (F.sum("hit") >= 0.95 * F.sum("n")).cast("int").alias("precise"),
        (F.sum("hit") >= 0.95 * F.sum("wanted")).cast("int").alias("complete"))


@check("m06_extract_entities", r"""
    SELECT doc_id, regexp_extract(text, '[^\s]+') AS first_word FROM documents
    WHERE regexp_matches(text, '[^\s]') AND regexp_matches(regexp_extract(text, '[^\s]+'), '^[A-Z]')""")
def extract_entities(spark, sf):
    """A toy recogniser that takes a capitalised first word for a place, and fails on others."""

    def load():
        def recognise(texts):
            firsts = [text.split()[0] for text in texts]
            if not all("A" <= word[0] <= "Z" for word in firsts):
                raise ValueError("no place")
            return [[{"entity_group": "LOC", "score": 0.9, "word": word}] for word in firsts]

        return recognise

    found = places.select_locations(places.extract_entities(d.documents(spark, sf), "text", load, "doc_id"))
    return found.select("doc_id", F.explode("places").alias("first_word"))


@check("j09_extended", """
    SELECT b.book_id, b.title, f.emotions, f.sentiment, l.country, l.region FROM base b
    LEFT JOIN features f USING (book_id) LEFT JOIN locations l USING (book_id)""", ("base", "features", "locations"))
def extended(spark, sf):
    rows = joins.extended(d.base(spark, sf), features(spark, sf), d.book_locations(spark, sf))
    return as_text(rows.select("book_id", "title", "emotions", "sentiment", "country", "region"))


# Cue words that do occur in the test texts.
CUES = {
    "calm": ["the", "and"], "loud": ["that", "with", "from"], "far": ["le", "de", "la"], "near": ["der", "die", "und"],
}


def _lexicon_sql(multi: bool) -> str:
    hits = ", ".join(
        f"len(list_filter(w, lambda x: x IN ({', '.join(repr(c) for c in cues)}))) AS {label}" for label, cues in CUES.items())
    total = "(" + " + ".join(CUES) + ")"
    score = "{0} / CAST({0} + 1 AS DOUBLE)" if multi else "({0} + 1) / CAST(" + total + f" + {len(CUES)} AS DOUBLE)"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS label, round({score.format(c)}, 6) AS score FROM hits" for c in CUES)
    return rf"""
    WITH words AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents),
    hits AS (SELECT doc_id, {hits} FROM words)
    SELECT doc_id, string_agg(label, ',' ORDER BY score DESC, label) AS labels, max(score) AS best FROM ({rows}) GROUP BY 1"""


def _ranked(rows):
    return rows.select(
        "doc_id", F.array_join(F.transform("scores", lambda s: s["label"]), ",").alias("labels"),
        F.round(F.get("scores", 0)["score"], 6).alias("best"))


@check("m01_score_text", _lexicon_sql(False))
def score_text(spark, sf):
    docs = d.documents(spark, sf)
    return _ranked(enrich.score_text(docs, "text", "doc_id", enrich.lexicon_scorer(CUES)))


@check("m01_score_text_model", _lexicon_sql(True))
def score_text_model(spark, sf):
    """The same scores from a Python model, fed in batches."""

    def load():
        import regex

        split = regex.compile(r"[^\p{L}]+")

        def predict(texts):
            out = []
            for text in texts:
                words = split.split(text.lower())
                hits = {name: sum(words.count(c) for c in cues) for name, cues in CUES.items()}
                out.append([(name, n / (n + 1)) for name, n in hits.items()])
            return out

        return predict

    docs = d.documents(spark, sf)
    return _ranked(enrich.score_text(docs, "text", "doc_id", model=load, batch=16))


@check("m07_enrich", """
    SELECT book_id, content_intensity, emotions, sentiment FROM features""", ("features",))
def enrich_incrementally(spark, sf):
    """Two runs: a part of the books, then all; the second adds the rest only."""
    rows = scored(spark, sf)
    tasks = {
        "emotions": lambda df: enrich.select_emotions(df).select("book_id", "emotions"),
        "content_intensity": lambda df: enrich.select_labels(
            df, "content_intensity", high=0.5, low=0.3).select("book_id", "content_intensity"),
        "sentiment": lambda df: enrich.top_label(df).select("book_id", "sentiment"),
    }
    root = work_path(spark, "features")
    enrich.enrich(rows.filter(F.get("scores", 0)["score"] > 0.4), root, tasks)
    return as_text(enrich.enrich(rows, root, tasks)).select("book_id", "content_intensity", "emotions", "sentiment")


def _default_tasks_sql() -> str:
    """The built-in scorer in SQL: one scored table per task, then its selection."""
    cues = {"emotions": (enrich.EMOTION_CUES, False), "sentiment": (enrich.SENTIMENT_CUES, False)}
    for task, spec in enrich.TASKS.items():
        cues[task] = (enrich.label_cues(spec["labels"]), spec["multi"])
    parts, picked, joins_ = [], [], []
    for task, (labels, multi) in cues.items():
        names = list(labels)
        counts = ", ".join(
            f"len(list_filter(w, lambda x: x IN ({', '.join(map(repr, labels[n]))}))) AS h{i}" for i, n in enumerate(names))
        # Cue words shared between labels are heard once per label.
        total = "(" + " + ".join(f"h{i}" for i in range(len(names))) + ")"
        score = "h{0} / CAST(h{0} + 1 AS DOUBLE)" if multi else "(h{0} + 1) / CAST(" + total + f" + {len(names)} AS DOUBLE)"
        rows = " UNION ALL ".join(
            f"SELECT doc_id, '{n}' AS label, {score.format(i)} AS score FROM h_{task}" for i, n in enumerate(names))
        if task == "emotions":
            keep = "score >= 0.4::DOUBLE OR r = 1"
        elif task == "sentiment":
            keep = "r = 1"
        elif multi:
            keep = "score >= 0.8::DOUBLE OR (r = 1 AND score >= 0.6::DOUBLE)"
        else:
            keep = "r = 1 AND score >= 0.6::DOUBLE"
        parts.append(f"""h_{task} AS (SELECT doc_id, {counts} FROM words),
    r_{task} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM ({rows})),
    t_{task} AS (SELECT doc_id, coalesce(string_agg(label, ', ' ORDER BY r) FILTER ({keep}), '') AS {task} FROM r_{task} GROUP BY 1)""")
        picked.append(task)
        joins_.append(f"JOIN t_{task} USING (doc_id)")
    return rf"""
    WITH words AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents),
    {", ".join(parts)}
    SELECT p_partkey AS book_id, {", ".join(picked)} FROM
      (SELECT p_partkey, p_partkey % (SELECT count(*) FROM documents) AS doc_id FROM part) {" ".join(joins_)}"""


@check("m07_default_tasks", _default_tasks_sql())
def default_tasks(spark, sf):
    """The cue-word scorers on every book description."""
    books = spread(d.descriptions(spark, sf), "book_id")
    return as_text(enrich.enrich(books, work_path(spark, "features"), features=enrich.lexicon_features))


@check("m01_word_pairs", r"""
    WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}]+') AS w FROM documents),
    t AS (SELECT doc_id, unnest(list_filter(w, lambda x: x <> '')) AS word, generate_subscripts(list_filter(w, lambda x: x <> ''), 1) AS i FROM d),
    kept AS (SELECT word FROM t GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, word LIMIT 500)
    SELECT a.word AS first, b.word AS second, count(*) AS n
    FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 5
    WHERE a.word IN (FROM kept) AND b.word IN (FROM kept) GROUP BY 1, 2""")
def word_pairs(spark, sf):
    """Pairs of words near one another, which the word vectors are made of."""
    docs = d.documents(spark, sf)
    words = [r["word"] for r in word_vectors.vocabulary(docs, "text", 500).collect()]
    names = spark.createDataFrame(list(enumerate(words)), "i int, word string")
    found = word_vectors.pairs(docs, "text", words)
    for place, name in (("a", "first"), ("b", "second")):
        found = found.join(F.broadcast(names.select(F.col("i").alias(place), F.col("word").alias(name))), place)
    return found.select("first", "second", "n")


@check("m07_corpus_tasks", """
    SELECT p_partkey AS book_id, CAST(1 AS INTEGER) AS emotions, CAST(1 AS INTEGER) AS single, CAST(1 AS INTEGER) AS several,
      CAST(1 AS INTEGER) AS sentiment FROM part""")
def corpus_tasks(spark, sf):
    """The scorer from the words of the descriptions: what must hold of any vectors."""
    books = spread(d.descriptions(spark, sf), "book_id")
    found = enrich.enrich(books, work_path(spark, "features"))

    def known(task):
        return F.size(F.array_except(task, F.array(*map(F.lit, enrich.TASKS[task]["labels"])))) == 0

    multi = [t for t in enrich.TASKS if enrich.TASKS[t]["multi"]]
    one = [t for t in enrich.TASKS if t not in multi]
    emotions = F.array(*map(F.lit, enrich.EMOTIONS))
    flags = {
        "emotions": (F.size("emotions") > 0) & (F.size(F.array_except("emotions", emotions)) == 0),
        "single": F.expr(" AND ".join(f"size({t}) <= 1" for t in one)) & known(one[0]) & known(one[1]) & known(one[2]),
        "several": known(multi[0]) & known(multi[1]), "sentiment": F.col("sentiment").isin(enrich.SENTIMENTS)}
    return found.select("book_id", *[flag.cast("int").alias(name) for name, flag in flags.items()])
