"""Label and place selection at their thresholds."""

from pyspark.sql import functions as F

from bookfeel.cluster import work_path
from bookfeel.operators import enrich, joins, places

SCORES = "id int, scores array<struct<label: string, score: double>>"


def scores(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], SCORES)


def test_order_of_scores(spark):
    df = scores(spark, [("b", 0.2), ("a", 0.2), ("c", 0.9)])
    assert [tuple(s) for s in df.select(enrich.by_score(F.col("scores"))).first()[0]] == [("c", 0.9), ("a", 0.2), ("b", 0.2)]


def test_emotions(spark):
    df = scores(spark, [("joy", 0.5), ("fear", 0.4), ("anger", 0.39)], [("joy", 0.3), ("fear", 0.2)], [])
    rows = enrich.select_emotions(df).orderBy("id").collect()
    assert [r["emotions"] for r in rows] == [["joy", "fear"], ["joy"], []]
    assert [(r["top_emotion"], r["top_score"]) for r in rows] == [("joy", 0.5), ("joy", 0.3), (None, None)]


def test_zero_shot_labels(spark):
    df = scores(spark, [("a", 0.9), ("b", 0.8), ("c", 0.79)], [("a", 0.6), ("b", 0.5)], [("a", 0.59)], [])
    many = [r[0] for r in enrich.select_labels(df, "main_themes").orderBy("id").select("main_themes").collect()]
    one = [r[0] for r in enrich.select_labels(df, "pace").orderBy("id").select("pace").collect()]
    assert many == [["a", "b"], ["a"], [], []]
    assert one == [["a"], ["a"], [], []]


def test_locations(spark):
    kind = "id int, entities array<struct<entity_group: string, score: double, word: string>>"
    rows = [
        (0, [("LOC", 0.95, " Paris "), ("PER", 0.99, "Ann"), ("LOC", 0.9, "Rome"), ("LOC", 0.85, "Paris")]),
        (1, [("LOC", 0.8, "Oslo"), ("LOC", 0.7, "Bern")]),  # 0.80 itself is not above it
        (2, [("PER", 0.9, "Ann")]),
        (3, []),
        (4, None),
    ]
    got = places.select_locations(spark.createDataFrame(rows, kind)).orderBy("id").collect()
    assert [r["places"] for r in got] == [["Paris", "Rome"], ["Oslo"], [], [], []]


def test_place_status(spark):
    countries = spark.createDataFrame([("France", "Europe", [48.0, 2.0])], "name string, region string, capital_latlng array<double>")
    atlas = spark.createDataFrame([("Lyon", "France"), ("Nowhere", None), ("Avalon", "Albion")], "place string, country string")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(["FRANCE", "lyon", "nowhere", "Mars", " ", "avalon"])], "book_id int, place string")
    got = places.resolve_place(places.resolve_country(asked, countries), atlas, countries).orderBy("book_id").collect()
    assert [(r["country"], r["region"], r["resolved_as"]) for r in got] == [
        ("France", "Europe", "direct_country"), ("France", "Europe", "geocoded"), (None, None, "country_not_found"),
        (None, None, "not_found"), (None, None, "empty"), ("Albion", None, "geocoded")]


def test_model_scorer_is_fed_in_batches(spark):
    def load():
        def predict(texts):
            return [[("size", float(len(texts))), ("empty", float(t == ""))] for t in texts]

        return predict

    df = spark.createDataFrame([(i, None if i == 3 else "x") for i in range(10)], "id int, t string").coalesce(1)
    rows = enrich.score_text(df, "t", "id", model=load, batch=4).orderBy("id").collect()
    assert [r["scores"][0]["score"] for r in rows] == [4.0] * 8 + [2.0] * 2
    assert rows[3]["scores"][1]["score"] == 1.0


def test_built_in_enrichments_add_only_new_books(spark):
    root = work_path(spark, "features")
    books = spark.createDataFrame(
        [(1, "joy and love in a dark war"), (2, None), (3, "a sad, slow story of grief")], "book_id long, description string")
    first = enrich.enrich(books.where("book_id < 3"), root)
    assert sorted(r["book_id"] for r in first.collect()) == [1, 2]
    again = enrich.enrich(books, root)
    assert sorted(r["book_id"] for r in again.collect()) == [1, 2, 3]
    assert enrich.enrich(books, root).count() == 3 and set(again.columns) == {"book_id", *enrich.enrichments()}


def test_place_names_of_several_words(spark):
    texts = spark.createDataFrame([
        (1, "from New York to the United Kingdom, and to York and France; new york again"), (2, None), (3, "nowhere")],
        "book_id long, t string")
    names = spark.createDataFrame([(n,) for n in ("New York", "York", "United  Kingdom", "France", "Kingdom")], "name string")
    got = {r["book_id"]: [e["word"] for e in r["entities"]]
           for r in places.known_place_entities(texts, "t", names).collect()}
    assert got == {1: ["New York", "United Kingdom", "York", "France", "new york"], 2: [], 3: []}


def test_recogniser_falls_back_to_single_texts(spark):
    def load():
        def recognise(texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return [[{"entity_group": "LOC", "score": 0.9, "word": t}] for t in texts]

        return recognise

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Rome", "bad", " ", None, "Oslo"])], "book_id long, t string").coalesce(1)
    rows = places.extract_entities(df, "t", load).orderBy("book_id").collect()
    assert [[e["word"] for e in r["entities"]] for r in rows] == [["Rome"], [], [], [], ["Oslo"]]
    assert [r["failed"] for r in rows] == [False, True, False, False, False]


def test_place_names_of_many_words(spark):
    names = spark.createDataFrame(
        [("United States",), ("United States of America",), ("Saint Vincent and the Grenadines",), ("America",), ("(Congo)",), ("...",), (None,)],
        "name string")
    texts = spark.createDataFrame(
        [(1, "From Saint Vincent and the Grenadines to the united states of America."), (2, "United States or America; Congo"), (3, "of the"), (4, None)],
        "book_id long, t string")

    def found(n):
        return {r["book_id"]: [e["word"] for e in r["entities"]]
                for r in places.known_place_entities(texts, "t", n).collect()}

    assert found(names) == {1: ["Saint Vincent and the Grenadines", "united states of America"],
                            2: ["United States", "America", "Congo"], 3: [], 4: []}
    assert found(names.limit(0)) == {1: [], 2: [], 3: [], 4: []}


def test_features_are_merged_not_broadcast(spark):
    """Stored labels are a small file of many rows, which a driver has no room for."""
    made = [spark.range(50).selectExpr("id AS book_id", f"'x' AS f{i}") for i in range(3)]
    found = joins.merge_features(made)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2
    assert found.count() == 50 and found.columns == ["book_id", "f0", "f1", "f2"]
