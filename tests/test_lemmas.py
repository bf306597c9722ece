"""Base forms by rules."""

from pyspark.sql import functions as F

from bookfeel.functions import text as tx
from bookfeel.operators import lemmas


def test_rules_and_exceptions(spark):
    vocabulary = "walk walks walked walking hope hoping hoped fly flies box boxes church churches man men wolf wolves glass glasses bus went go sing"
    df = spark.createDataFrame([(1, vocabulary), (2, "Walked, the MEN went hoping!"), (3, None), (4, ""), (5, "sings wolves 7")],
                               "id int, text string")
    verbs = spark.createDataFrame([("went", "go"), ("went", "wend")], "word string, base string")
    table = lemmas.lemma_table(df, "text", verbs=verbs)
    assert {r["word"]: r["lemma"] for r in table.collect()} == {
        "walks": "walk", "walked": "walk", "walking": "walk", "hoping": "hope", "hoped": "hope", "flies": "fly", "boxes": "box",
        "churches": "church", "men": "man", "wolves": "wolf", "glasses": "glass", "went": "go", "sings": "sing"}
    rows = {r["id"]: r["text"] for r in lemmas.lemmatized(df, "id", "text", table, stop_words=tx.STOP_WORDS).collect()}
    assert rows[2] == "walk man go hope" and rows[3] == rows[4] == "" and rows[5] == "sing wolf"
    # Without exceptions and changes the text is as normalised.
    none = lemmas.lemmatized(df, "id", "text", table.limit(0))
    want = {r[0]: r[1] for r in df.select("id", F.coalesce(tx.normalize_text(F.col("text"), accents=True, verbs={}, nouns={}), F.lit(""))).collect()}
    assert {r["id"]: r["text"] for r in none.collect()} == want


def test_candidates_must_be_known(spark):
    words = spark.createDataFrame([("wings",), ("sing",), ("as",), ("s",)], "word string")
    known = spark.createDataFrame([("s",), ("a",)], "word string")
    got = {r["word"]: r["base"] for r in lemmas.base_forms(words, lemmas.VERB_ENDINGS, known).collect()}
    assert got == {"sing": "s", "as": "a"}
    assert lemmas.base_forms(words.limit(0), lemmas.NOUN_ENDINGS, known).count() == 0


def test_texts_are_normalised_once(spark):
    df = spark.createDataFrame([(1, "Walks, walked!"), (1, "walk"), (None, "walks")], "id int, text string")
    table = lemmas.lemma_table(df, "text")
    found = lemmas.lemmatized(df.where("id is null or text <> 'walk'"), "id", "text", table)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["id"]: r["text"] for r in found.collect()}[1] == "walk walk"
