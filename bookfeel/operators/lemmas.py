"""Base forms of words by rules: endings are taken off, and a candidate counts when the texts know it.

The rules of a part of speech are tried in order; the first candidate that the vocabulary
holds is the base form, otherwise the word stays. A table of exceptions goes before the
rules. All of it is joins over distinct words; the texts meet only the words that change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import text as tx
from .joins import skew_join

# Endings and what takes their place, as the usual English word net lists them.
VERB_ENDINGS = [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def base_forms(words: DataFrame, endings: list[tuple[str, str]], known: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """``word, base`` of the distinct ``words`` that change. ``known`` holds the ``word`` s a
    candidate may be; ``exceptions`` (``word, base``) go first, the least base of a word."""
    candidates = words.select("word", F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.when(
            F.col("word").endswith(old) & (F.length("word") + len(new) > len(old)),
            F.concat(F.expr(f"substring(word, 1, length(word) - {len(old)})"), F.lit(new))).alias("base"))
        for i, (old, new) in enumerate(endings)])).alias("c")).select("word", "c.*").where("base is not null")
    real = candidates.join(known.select(F.col("word").alias("base")).distinct(), "base", "left_semi")
    ruled = real.groupBy("word").agg(F.min_by("base", "place").alias("base"))
    if exceptions is None:
        return ruled.where("base <> word")
    listed = exceptions.groupBy("word").agg(F.min("base").alias("listed"))
    return words.select("word").join(listed, "word", "left").join(ruled, "word", "left").select(
        "word", F.coalesce("listed", "base").alias("base")).where("base <> word")


def lemma_table(df: DataFrame, text: str, accents: bool = True, stop_words: list[str] | None = None,
                verbs: DataFrame | None = None, nouns: DataFrame | None = None) -> DataFrame:
    """``word, lemma`` of all words of the texts that have another lemma: the base as a verb, and of that the
    base as a noun. ``verbs`` and ``nouns`` are exceptions."""
    cleaned = tx.normalize_words(F.col(text), accents=accents, stop_words=stop_words, verbs={}, nouns={})
    words = written(df.select(F.explode(cleaned).alias("word")).distinct(), "words")
    verb = written(base_forms(words, VERB_ENDINGS, words, verbs), "verb-bases")
    middle = words.join(verb, "word", "left").select("word", F.coalesce("base", "word").alias("verb"))
    noun = base_forms(middle.select(F.col("verb").alias("word")).distinct(), NOUN_ENDINGS, words, nouns)
    return middle.join(noun.select(F.col("word").alias("verb"), "base"), "verb", "left").select(
        "word", F.coalesce("base", "verb").alias("lemma")).where("lemma <> word")


def lemmatized(df: DataFrame, key: str, text: str, table: DataFrame, accents: bool = True,
               stop_words: list[str] | None = None) -> DataFrame:
    """``key, text``: the normalised texts with the lemmas of ``table``; rows are told apart by ``key``. Only the
    places of words that change travel; a text without words is empty."""
    cleaned = tx.normalize_words(F.col(text), accents=accents, stop_words=stop_words, verbs={}, nouns={})
    # Read twice below, so the texts are normalised only once.
    rows = written(df.select(key, F.coalesce(cleaned, F.array().cast("array<string>")).alias("_words")), "normal-words")
    places = rows.select(key, F.posexplode("_words").alias("_at", "word"))
    changed = skew_join(places, table, "word", "inner", [key, "_at"])
    swaps = changed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "lemma"))).alias("_swaps"))
    return rows.join(swaps, key, "left").select(key, F.array_join(F.transform(
        "_words", lambda w, i: F.coalesce(F.try_element_at("_swaps", i), w)), " ").alias(text))
