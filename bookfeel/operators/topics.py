"""Text models: bag-of-words polarity classifier, TF-IDF, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from . import lda
from .joins import skew_join
from .rollups import stable_bucket

# Words of two or more letters or digits, as the usual vectorizer takes them.
WORD = r"[\p{L}\p{N}_]{2,}"


def ngrams(c: Column, n: int = 1) -> Column:
    """Runs of ``n`` neighbouring words, joined by a space."""
    words = F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(
        F.array().cast("array<int>")
    )
    # The words are computed once per row, then sliced.
    return F.flatten(F.transform(
        F.array(F.struct(words.alias("w"), starts.alias("s"))),
        lambda r: F.transform(r["s"], lambda i: F.concat_ws(" ", F.slice(r["w"], i, n))),
    ))


def term_counts(df: DataFrame, text: str = "text", n: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, term, tf)``."""
    terms = df.select("id", *keep, F.explode(ngrams(F.col(text), n)).alias("term"))
    return terms.groupBy("id", *keep, "term").agg(F.count("*").alias("tf"))


_CLASSES = ("d0", "d1", "k0", "k1")  # documents and tokens of both classes


def _class_sums() -> list[Column]:
    neg, pos = F.col("target") == 0, F.col("target") == 1
    return [F.sum(F.when(neg, F.col("tf")).otherwise(0)), F.sum(F.when(pos, F.col("tf")).otherwise(0))]


def _class_counts(name: str = "n") -> list[Column]:
    return [c.alias(f"{name}{i}") for i, c in enumerate(_class_sums())]


def polarity_scores(df: DataFrame, n: int, folds: Column, held: Column | None = None) -> DataFrame:
    """``(id, target, fold, predicted)`` from multinomial naive Bayes with
    add-one smoothing. Each document is scored by the model that never saw the
    fold ``held`` (its own one by default). The vocabulary is that of all texts,
    however large.

    Terms move once: a term's counts, in all and per fold, are summed next to its rows, so
    that the model without any one fold is a subtraction and all folds are scored in one
    pass. A document has one row a term, which bounds a term's share of the rows.
    """
    placed = df.select("id", "text", F.col("target"), folds.alias("fold"))
    placed = placed.withColumn("held", F.col("fold") if held is None else held)
    docs = placed.select("id", "target", "fold", "held")
    # Read three times below, so the texts are cut into words only once.
    grams = written(term_counts(placed, "text", n, ("target", "fold", "held")), "grams")
    # A few numbers per fold, as one map.
    sizes = docs.groupBy("fold").agg(
        F.count_if(F.col("target") == 0).alias("d0"), F.count_if(F.col("target") == 1).alias("d1")
    ).join(
        grams.groupBy("fold").agg(*_class_counts("k")), "fold", "left"
    ).fillna(0)
    totals = sizes.agg(F.struct(*[F.sum(c).alias(c) for c in _CLASSES]).alias("t")).scalar()
    by_fold = sizes.agg(
        F.map_from_entries(F.collect_list(F.struct("fold", F.struct(*_CLASSES)))).alias("m")
    ).scalar()
    vocabulary = grams.agg(F.count_distinct("term")).scalar()

    def outside(name: str) -> Column:
        inside = F.try_element_at(by_fold, F.col("held"))[name]
        return totals[name] - F.coalesce(inside, F.lit(0))

    in_fold, in_all = Window.partitionBy("term", "fold"), Window.partitionBy("term")
    # All folds first: rows dealt by term serve both.
    counted = grams.withColumns({f"t{i}": c.over(in_all) for i, c in enumerate(_class_sums())})
    counted = counted.withColumns({f"n{i}": c.over(in_fold) for i, c in enumerate(_class_sums())})
    if held is not None:  # the fold left out is another than the row's own: a few numbers per fold of the term
        counted = counted.withColumn("_folds", F.map_from_entries(
            F.collect_set(F.struct("fold", F.struct("n0", "n1"))).over(in_all)))
        inside = F.try_element_at("_folds", F.col("held"))
        counted = counted.withColumns({c: F.coalesce(inside[c], F.lit(0)) for c in ("n0", "n1")})

    def logp(i: int) -> Column:
        return F.log((F.col(f"t{i}") - F.col(f"n{i}") + 1) / (outside(f"k{i}") + vocabulary))

    evidence = counted.groupBy("id").agg(
        F.sum(F.col("tf") * (logp(1) - logp(0))).alias("evidence")
    )
    prior = F.log(outside("d1") / outside("d0"))
    return docs.join(evidence, "id", "left").select(
        "id", "target", "fold",
        (F.coalesce("evidence", F.lit(0.0)) + prior > 0).cast("int").alias("predicted"),
    )


def _accuracy(scored: DataFrame, by: str) -> DataFrame:
    return scored.groupBy(by).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("target") == F.col("predicted")).alias("correct"),
    ).withColumn("accuracy", F.col("correct") / F.col("documents"))


def train_polarity(df: DataFrame, n: int = 1, folds: int = 5) -> DataFrame:
    """Cross-validated accuracy per fold; folds are drawn by a hash of the id."""
    scored = polarity_scores(df, n, stable_bucket(F.col("id"), F.lit(folds)))
    return _accuracy(scored, "fold")


def holdout(df: DataFrame, test: float = 0.3, n: int = 1) -> DataFrame:
    """Train and test accuracy of one hash-drawn split."""
    in_test = (stable_bucket(F.col("id"), F.lit(1000)) < int(test * 1000)).cast("long")
    scored = polarity_scores(df, n, in_test, F.lit(1).cast("long"))
    return _accuracy(scored, "fold").select(
        F.when(F.col("fold") == 1, "test").otherwise("train").alias("part"),
        "documents", "correct", "accuracy",
    )


def predict_polarity(train: DataFrame, texts: DataFrame, n: int = 1) -> DataFrame:
    """``(id, predicted)`` for new texts; words the training never saw count nothing."""
    terms = written(
        term_counts(train, "text", n, ("target",)).groupBy("term").agg(*_class_counts()), "terms"
    )
    sums = terms.agg(F.struct(
        F.sum("n0").alias("k0"), F.sum("n1").alias("k1"), F.count("*").alias("v")).alias("s")).scalar()
    classes = train.agg(F.struct(
        F.count_if(F.col("target") == 0).alias("d0"), F.count_if(F.col("target") == 1).alias("d1")
    ).alias("d")).scalar()

    def logp(i: int) -> Column:
        return F.log((F.col(f"n{i}") + 1) / (sums[f"k{i}"] + sums["v"]))

    evidence = skew_join(term_counts(texts, "text", n), terms, "term", "inner", ["id"]).groupBy("id").agg(
        F.sum(F.col("tf") * (logp(1) - logp(0))).alias("evidence")
    )
    prior = F.log(classes["d1"] / classes["d0"])
    return texts.select("id").join(evidence, "id", "left").select(
        "id", (F.coalesce("evidence", F.lit(0.0)) + prior > 0).cast("int").alias("predicted"),
    )


def _vocabulary(df: DataFrame, n: int, min_df: int, max_features: int) -> DataFrame:
    """``(term, df, cf)`` of the most frequent terms: at most ``max_features`` rows.
    Only counts are shuffled, no list of terms by document is stored."""
    per_text = df.select("id", F.explode(ngrams(F.col("text"), n)).alias("term"))
    counts = per_text.groupBy("term", "id").agg(F.count("*").alias("tf"))
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return stats.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_features)


def _idf(total: Column) -> Column:
    return F.log((total + 1) / (F.col("df") + 1)) + 1


def tfidf(df: DataFrame, n: int = 3, min_df: int = 5, max_features: int = 10_000) -> DataFrame:
    """``(id, term, weight)``: smoothed idf plus one, unit length per document.

    ``min_df`` and ``max_features`` (most frequent terms) define the vocabulary.
    """
    return _weights(df, written(_vocabulary(df, n, min_df, max_features), "vocabulary"), n)


def _weights(df: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    terms = df.select("id", F.explode(ngrams(F.col("text"), n)).alias("term"))
    # The vocabulary is bounded, see above; terms outside it end here.
    weighed = terms.join(F.broadcast(vocabulary), "term").groupBy("id", "term").agg(
        (F.count("*") * F.first(_idf(total))).alias("raw"))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norms, "id").select("id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def topics(
    df: DataFrame, k: int = 3, n: int = 3, min_df: int = 5, max_features: int = 10_000,
    iterations: int = 100, seed: int = 0,
):
    """Topic model on the rows of :func:`tfidf`. Returns ``(mixtures, fitted)``: topic
    shares per document, and what :func:`top_words` reads. Every iteration reads every
    text. A text without a known term has equal shares, all have without a vocabulary.
    """
    kept = written(_vocabulary(df, n, min_df, max_features), "vocabulary")
    rows = kept.select("term").orderBy("term").collect()  # max_features at most
    if not rows:
        return df.select("id", F.array_repeat(F.lit(1.0 / k), k).alias("mixture")), None
    terms = [r["term"] for r in rows]
    places = df.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    entries = _weights(df, kept, n).join(F.broadcast(places), "term").groupBy("id").agg(  # max_features rows at most
        F.array_sort(F.collect_list(F.struct("place", "weight"))).alias("e"))
    none = F.array().cast("array<double>")
    vectors = df.select("id").join(entries, "id", "left").select(
        "id", F.coalesce("e.place", none.cast("array<int>")).alias("terms"), F.coalesce("e.weight", none).alias("counts"))
    vectors = written(vectors, "features")  # read by every iteration
    fitted = lda.fit(vectors, terms, k, iterations, seed)
    return lda.mixtures(vectors, fitted), fitted


def top_words(spark, fitted, count: int = 10) -> DataFrame:
    """``(topic, rank, term, weight)``: ``count`` rows per topic, none without a model. The
    weight counts how often the topic gave the term."""
    return spark.createDataFrame(fitted.top(count) if fitted else [], "topic int, rank int, term string, weight double")
