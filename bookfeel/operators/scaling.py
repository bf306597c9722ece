"""Numeric scaling and category encoding for the similarity models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..cluster import written
from ..functions import text
from ..functions.fields import flag_to_int
from .joins import skew_join
from .ordering import order_codes
from .rollups import quantile_columns


def fit_numeric(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean of the known values, and the population deviation after the missing
    ones took the mean. One aggregate; a handful of numbers reach the driver."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.var_pop(c).alias(f"{c}_var") for c in columns],
        *[F.count(c).alias(f"{c}_known") for c in columns],
    ).first()
    params = {}
    for c in columns:
        # Filled rows sit on the mean: they add nothing to the squared sum.
        share = row[f"{c}_known"] / row["rows"] if row["rows"] else 0.0
        spread = ((row[f"{c}_var"] or 0.0) * share) ** 0.5
        params[c] = {"mean": row[f"{c}_mean"] or 0.0, "scale": spread or 1.0}
    return params


def apply_numeric(df: DataFrame, params: dict[str, dict[str, float]]) -> DataFrame:
    """Filled and standardised columns, ``z_<name>``."""
    return df.select("*", *[
        ((F.coalesce(F.col(c).cast("double"), F.lit(p["mean"])) - p["mean"]) / p["scale"]).alias(f"z_{c}")
        for c, p in params.items()
    ])


def column_quantiles(df: DataFrame, columns: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of whole columns as rows ``(name, <prob names>)``.

    Equal values are counted first. The counts are put in order by range partitions,
    whose bounds follow the data, so an outlier crowds no task; a running count inside
    each partition and one offset per partition give every value its ranks.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("e")).select("e.*").filter("value is not null")
    counts = written(long.groupBy("name", "value").agg(F.count("*").alias("n")), "value-counts")
    ranged = written(
        counts.repartitionByRange("name", "value").withColumn("piece", F.spark_partition_id()), "value-ranges"
    )
    pieces = ranged.groupBy("name", "piece").agg(F.sum("n").alias("p_n"))  # columns and partitions at most
    by_name = Window.partitionBy("name")
    before = F.sum("p_n").over(by_name.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = pieces.select(
        "name", "piece", F.coalesce(before, F.lit(0)).alias("before"), F.sum("p_n").over(by_name).alias("total")
    )
    inside = Window.partitionBy("name", "piece").orderBy("value")
    running = ranged.join(F.broadcast(offsets), ["name", "piece"]).withColumn(
        "cum",
        F.col("before")
        + F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    return running.groupBy("name").agg(*quantile_columns("value", "n", "cum", "total", probs))


def fit_robust(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Median and interquartile range per column, with the mean for missing values."""
    rows = column_quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()  # a row per column
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    found = {r["name"]: r for r in rows}
    params = {}
    for c in columns:
        r = found.get(c)
        spread = (r["q3"] - r["q1"]) if r else 0.0
        params[c] = {
            "centre": r["median"] if r else 0.0, "scale": spread or 1.0, "fill": means[c] or 0.0,
        }
    return params


def apply_robust(df: DataFrame, params: dict[str, dict[str, float]]) -> DataFrame:
    return df.select("*", *[
        ((F.coalesce(F.col(c).cast("double"), F.lit(p["fill"])) - p["centre"]) / p["scale"]).alias(f"r_{c}")
        for c, p in params.items()
    ])


def category_text(df: DataFrame, column: str, missing: str) -> Column:
    """A category as text, lists as a comma list."""
    if df.schema[column].dataType.typeName() == "array":
        return F.coalesce(F.array_join(column, ", "), F.lit(missing))
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def category_codes(df: DataFrame, columns: list[str], missing: str) -> DataFrame:
    """Dictionary ``(column_name, value, code)``: sorted order of each column's
    values. It stays a table; no vocabulary passes through the driver."""
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), category_text(df, c, missing).alias("value"))
        for c in columns
    ])).alias("e")).select("e.*")
    return order_codes(values, "column_name", "value")


def _attach_codes(
    df: DataFrame, codes: DataFrame, columns: list[str], missing: str, prefix: str, key: str
) -> DataFrame:
    """One join for all columns: (key, column, value) rows meet the dictionary once,
    hot values salted, and are folded back to one narrow row per key."""
    pair = F.struct("column_name", "value").alias("_pair")
    dictionary = written(codes, "codes").select(pair, "code")
    rows = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), category_text(df, c, missing).alias("value"))
        for c in columns
    ])).alias("e")).select(key, F.struct("e.column_name", "e.value").alias("_pair"))
    coded = skew_join(rows, dictionary, "_pair", "left", [key]).groupBy(key).agg(*[
        F.max(F.when(F.col("_pair.column_name") == c, F.col("code"))).alias(f"{prefix}{c}")
        for c in columns
    ])
    return df.join(coded, key, "left")


def label_encode(df: DataFrame, columns: list[str], key: str = "book_id") -> DataFrame:
    """Integer code of each category, in alphabetical order, as ``code_<name>``."""
    return _attach_codes(df, category_codes(df, columns, "nan"), columns, "nan", "code_", key)


def fit_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-hot dictionary ``(column_name, value, slot)``, slots running on from
    column to column."""
    codes = category_codes(df, columns, "unknown")
    # One row per column.
    sizes = codes.groupBy("column_name").agg(F.count("*").alias("size"))
    order = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    before = F.sum("size").over(
        Window.partitionBy(F.lit(1)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select("column_name", F.coalesce(before, F.lit(0)).alias("_start"))
    return codes.join(F.broadcast(starts), "column_name").select(
        "column_name", "value", (F.col("_start") + F.col("code")).alias("code")
    )


def apply_categorical(df: DataFrame, dictionary: DataFrame, columns: list[str], key: str = "book_id") -> DataFrame:
    """``slots``: the active one-hot positions; a value unseen at fit time has none."""
    coded = _attach_codes(df, dictionary, columns, "unknown", "_slot_", key)
    slots = [f"_slot_{c}" for c in columns]
    return coded.withColumn("slots", F.array_compact(F.array(*slots))).drop(*slots)


def category_hashes(df: DataFrame, columns: list[str]) -> Column:
    """64-bit hash per category; equal values have equal hashes."""
    return F.array(*[F.xxhash64(category_text(df, c, "unknown")) for c in columns])


def unit(vector: Column) -> Column:
    """L2-normalised; a zero vector is returned as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.transform(
        F.arrays_zip(vector.alias("x"), F.array_repeat(F.sqrt(squares), F.size(vector)).alias("norm")),
        lambda p: F.when(p["norm"] > 0, p["x"] / p["norm"]).otherwise(p["x"]),
    )


def hybrid_vectors(
    df: DataFrame, numeric: list[str], categories: list[str], embedder, sep: str = " ",
    scaler: str = "standard", key: str = "book_id",
) -> DataFrame:
    """``(key, embedding)``: text embedding of the joined categories, scaled
    numbers and the series flag, as one unit vector."""
    if scaler == "robust":
        scaled, prefix = apply_robust(df, fit_robust(df, numeric)), "r_"
    else:
        scaled, prefix = apply_numeric(df, fit_numeric(df, numeric)), "z_"
    named = [c for c in categories if c != "is_series"]
    described = scaled.withColumn(
        "_text", text.joined_categories([category_text(df, c, "nan") for c in named], sep)
    )
    embedded = embedder(described, "_text", "_embedding")
    flag = flag_to_int(F.col("is_series")).cast("double")
    whole = F.concat(
        F.col("_embedding").cast("array<double>"),
        F.array(*[F.col(f"{prefix}{c}") for c in numeric], flag),
    )
    return embedded.select(key, whole.alias("_whole")).select(key, unit(F.col("_whole")).alias("embedding"))


def hashing_embedder(dimensions: int = 384):
    """Default embedder: hashed bag of words, normalised; Spark ML only."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    def embed(df: DataFrame, column: str, out: str) -> DataFrame:
        worded = df.withColumn("_words", text.tokens(F.coalesce(F.col(column), F.lit(""))))
        hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(worded)
        normed = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
        return normed.withColumn(out, vector_to_array("_unit")).drop("_words", "_tf", "_unit")

    return embed


def model_embedder(load, dimensions: int, batch: int = 64):
    """Embedder from a model: ``load`` runs once per task and returns a function
    from a list of texts to a list of vectors."""

    def embed(df: DataFrame, column: str, out: str) -> DataFrame:
        schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

        def run(frames):
            encode = load()
            for frame in frames:
                texts = frame[column].fillna("").tolist()
                vectors = []
                for start in range(0, len(texts), batch):
                    vectors.extend(encode(texts[start:start + batch]))
                yield frame.assign(**{out: [list(map(float, v)) for v in vectors]})

        return df.mapInPandas(run, schema)

    return embed
