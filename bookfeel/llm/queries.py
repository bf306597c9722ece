"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import work_path
from . import bpe, fingerprints, host_trust, html_text, mixing, near_text, near_vectors, quality, repeated_bytes
from . import sharding, token_store, turn_repair, word_variants
from .registry import register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A file of the public tokenizers, read on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@register("op1_token_store")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document written in Huffman-coded blocks and read back."""
    path = work_path(spark, "token-store")
    token_store.write_store(
        table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json").decode(), path, end_id=0)
    return token_store.read_store(spark, path, keep_ids=False)


@register("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document by byte-level BPE and back."""
    import public_tokenizers

    return bpe.encode_documents(
        table(spark, folder, "documents"), vocabulary("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, keep=(),
    )


@register("op3_source_mix")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    plan = mixing.mix(table(spark, folder, "documents"), keep=["doc_id"])
    return mixing.taken(plan).select("doc_id", "size", "source_size", "target", "taken")


SHARDS = 16


@register("op8_shards")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards of near equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = sharding.shard(
        table(spark, folder, "documents"), group=text, ident=F.col("doc_id"), size=F.octet_length(text) + 1,
        shards=SHARDS, keep={"doc_id": F.col("doc_id"), "text_crc32": F.crc32(text)})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op4_fingerprints")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Piecewise fingerprints of every document and of its edited text."""
    return fingerprints.with_edits(table(spark, folder, "documents"))


@register("op5_main_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    texts = html_text.extract(table(spark, folder, "pages"), html_text.fit())
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


# The rules of the query, as host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@register("op6_host_trust")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url by rules, else by its host's trust and distrust."""
    return host_trust.judge(table(spark, folder, "pages"), URL_RULES)


@register("op7_near_text")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of near-duplicate documents at weighted Jaccard similarity 0.8."""
    return near_text.near_texts(table(spark, folder, "documents"))


def held_out(key: str = "doc_id"):
    """The fold that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


QUALITY_BAR = 0.3  # texts below it are rejected


@register("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels of the held-out fold are not learnt from."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels").where(~held_out()))
    return quality.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= QUALITY_BAR).cast("int").alias("predicted"))


@register("op10_near_vectors", """
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    sound AS (SELECT vec_id, e FROM v WHERE len(e) > 0 AND list_dot_product(e, e) > 0),
    pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a, sound b
              WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95::DOUBLE),
    reach(a, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, reach.r FROM reach JOIN pairs p ON p.b = reach.a),
    least AS (SELECT a, min(r) AS r FROM reach GROUP BY 1),
    links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, r AS component_id, vec_id = r AS kept
    FROM v JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the query's damage, with ``copies`` and ``gone``."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    damage = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(damage == 3, 2).otherwise(1).alias("copies"), (damage == 0).alias("gone"))


@register("op11_turn_repair")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Cheapest repair of every damaged conversation."""
    repair = turn_repair.Repair(
        damaged(table(spark, folder, "conversations")), copies=F.col("copies"), gone=F.col("gone"))
    return repair.digests().withColumnRenamed("conv", "conv_id")


RUN = "[a-zÀ-ÿ]+"
CAPITALS, SMALL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt_words(docs: DataFrame, least: int = 3, length: int = 5) -> DataFrame:
    """``word, n`` of the query's runs: one in 97 loses a code point; null ids count as empty."""
    lower = F.translate(F.col("text"), CAPITALS, SMALL_LETTERS)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % 97 == 0, F.concat(
        F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


@register("op12_word_variants")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return word_variants.variants(misspelt_words(table(spark, folder, "documents")))


@register("op13_repeated_bytes", """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM d, unnest(range(1, n - 198)) u(i)),
    twice AS (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1),
    hit AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh
            FROM w SEMI JOIN twice USING (h)),
    run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
    span AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z FROM run GROUP BY doc_id, r),
    cut AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
    gone AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans, max(z) AS last FROM span GROUP BY 1),
    piece AS (SELECT doc_id, a AS place, hex(b[before + 1:a - 1]) AS p FROM cut JOIN d USING (doc_id) WHERE a > before + 1
              UNION ALL SELECT doc_id, n + 1, hex(b[coalesce(last, 0) + 1:n]) FROM d LEFT JOIN gone USING (doc_id) WHERE n > coalesce(last, 0)),
    kept AS (SELECT doc_id, string_agg(p, '' ORDER BY place) AS p FROM piece GROUP BY 1)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
      sha256(unhex(coalesce(p, ''))) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that a repeated string of 200 bytes covers, and the rest."""
    found = repeated_bytes.without_repeats(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
