"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labels whose fold isn't held out; every document is scored."""
    from .toxicity import fit, score

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~held & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    found = score(docs, fit(docs, labels))
    return found.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs, length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"), top=5)


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import read_pages, store_texts

    stored = store_texts(_table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = read_pages(stored)
    size = F.octet_length("pixels")
    return pages.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import kd_shards

    found = kd_shards(_table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    found = mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: Host, path and action of the rules that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifiers of every text, and whether they decode to it (markers read as spaces)."""
    import public_tokenizers

    from .pieces import MARK, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        (F.col("decoded") == text).alias("round_trip"),
    )


QUERIES = [
    op1_neighbours,
    op2_tiff,
    op3_token_count,
    op4_sharding,
    op5_pieces,
    op6_toxicity,
    op7_mixing,
    op8_near_dedup,
    op9_url_filter,
    op10_suffix_dedup,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
