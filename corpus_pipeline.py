"""A training-data pipeline: toxicity, near and repeated text, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that it leaves;
``run`` writes each stage's result as Parquet and reads it again. Documents with
null columns pass through every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, close_scratch
from barloom.llm.mixing import mix
from barloom.llm.near_dedup import near_duplicates
from barloom.llm.pieces import encode
from barloom.llm.suffix_dedup import cut_passages
from barloom.llm.toxicity import fit, score

#: Score from which a document is rejected.
REJECT = 0.5
#: Runs of at least so many words are cut; repeats are found by strings of the least bytes that such a run has.
REPEAT_WORDS = 50
REPEAT_BYTES = 2 * REPEAT_WORDS - 1


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under REJECT by a model fitted on all labelled texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels), score_col="__score").where(F.col("__score") < REJECT).drop("__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    Decisions hold by id and text: rows that repeat both leave one, rows that
    repeat an id with another text are judged apart; rows with a null id stay.
    Of rows with one id and text the one with the least hash of its columns stays.
    """
    found = near_duplicates(docs.select("doc_id", "text"), details=True).where("kept and doc_id is not null")
    alone = F.when(F.col("group").isNull(), F.col("mark"))
    kept = found.groupBy("doc_id", "group", alone).agg(F.min("mark").alias("__mark")).select("doc_id", "__mark").distinct()
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    w = Window.partitionBy("doc_id", "__mark").orderBy(F.xxhash64(*hashed))
    known = docs.withColumn("__mark", F.xxhash64("text")).join(kept, ["doc_id", "__mark"], "left_semi")
    known = known.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return known.select(docs.columns).unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of REPEAT_WORDS words or more that an earlier document has are cut; every document stays.

    ``n_chars`` follows the text where a passage went.
    """
    out = cut_passages(docs.withColumn("__before", F.octet_length("text")), length=REPEAT_BYTES, words=REPEAT_WORDS)
    if "n_chars" in docs.columns:
        cut = F.octet_length("text") < F.col("__before")
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sources weighed 5, 2, 1 for 150% of all words.

    Null and empty texts have no words and are taken never; a null source is a source.
    """
    found = mix(docs.withColumnsRenamed({"size": "__size", "taken": "__taken", "target": "__target", "source_size": "__source_size"}))
    times = F.when(F.col("size") > 0, F.try_divide("taken", "size")).otherwise(0).cast("int")
    found = found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times)))
    found = found.drop("size", "source_size", "target", "taken", "__copy")
    back = {"__size": "size", "__taken": "taken", "__target": "target", "__source_size": "source_size"}
    return found.withColumnsRenamed({k: v for k, v in back.items() if v in docs.columns}).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every document left, with their number; null and empty texts have none, repeated rows stay."""
    import public_tokenizers

    found = encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: SQL can't express the fitted model, the repeats' spans or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what earlier stages wrote is removed."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        close_scratch(spark, keep=scratch)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
