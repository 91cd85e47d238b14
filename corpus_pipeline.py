"""A corpus pipeline over ``documents``; each stage works on all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last
return the columns of ``documents``; the last returns the documents that the
mix takes, with these columns, and how often it takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelforge.llm._common import materialize
from voxelforge.llm.decontaminate import decontaminate
from voxelforge.llm.language_id import fit_language_model, held_out, identify, is_rejected, rejection_bound
from voxelforge.llm.line_dedup import dedup_lines
from voxelforge.llm.mixing import mix, mixed_documents
from voxelforge.llm.order_minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or foreign to every learned language, go."""
    model = fit_language_model(docs.where(~held_out("doc_id")))
    told = materialize(identify(docs.select(*COLUMNS), model), "languages")
    return told.where(~is_rejected("text", rejection_bound(told))).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen in a document with a smaller id go; the text and its length are those that are left."""
    kept = dedup_lines(docs, keep=["doc_id", "lang", "source"]).withColumnRenamed("kept_text", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    classes = near_duplicates(docs)
    stay = classes.where(F.col("doc").eqNullSafe(F.col("class_id"))).select(F.col("doc").alias("__doc"), F.col("node").alias("__node")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__node"))
    return docs.select(*COLUMNS).join(stay, same, "left_semi")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and copies."""
    hashed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    mixed = mix(hashed, carry=["text_hash"]).drop("virtual_finish")
    return mixed_documents(docs.select(*COLUMNS), mixed)


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The stages fit models and align texts, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
