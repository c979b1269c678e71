"""A corpus pipeline of five stages: rules, near duplicates, benchmark passages, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on every row of docs and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it back as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecheck.llm import decontaminate, mixing, quality, simhash, token_files
from tablecheck.llm.staging import staged

#: Near duplicates by fingerprint have no SQL equivalent.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy."""
    return quality.apply_policy(quality.ledger(docs)).filter("kept").select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row: the one with the smallest id, of several such rows the one with the
    smallest checksum of all columns, of exact copies any one.

    Rows without an id are members like others and come last. NULL and empty texts are near duplicates of one another.
    """
    text, others = F.col("doc.text"), F.struct(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "text"])
    digest = F.unhex(F.md5(F.concat_ws("/", F.md5(text), F.to_json(others))))
    row = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("id"), digest.alias("digest"))
    keys = row.select(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest").alias("row_key"), text.alias("text"))
    keep = simhash.classes(keys, "row_key").filter("row_key = component_id").groupBy("row_key").agg(F.count("*").alias("copies"))
    keep = keep.select(F.col("row_key.id").alias("kept_id"), F.col("row_key.digest").alias("kept_digest"), "copies")
    kept = row.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    # Only rows that have copies are grouped; whole documents without any are not shuffled again.
    single = kept.filter("copies > 1").groupBy("kept_id", "kept_digest").agg(F.first("doc").alias("doc"))
    return kept.filter("copies = 1").select("doc.*").unionByName(single.select("doc.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.judged(docs, items).filter("NOT contaminated").select("doc.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs, mixing.labelled_quality(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their index."""
    return token_files.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
