"""A corpus from raw documents to packed sequences: five stages, each a written table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.decontam import drop_leaks
from runledger.llm.line_dedup import dedup_lines
from runledger.llm.near_dup import drop_near_duplicates, near_duplicates
from runledger.llm.packing import pack_documents
from runledger.llm.quality import keep_good, rules_from_tables
from runledger.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    rules = rules_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, rules)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, a similarity of 0.8 or more.

    Line dedup has left of a near copy only what it does not share with an earlier document, which resembles nothing. So copies are
    found among the whole texts of the documents that are left, and then among what is left of them. Documents that the
    table does not have are compared by what is left of them alone; those without an id stay.
    """
    scratch = Scratch(spark, "near-dedup")
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    copies = near_duplicates(whole, shingle=5, percent=80).filter("not kept").select("doc_id").distinct()
    left = scratch.write(docs.join(copies, "doc_id", "left_anti").select(docs.columns), "left")
    return drop_near_duplicates(left, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that tile less than half of every benchmark item and hold no item of 1 to 4 words in full."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if n:
            scratch.drop(STAGES[n - 1][0])
    return docs
