"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's rows as Parquet in the shared folder, gives them to the next and then deletes what they were made from.

Every row is judged by its own text, those of a null or repeated doc_id too. Null, empty and blank texts fail the base quality rule, so no later stage
meets them from ``run``; alone, each stage takes them as its operator says. Ties between near-duplicates go to the smallest doc_id, null last. Texts of any
length pass through whole; an empty table passes every stage as one; further columns, of whatever name, are kept up to packing.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from tidemark.llm.common import delete, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; n_chars follows."""
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of smallest id."""
    return near_dup.without_near_duplicates(docs, percent=75)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, in sequences."""
    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken")), capacity=1024, end=0)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("decontamination", benchmarks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    raise AssertionError("STAGES is empty")


#: SQL can't express the near-duplicate sketches, the learnt rules and the tokens; tests/llm compares line dedup, near-dedup and the base quality rule with brute force.
ORACLE_SQL = None
