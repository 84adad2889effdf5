"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.bpe import encoded_and_decoded
from rillflow.llm.common import shared_folder, unused
from rillflow.llm.lines import template_dedup
from rillflow.llm.mixing import mixed_documents
from rillflow.llm.neardup import deduplicated
from rillflow.llm.queries import tokenizer_path
from rillflow.llm.repetition import repetition_rules


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    return repetition_rules(whole).filter("kept").select("whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; n_chars follows the text."""
    counted, dropped = unused(docs.columns, "n_lines", "dropped_lines")
    out = template_dedup(docs, counted=counted, dropped=dropped)
    return out.withColumn("n_chars", F.when(F.size(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, digests of the ids and of the text that they decode to."""
    return encoded_and_decoded(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("bpe", encode)]

#: Near copies and BPE cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark.sparkContext).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # what the stage before wrote has been read
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
