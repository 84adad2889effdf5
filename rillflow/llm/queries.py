"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer file is; a parameter of every operator that needs one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_embeddings(spark, d):
    from rillflow.llm.embeddup import linked

    return linked(spark.read.parquet(f"{d}/embeddings.parquet"))


def op2_repetition(spark, d):
    from rillflow.llm.repetition import repetition_rules

    docs = documents(spark, d).select("doc_id", "text")
    return repetition_rules(docs).drop("text")


def op3_bpe(spark, d):
    from rillflow.llm.bpe import encoded_and_decoded

    return encoded_and_decoded(documents(spark, d), tokenizer_path())


def op4_ctw(spark, d):
    from rillflow.llm.lm import score

    return score(documents(spark, d))


def op5_mixing(spark, d):
    from rillflow.llm.mixing import fair_mix

    return fair_mix(documents(spark, d))


def op6_sharding(spark, d):
    from rillflow.llm.sharding import sharded

    return sharded(documents(spark, d))


def op7_quality(spark, d):
    from rillflow.llm.quality import classified

    return classified(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op8_lines(spark, d):
    from pyspark.sql import functions as F

    from rillflow.llm.lines import template_dedup

    return template_dedup(documents(spark, d).select("doc_id", "text")).withColumn("dropped_lines", F.array_join("dropped_lines", ","))


def op9_packing(spark, d):
    from pyspark.sql import functions as F

    from rillflow.llm.packing import encoded_matrices

    made = encoded_matrices(documents(spark, d), tokenizer_path())
    return made.select("matrix", "height", "width", "kind", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op10_probminhash(spark, d):
    from rillflow.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, d)).drop("node", "digest")


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries():
    return {f.__name__: f for f in (op1_embeddings, op2_repetition, op3_bpe, op4_ctw, op5_mixing, op6_sharding, op7_quality, op8_lines, op9_packing, op10_probminhash, pipeline)}


def oracle_sql():
    from rillflow.llm import embeddup, lines, mixing, sharding

    return {"op1_embeddings": embeddup.SQL, "op5_mixing": mixing.SQL, "op6_sharding": sharding.SQL, "op8_lines": lines.SQL}
