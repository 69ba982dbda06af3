"""A corpus pipeline: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the
columns of documents. A stage's result is written as Parquet and read again as the next one's docs. Stages share
the executors, whose heap the earlier ones have grown, so those with Python workers bound the session's Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontamination, jaccard, line_dedup, packing, quality
from plumbline.llm.common import documents, new_folder, remove, small_batches


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under one half; learns from the labelled rows that aren't held out."""
    small_batches(spark)
    return quality.quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites repeat out of all documents but the first that holds them."""
    return line_dedup.line_dedup_stage(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest id."""
    small_batches(spark)
    return jaccard.near_duplicate_stage(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    small_batches(spark)
    return decontamination.decontamination_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens. Runs last, when executors hold most, so with a small cache."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=24 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages that learn, search in a latent space and pack tokens can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written to the shared folder and read again; a table goes when the next one is written."""
    docs, held = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            remove(spark, held)
        docs, held = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
