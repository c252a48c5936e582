"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark
decontamination and tokenisation of ``documents``.

Every stage works on all rows its predecessor kept.  Between stages the rows are
written as Parquet to the shared scratch folder and read again, so a lost
executor never repeats an earlier stage.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillscope.llm import compression, decontamination, line_chunks, piece_matching, simhash
from skillscope.llm.common import free_name, stored
from skillscope.llm.queries import piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their compression band go."""
    return compression.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line chunks that repeat an earlier chunk go; ``n_chars`` follows the text."""
    count = free_name(docs, "n_removed_lines")
    out = line_chunks.deduplicated(docs, removed_col=count)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"]))
                             .otherwise(F.col("n_chars")))
    return out.drop(count)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, each checked by decoding."""
    return piece_matching.round_trips(docs, piece_model(spark))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("sentencepiece", sentencepiece)]

#: Compression, XXH64 and alignment have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
