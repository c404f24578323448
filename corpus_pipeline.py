"""Documents to training mixture in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents; all but the last
return the columns of `documents`, the last adds domain, n_tokens and rate (after
`mix_` where documents have such columns).
`run` writes each stage's result and reads it again for the next one; these
tables are deleted when the result stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, minhash, mixing, substrings, toxicity
from millrace.llm.common import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more; held-out labels stay unread."""
    labels = _labels(spark, sf_dir)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group."""
    return minhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes 50-word windows that a smaller doc_id has; n_chars follows the text."""
    removed = "_removed"
    while removed in docs.columns:
        removed += "_"
    cut = substrings.remove_repeated(docs, removed_col=removed)
    changed = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold three quarters of a benchmark item's shingles."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_leaks(docs, items).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's rate, the expected number of times it is read; rate 0 goes."""
    mixed = mixing.mix_by_quality(docs, _labels(spark, sf_dir))
    return mixed.where(F.col(mixed.columns[-1]) > 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: trained models decide two stages, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
