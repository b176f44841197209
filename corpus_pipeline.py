"""A training-data pipeline over ``documents``: filter, deduplicate, decontaminate and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written
as Parquet and read again as the next stage's ``docs``. All stages but the last
return the columns of ``docs``. Defined results, besides those of the operators:
rows with a null text are kept by the filters unless their score rejects them; equal
rows (doc_id, text) leave the near-dedup as one row, rows that share a doc_id but differ in
text are documents each, and rows without a doc_id pass it. No column of the documents is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bpe, decontamination, quality, setjoin, toxicity
from loomtext.llm.queries import tokenizer_path
from loomtext.session import materialise, table, unused


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is a half or more."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    own = unused("toxicity", docs.columns)
    return toxicity.score(docs, model, into=own).filter(F.col(own) < 0.5).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality is under a half."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    own = unused("quality", docs.columns)
    return quality.score(docs, model, into=own).filter(F.col(own) >= 0.5).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return setjoin.keep_first(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item: five-word shingles, containment 0.8."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number, and the text that they decode to."""
    path = tokenizer_path("word_bpe_49k.json")
    both = bpe.round_trip(docs, path, keep=["doc_id"])
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: SQL has no trained classifiers and no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
