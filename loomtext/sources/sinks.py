"""Sinks. All go through Spark's writers, whose commit makes a finished write appear at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.tokenizer.vocab import Vocab


def write_lines(lines: DataFrame, path: str, column: str = "line", end: str = "\n") -> None:
    lines.select(F.col(column).alias("value")).write.option("lineSep", end).text(path)


def write_documents(docs: DataFrame, path: str, column: str = "text") -> None:
    """Texts, each closed by an empty line."""
    write_lines(docs, path, column, "\n\n")


def write_samples(samples: DataFrame, path: str) -> None:
    """Instruction samples as JSON lines with their three keys, and beside them with all."""
    samples.select("instruction", "input", "output").write.option("ignoreNullFields", False).json(f"{path}/jsonl")
    samples.write.option("ignoreNullFields", False).json(f"{path}/full")


def json_array(samples: DataFrame) -> DataFrame:
    """One row with all samples as a JSON array. For exports small enough for one cell; larger ones are JSON lines."""
    return samples.agg(F.to_json(F.collect_list(F.struct(*samples.columns))).alias("json"))


def checkpoint_batch(samples: DataFrame, path: str, batch: int) -> None:
    """Write a batch under its number; writing it again replaces it."""
    samples.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")


def prune_batches(spark: SparkSession, path: str, keep: int = 5) -> list[int]:
    """Remove all batches but the last ``keep`` by number; returns those that stay."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((int(s.getPath().getName().removeprefix("batch=")), s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch="))
    for _, old in found[:-keep]:
        fs.delete(old, True)
    return [n for n, _ in found[-keep:]]


def question_lines(pairs: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Question, answer and an empty line, for :func:`write_documents`."""
    return pairs.select(F.concat_ws("\n", question, answer).alias("text"))


def faq_report(faqs: DataFrame, order: str = "pos") -> DataFrame:
    """(category, n, entry): numbered anew in each category."""
    n = F.row_number().over(Window.partitionBy("category").orderBy(order))
    rows = faqs.withColumn("n", n)
    return rows.select("category", "n", F.format_string("Q%d: %s\nA%d: %s", "n", "question", "n", "answer").alias("entry"))


def write_chunks(lines: DataFrame, path: str, rows: int = 5_000_000, column: str = "line") -> None:
    """Files of at most ``rows`` lines."""
    lines.select(F.col(column).alias("value")).write.option("maxRecordsPerFile", rows).text(path)


def write_tokenizer(spark: SparkSession, vocab: Vocab, path: str, special: dict[str, str] | None = None) -> None:
    """A tokenizer folder: the vocabulary and a configuration."""
    vocab.write_tsv(spark, f"{path}/vocab")
    config = spark.createDataFrame([(len(vocab), vocab.seed_longest, special or {})], "vocab_size int, seed_longest int, special map<string,string>")
    config.coalesce(1).write.json(f"{path}/config")
