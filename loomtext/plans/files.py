"""Queries of sources and sinks: a table is written to the shared folder by a sink and read back by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.registry import LINES, lines_of, query, table
from loomtext.plans.tokens import base_vocab
from loomtext.session import scratch
from loomtext.sources import readers, sinks
from loomtext.tokenizer import vocab as vb


@query("k1_s1_lines", f"{LINES} SELECT line, count(*) AS n FROM lines GROUP BY line")
def k1(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_lines(lines_of(spark, d), path := scratch(spark, "lines"))
    return readers.unordered_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("k1_s2_documents", "SELECT replace(text, chr(10), ' ') AS text, count(*) AS n FROM documents WHERE replace(text, chr(10), '') <> '' GROUP BY 1")
def k1_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    sinks.write_documents(docs.filter("trim(text) <> ''"), path := scratch(spark, "documents"))
    return readers.large_documents(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("s3_s7_text_files", "SELECT source, count(*) AS lines, sum(length(row) + 1)::BIGINT - 1 AS chars, count(DISTINCT row) AS distinct_lines FROM (SELECT source, 'row ' || doc_id || ' in ' || lang AS row FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY source")
def s3(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.format_string("row %d in %s", "doc_id", "lang").alias("value")).filter("source is not null and value not like '% in null'")
    rows.repartition("source").write.partitionBy("source").text(path := scratch(spark, "files"))
    found = readers.text_files(spark, path, "*.txt", skip="combined_").withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    cut = F.split("text", "\n")
    return found.groupBy("source").agg(
        F.sum(F.size(cut)).alias("lines"), (F.sum(F.char_length("text") + 1) - 1).alias("chars"), F.sum(F.size(F.array_distinct(cut))).alias("distinct_lines")
    )


@query("s6_files_with_header", "SELECT source, true AS headed, count(*) + 1 AS lines FROM documents WHERE source IS NOT NULL GROUP BY source")
def s6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("source is not null").select("source", F.format_string("row %d", "doc_id").alias("value"))
    rows.repartition("source").write.partitionBy("source").text(path := scratch(spark, "files"))
    found = readers.with_header(readers.text_files(spark, path, "*.txt", skip="combined_")).withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    headed = F.startswith("text", F.format_string("===== FILE: %s =====\nrow ", "name"))
    return found.groupBy("source").agg(F.min(headed).alias("headed"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


@query("s9_json_pairs", "SELECT lang AS native, source AS english, count(*) AS n FROM documents WHERE lang <> '' AND source <> '' GROUP BY 1, 2")
def s9(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select(F.col("lang").alias("native word"), F.col("source").alias("english word"))
    pairs.write.json(path := scratch(spark, "pairs"))
    return readers.json_pairs(spark, path).groupBy("native", "english").agg(F.count("*").alias("n"))


@query("s8_json_texts", "SELECT text, count(*) AS n FROM documents WHERE regexp_matches(text, '[^\\s]') GROUP BY text")
def s8(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "documents").select("text").write.json(path := scratch(spark, "texts"))
    return readers.json_texts(spark, path).groupBy("text").agg(F.count("*").alias("n"))


@query("s10_csv_columns", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents WHERE text <> ''")
def s10(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text <> ''").select("doc_id", "text", "lang", "source", "n_chars")
    writer = docs.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path := scratch(spark, "csv"))
    return readers.csv_columns(spark, path, 3, "UTF-8")


@query("s11_chat_comments", "SELECT text AS comment, count(*) AS n FROM conversations WHERE text <> '' GROUP BY text")
def s11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("text <> ''").select("role", F.col("text").alias("comment"))
    writer = rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path := scratch(spark, "chat"))
    return readers.chat_comments(spark, path).groupBy("comment").agg(F.count("*").alias("n"))


_SEEN = f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[A-Za-z]+')) AS word FROM lines), counts AS (SELECT word, count(*) AS n FROM words WHERE length(word) >= 4 GROUP BY word)"


def _seen(spark: SparkSession, d: str) -> DataFrame:
    rows = lines_of(spark, d).select(F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return rows.filter(F.char_length("word") >= 4).groupBy("word").agg(F.count("*").alias("n"))


@query("s18_gold_segmentation_files", f"{_SEEN} SELECT word, substr(word, 1, 2) || '|' || substr(word, 3) AS morphs FROM counts")
def s18(spark: SparkSession, d: str) -> DataFrame:
    line = F.format_string("%s\t%s+%s", "word", F.substring("word", 1, 2), F.expr("substring(word, 3)"))
    sinks.write_lines(_seen(spark, d).select(line.alias("line")), path := scratch(spark, "gold"))
    return readers.gold_segmentation(spark, path).select("word", F.array_join("morphs", "|").alias("morphs"))


@query("s20_segmentation_dump", f"{_SEEN} SELECT n, substr(word, 1, 2) AS first_segment, substr(word, 3) AS second_segment FROM counts")
def s20(spark: SparkSession, d: str) -> DataFrame:
    own = F.format_string("%d %s + %s", "n", F.substring("word", 1, 2), F.expr("substring(word, 3)")).alias("line")
    sinks.write_lines(_seen(spark, d).select(own).unionAll(spark.createDataFrame([("# a comment",)], "line string")), path := scratch(spark, "dump"))
    return readers.segmentation_dump(spark, path).select("n", F.col("segments")[0].alias("first_segment"), F.col("segments")[1].alias("second_segment"))


@query("s17_k3_k8_vocabulary_files")
def s17(spark: SparkSession, d: str) -> DataFrame:
    vocab = base_vocab()
    sinks.write_tokenizer(spark, vocab, path := scratch(spark, "tokenizer"), {"cls": "<s>"})
    read = vb.Vocab.read_tsv(spark, f"{path}/vocab")
    return read.table(spark).select("id", "surface").join(vocab.table(spark).select("id", F.col("surface").alias("written")), "id").withColumn("same", F.col("surface") == F.col("written"))


@query("k2_json_samples", "SELECT 'Answer.' AS instruction, text AS input, role AS output, count(*) AS n FROM conversations GROUP BY text, role")
def k2(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "conversations").select(F.lit("Answer.").alias("instruction"), F.col("text").alias("input"), F.col("role").alias("output"), "conv_id")
    sinks.write_samples(samples, path := scratch(spark, "samples"))
    rows = spark.read.schema("instruction string, input string, output string").json(f"{path}/jsonl")
    return rows.groupBy("instruction", "input", "output").agg(F.count("*").alias("n"))


@query("k10_chunks", f"{LINES} SELECT count(*) AS lines, true AS within FROM lines")
def k10(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_chunks(lines_of(spark, d), path := scratch(spark, "chunks"), 1000)
    sizes = readers.unordered_lines(spark, path).groupBy("file").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("lines"), (F.max("n") <= 1000).alias("within"))
