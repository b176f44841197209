"""Sources: lines, blank-line documents, whole files, JSON, CSV, pairs and vocabulary files.

A row's place is part of the data: ``(file, pos)`` orders lines. Encodings other
than UTF-8 are read as bytes and decoded, as the text source knows UTF-8 only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.text import WS, col, strip

NEWLINE = r"\r\n|\r|\n"


def decoded(content: Column | str, errors: str = "replace") -> Column:
    """Bytes as text. ``replace``; ``ignore``: without the replacement characters; ``latin-1``: UTF-8 if it is, else Latin-1; ``strict``: null if it is not."""
    c = col(content)
    strict, loose = F.try_validate_utf8(c.cast("string")), F.make_valid_utf8(c.cast("string"))
    if errors == "strict":
        return strict
    if errors == "ignore":
        return F.replace(loose, F.lit("�"), F.lit(""))
    return F.coalesce(strict, F.decode(c, "ISO-8859-1")) if errors == "latin-1" else loose


def _files(spark: SparkSession, path, pattern: str | None, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "content")


def lines(spark: SparkSession, path, errors: str = "replace") -> DataFrame:
    """(file, pos, line). Files are split among tasks only by file here, as the place of a line needs its whole file.

    A task streams a file's bytes and holds one. For a corpus in very large files
    use :func:`unordered_lines`, or write it in parts first.
    """
    text = _files(spark, path, None, True).select(F.col("path").alias("file"), decoded("content", errors).alias("text"))
    cut = F.split(F.regexp_replace("text", f"(?:{NEWLINE})\\z", ""), NEWLINE)
    return text.filter("text <> ''").select("file", F.posexplode(cut).alias("pos", "line")).select("file", F.col("pos").cast("bigint"), "line")


def unordered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line), split within files; for operators to which order is nothing."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def split_documents(df: DataFrame, text: str = "text", key: str = "file") -> DataFrame:
    """(key, pos, text): documents of a text that are parted by empty lines; a line with a blank parts nothing."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    parts = F.filter(F.transform(F.split(unix, "\n\n+"), lambda d: F.regexp_replace(d, "^\n+|\n+\\z", "")), lambda d: d != "")
    return df.select(key, F.posexplode(parts).alias("pos", "text"))


def documents(spark: SparkSession, path, errors: str = "replace") -> DataFrame:
    """(file, pos, text) of files whose documents are parted by empty lines."""
    return split_documents(_files(spark, path, None, True).select(F.col("path").alias("file"), decoded("content", errors).alias("text")))


def large_documents(spark: SparkSession, path) -> DataFrame:
    """(file, text) of such files of any size, split within files; documents are in no order."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    body = F.regexp_replace("value", "^\n+|\n+\\z", "")
    return rows.select(F.col("_metadata.file_path").alias("file"), body.alias("text")).filter("text <> ''")


def group_documents(lines_: DataFrame) -> DataFrame:
    """(file, doc, text) from (file, pos, line): runs of lines that are not empty."""
    from pyspark.sql import Window

    order = Window.partitionBy("file").orderBy("pos")
    rows = lines_.withColumn("doc", F.sum((F.col("line") == "").cast("int")).over(order)).filter("line <> ''")
    return rows.groupBy("file", "doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def text_files(spark: SparkSession, path, pattern: str = "*.txt", errors: str = "latin-1", skip: str | None = None) -> DataFrame:
    """(path, name, text) of all matching files below a folder; blank ones are left out, and those whose name begins with ``skip``."""
    rows = _files(spark, path, pattern, True).withColumn("name", F.element_at(F.split("path", "/"), -1))
    if skip:
        rows = rows.filter(~F.col("name").startswith(skip))
    return rows.select("path", "name", strip(decoded("content", errors)).alias("text")).filter("text <> ''")


def with_header(rows: DataFrame, form: str = "===== FILE: %s =====", name: str = "name", text: str = "text") -> DataFrame:
    """A file's name as a line above its text."""
    return rows.withColumn(text, F.concat(F.format_string(form, name), F.lit("\n"), F.col(text)))


def numbered_files(spark: SparkSession, path, count: int) -> tuple[DataFrame, DataFrame]:
    """(number, text) of files ``0.txt`` to ``count - 1``, and the numbers that are missing."""
    rows = text_files(spark, path).withColumn("number", F.regexp_extract("name", r"^([0-9]+)\.txt$", 1).try_cast("bigint"))
    rows = rows.filter(F.col("number").between(0, count - 1)).select("number", "text")
    return rows, spark.range(count).withColumnRenamed("id", "number").join(rows.select("number"), "number", "left_anti")


def json_texts(spark: SparkSession, path) -> DataFrame:
    """(text) of JSON lines; unreadable lines and blank texts are left out."""
    return spark.read.schema("text string").option("mode", "DROPMALFORMED").json(path).filter(F.col("text").rlike(f"[^{WS}]"))


def json_pairs(spark: SparkSession, path) -> DataFrame:
    """(native, english) of JSON lines with the keys "native word" and "english word", where both are filled."""
    rows = spark.read.schema("`native word` string, `english word` string").option("mode", "DROPMALFORMED").json(path)
    rows = rows.select(strip("native word").alias("native"), strip("english word").alias("english"))
    return rows.filter("native <> '' and english <> ''")


def csv_columns(spark: SparkSession, path, first: int = 7, encoding: str = "ISO-8859-1") -> DataFrame:
    """The first columns of a CSV file with quoted line breaks; malformed rows are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)
    return rows.select(*rows.columns[:first])


def chat_comments(spark: SparkSession, path) -> DataFrame:
    """(comment) of a chat export; nulls are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("comment").filter("comment is not null")


def table_texts(df: DataFrame, content: str = "content") -> DataFrame:
    """A column of contents, null as the empty text."""
    return df.select(F.coalesce(content, F.lit("")).alias("text"))


def titled(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    return df.select(F.format_string("=== %s ===\n%s\n\n", title, text).alias("article"))


def gold_segmentation(spark: SparkSession, path) -> DataFrame:
    """(word, morphs) of lines ``word TAB part+part``."""
    cut = F.split("value", "\t")
    return spark.read.text(path).filter(F.col("value").contains("\t")).select(strip(cut[0]).alias("word"), F.split(strip(cut[1]), r"\+").alias("morphs"))


def segmentation_dump(spark: SparkSession, path) -> DataFrame:
    """(n, segments) of lines ``count part + part``; lines that begin with # are comments."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").rlike(r"^[0-9]+ "))
    return rows.select(F.regexp_extract("value", "^([0-9]+) ", 1).cast("bigint").alias("n"), F.split(F.regexp_replace("value", "^[0-9]+ ", ""), r" \+ ").alias("segments"))


def batches_of(texts: Iterator[str], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """A stream of texts from elsewhere as Arrow batches, for a plug-in source."""
    held: list[str] = []
    for t in texts:
        held.append(t or "")
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["text"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held)], names=["text"])
