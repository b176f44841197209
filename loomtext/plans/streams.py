"""Queries of the streaming operators: a table is read as a stream of its files, written by a streaming query, and read back.

Streams are an extension: the batch operators of the same names define the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import filters as fl
from loomtext.functions import text as tx
from loomtext.operators.neardup import alike
from loomtext.plans.registry import LINES, lines_of, query, table
from loomtext.session import scratch
from loomtext.streaming import streams


def _stream(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    rows.write.parquet(path := scratch(spark, "stream-in"))
    return spark.readStream.schema(rows.schema).parquet(path)


def _through(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a streaming query writes of the whole stream."""
    spark = stream.sparkSession
    path, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", state)
    # A complete result replaces the one before; foreachBatch is told of each.
    writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)) if mode == "complete" else writer.format("parquet").option("path", path)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("stream_first_occurrences", f"{LINES} SELECT line, CASE WHEN line = '' THEN count(*) ELSE 1 END AS n FROM lines GROUP BY line")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    out = _through(streams.first_occurrences(_stream(lines_of(spark, d))))
    return out.groupBy("line").agg(F.count("*").alias("n"))


@query("stream_cleaned_lines", f"{LINES}, f AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines) SELECT doc_id, pos, line FROM f WHERE len(regexp_extract_all(line, '[^\\s]+')) BETWEEN 3 AND 512")
def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return _through(streams.cleaned(_stream(lines_of(spark, d)), tx.flatten("line"), fl.words_between("line")))


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _through(streams.windowed_counts(_stream(events), "ts", "event_type", "1 hour"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_look_back")
def look_back(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").filter("text is not null").select("conv_id", F.col("text").alias("line"))
    return _through(streams.look_back(_stream(rows), "conv_id", alike(0.70, 2)))
