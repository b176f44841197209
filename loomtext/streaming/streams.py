"""Structured Streaming forms of row-local cleaning, of exact dedup and of the look-back over kept lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.dedup import digest


def cleaned(lines: DataFrame, clean: Column, keep: Column, column: str = "line") -> DataFrame:
    """Clean a stream's lines and keep those that pass; there is no state."""
    return lines.withColumn(column, clean).filter(keep)


def first_occurrences(lines: DataFrame, time: str | None = None, delay: str = "1 hour", column: str = "line") -> DataFrame:
    """Lines not seen before; blank ones pass through without state.

    With an event-time column only digests of the last ``delay`` are remembered, so state is bounded; without one it is every digest.
    """
    keyed = lines.withColumn("__h", F.when(F.col(column) == "", F.uuid()).otherwise(digest(column)))
    if time is None:
        return keyed.dropDuplicates(["__h"]).drop("__h")
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def look_back(lines: DataFrame, by: str, near, column: str = "line", window: int = 50) -> DataFrame:
    """Lines of each key unlike its last ``window`` kept ones; ``near(a, b)`` says what is alike. State is ``window`` lines a key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            take = []
            for line in frame[column]:
                ok = not any(line == k or near(line, k) for k in kept)
                take.append(ok)
                if ok:
                    kept = [*kept, line][-window:]
            yield frame[take]
        state.update((kept,))

    return lines.groupBy(by).applyInPandasWithState(step, lines.schema, "kept array<string>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows of each key in tumbling windows of event time, late ones within the delay included."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
