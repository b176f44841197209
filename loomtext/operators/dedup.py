"""Exact deduplication. The first occurrence in a given order is kept; only digests are shuffled where texts need not be.

``order`` names the columns that order rows, such as (file, pos). A keep-first is a
group-by with a map-side minimum of the order and a join back on it, so neither a
text nor a hot line meets in one task as it would in a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WS, col, strip


def digest(c: Column | str) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def keep_first(df: DataFrame, key: Column, order: Sequence[str], always: Column | None = None) -> DataFrame:
    """Rows whose key does not occur earlier; rows where ``always`` holds are kept besides.

    ``order`` must tell rows apart; a null in it comes first. Rows with a null key are kept once.
    """
    keyed = df.withColumn("__key", key)
    if always is not None:
        keyed = keyed.withColumn("__always", F.coalesce(always, F.lit(False)))
        once = keyed.filter(~F.col("__always"))
    else:
        once = keyed
    first = once.groupBy("__key").agg(F.min(F.struct(*order)).alias("__first"))
    first = first.select(*(F.col("__first")[c].alias(f"__first_{c}") for c in order))
    kept = once.join(first, reduce(and_, (once[c].eqNullSafe(first[f"__first_{c}"]) for c in order)), "left_semi")
    if always is not None:
        kept = kept.unionByName(keyed.filter("__always")).drop("__always")
    return kept.drop("__key").select(*df.columns)


def exact_lines(lines: DataFrame, order: Sequence[str] = ("file", "pos"), column: str = "line") -> DataFrame:
    """Lines without later copies; blank lines all stay."""
    return keep_first(lines, digest(column), order, F.col(column) == "")


def exact_documents(docs: DataFrame, order: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    return keep_first(docs, digest(column), order)


def line_statistics(lines: DataFrame, column: str = "line") -> DataFrame:
    """total, kept, duplicates and their share in per cent; blank lines count in the total, and so among the duplicates."""
    groups = lines.groupBy(digest(column).alias("h"), (F.col(column) == "").alias("blank")).agg(F.count("*").alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~F.col("blank"))
    return groups.agg(total.alias("total"), kept.alias("kept")).select(
        "total", "kept", (F.col("total") - F.col("kept")).alias("duplicates"), (100.0 * (F.col("total") - F.col("kept")) / F.greatest("total", F.lit(1))).alias("dup_pct")
    )


def stripped_lines(lines: DataFrame, order: Sequence[str] = ("file_rank", "pos"), column: str = "line", least: int = 5) -> DataFrame:
    """Over several files in the order of their rank: stripped lines of at least ``least`` characters, without later copies."""
    short = lines.withColumn(column, strip(column)).filter(F.char_length(column) >= least)
    return keep_first(short, F.md5(F.col(column).cast("binary")), order)


def distinct_files(files: DataFrame) -> DataFrame:
    """Of ``files(path, content)`` the first of each content, by path; empty files are left out."""
    full = files.filter(F.octet_length("content") > 0)
    return keep_first(full, F.md5("content"), ["path"])


def articles(docs: DataFrame, order: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """Stripped texts without later copies; blank ones are left out."""
    own = docs.withColumn(column, strip(column)).filter(F.col(column) != "")
    return keep_first(own, F.md5(F.col(column).cast("binary")), order)


def duplicate_report(docs: DataFrame, column: str = "text") -> DataFrame:
    """Rows, distinct texts, duplicates, their rate, and characters in all and in distinct texts; blank texts are left out."""
    groups = docs.filter(F.col(column).rlike(f"[^{WS}]")).groupBy(digest(column).alias("h")).agg(F.count("*").alias("n"), F.max(F.char_length(column)).alias("chars"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(
        total.alias("total"),
        F.count("*").alias("unique_texts"),
        (total - F.count("*")).alias("duplicates"),
        ((total - F.count("*")) / F.greatest(total, F.lit(1))).alias("dup_rate"),
        F.coalesce(F.sum(F.col("n") * F.col("chars")), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("chars").cast("bigint"), F.lit(0)).alias("unique_chars"),
    )


def distinct_pairs(pairs: DataFrame, native: str = "native", english: str = "english") -> DataFrame:
    """Distinct pairs with both sides, in code-point order."""
    full = pairs.filter((F.col(native) != "") & (F.col(english) != ""))
    return full.select(native, english).distinct().orderBy(native, english)


def first_contexts(rows: DataFrame, n: int, order: Sequence[str], column: str = "context") -> DataFrame:
    """The first ``n`` distinct non-blank contexts, in order."""
    own = rows.withColumn(column, strip(column)).filter(F.col(column) != "")
    return keep_first(own, digest(column), order).orderBy(*order).limit(n)
