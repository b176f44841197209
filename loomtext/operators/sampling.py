"""Samples, limits, top lists, batches and merges of corpora.

Seeded orders come from a hash of seed and key, so they are the same for any
partitioning. Running sums over a whole corpus are taken in two levels, blocks and
within blocks, so no task sorts all rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import DEVANAGARI, WS, col, flatten, strip, tagged, words
from loomtext.session import materialise


def seeded(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def running_total(df: DataFrame, value: Column, order: Sequence[Column | str], into: str = "running", blocks: int | None = None) -> DataFrame:
    """Add the sum of ``value`` over all rows up to each, in a total order.

    Rows are dealt into ranges of the order; sums of ranges are few and added up in one
    window, sums within a range in another.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = df.withColumn("__v", value.cast("bigint")).withColumns({k: col(o) for k, o in zip(keys, order)})
    dealt = materialise(dealt.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("__part").agg(F.sum("__v").alias("__n"))
    before = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.sum("__v").over(Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__own")).drop("__v", "__part", "__own", "__before", *keys)


def numbered(df: DataFrame, order: Sequence[Column | str], into: str = "n") -> DataFrame:
    """Add the place of each row in a total order, from 1."""
    return running_total(df, F.lit(1), order, into)


#: Documents of which a first fit is ended on the driver, by their keys and sizes.
TAIL_ROWS = 100_000


def _first_fit(rows: list, left: int) -> list:
    """Keys of (key, size) rows in order that fit one after another."""
    out = []
    for k, size in rows:
        if size <= left:
            out.append(k)
            left -= size
    return out


def byte_budget(docs: DataFrame, budget: int, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A seeded first-fit sample: documents in a hashed order, those that do not fit left out, until nothing fits.

    A document costs its UTF-8 bytes and 2. If all fit, all are returned. First fit
    is sequential, but in long runs: all documents up to the first that overflows
    fit, those dearer than what is left then drop out at once, and the scan goes on
    behind it. So each round is one running sum over what may still fit. When at most
    ``TAIL_ROWS`` documents may, the driver scans their keys and sizes.
    """
    sized = docs.select(F.col(key).alias("k"), (F.octet_length(text) + 2).cast("bigint").alias("size")).filter("size is not null")
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= budget:
        return docs
    left, taken, rest = budget, None, sized.withColumn("o", seeded(seed, "k"))
    while left > 0:
        rest = rest.filter(F.col("size") <= left)
        if rest.count() <= TAIL_ROWS:
            keys = _first_fit([(r.k, r["size"]) for r in rest.orderBy("o", "k").collect()], left)
            own = docs.sparkSession.createDataFrame([(k,) for k in keys], rest.select("k").schema)
            taken = own if taken is None else taken.unionAll(own)
            break
        rest = materialise(running_total(rest, F.col("size"), ["o", "k"]), "budget")
        fits = rest.filter(F.col("running") <= left)
        used = fits.agg(F.sum("size")).first()[0]
        if not used:
            break
        own = fits.select("k")
        taken = own if taken is None else taken.unionAll(own)
        left -= used
        rest = rest.filter(F.col("running") > used).drop("running")
    if taken is None:
        return docs.limit(0)
    return docs.join(taken, docs[key].eqNullSafe(taken["k"]), "left_semi")


def merge_corpora(corpora: Mapping[str, DataFrame], budgets: Mapping[str, int] | None = None, seed: int = 42, tag: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each corpus sampled to its budget, marked with its language if asked, all shuffled by the next seed: (lang, key, text)."""
    out = None
    for lang, docs in corpora.items():
        own = byte_budget(docs, budgets[lang], seed, key, text) if budgets and lang in budgets else docs
        body = tagged(text, lang) if tag else F.col(text)
        part = own.select(F.lit(lang).alias("lang"), F.col(key), body.alias(text))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(seeded(seed + 1, "lang", key), "lang", key)


def first_rows(lines: DataFrame, n: int, order: Sequence[str], column: str = "line") -> DataFrame:
    """The first ``n`` lines that are not blank."""
    return lines.filter(strip(column) != "").orderBy(*order).limit(n)


def rows_between(df: DataFrame, order: Sequence[str], start: int, stop: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(stop - start)


def byte_limit(docs: DataFrame, target: int, order: Sequence[str], text: str = "text") -> DataFrame:
    """Rows in order until the target is reached; the one that crosses it is included."""
    size = F.octet_length(text).cast("bigint")
    summed = running_total(docs, F.coalesce(size, F.lit(0)), order)
    return summed.filter(F.col("running") - F.coalesce(size, F.lit(0)) < target).drop("running")


def longest_words(lines: DataFrame, n: int = 5, column: str = "line", native_only: bool = False) -> DataFrame:
    """The ``n`` longest words with their lengths; a word may come more than once."""
    own = lines.select(F.explode(words(column)).alias("word"))
    if native_only:
        own = own.filter(F.col("word").rlike(f"[{DEVANAGARI}]"))
    return own.select("word", F.char_length("word").alias("length")).orderBy(F.desc("length"), F.desc("word")).limit(n)


def most_common(df: DataFrame, column: str, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` most frequent values; of equally frequent ones those seen first."""
    counted = df.groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(n).select(column, "n")


def concat_corpora(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """UNION ALL with the rank of each source, in order of source and row."""
    out = None
    for rank, part in enumerate(parts):
        own = part.withColumn("source_rank", F.lit(rank))
        out = own if out is None else out.unionByName(own)
    return out.orderBy("source_rank", *order)


def with_block(corpus: DataFrame, lines: Sequence[str], column: str = "line") -> DataFrame:
    """The corpus and a block of literal lines."""
    spark = corpus.sparkSession
    return corpus.select(column).unionAll(spark.createDataFrame([(x,) for x in lines], f"{column} string"))


def batches(df: DataFrame, size: int, order: Sequence[str], column: str) -> DataFrame:
    """(batch, items): runs of ``size`` rows in order."""
    own = numbered(df, order, "__n")
    rows = own.select(F.floor((F.col("__n") - 1) / size).alias("batch"), F.struct("__n", column).alias("x"))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[column]).alias("items"))


def question_answer_blocks(c: Column | str) -> Column:
    """array<struct<question, answer>> of a text of blocks parted by blank lines; a block of one line has no answer."""
    blocks = F.filter(F.split(col(c), "\n\n"), lambda b: b.rlike(f"[^{WS}]"))
    cut = lambda b: F.split(b, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    made = F.transform(blocks, lambda b: F.struct(flatten(F.get(cut(b), F.lit(0))).alias("question"), flatten(F.get(cut(b), F.lit(1))).alias("answer")))
    return F.filter(made, lambda p: (p["question"] != "") | (F.coalesce(p["answer"], F.lit("")) != ""))
