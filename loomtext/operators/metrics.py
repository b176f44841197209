"""Aggregates over lines, words, tokens and vocabularies.

Each is one group-by with map-side sums. Token arrays come from the tokenizer's
columns; nothing here encodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.filters import line_language, word_class
from loomtext.functions.text import DEVANAGARI, WS, col, count_class, n_words, strip, words

_MARKED = "▁▂"


def word_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """(word, n) of all words; no text is cut, so no word is."""
    return lines.select(F.explode(words(column)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_profile(counts: DataFrame, long: int = 200) -> DataFrame:
    """Total and distinct words, the length of the longest, and distinct words over ``long`` characters."""
    length = F.char_length("word")
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"), F.max(length).alias("longest"), F.count_if(length > long).alias("over_long")
    )


def length_counts(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` greatest word lengths and how many distinct words have each."""
    return counts.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("words")).orderBy(F.desc("length")).limit(n)


def fertility_by_line(encoded: DataFrame, line: str = "line", ids: str = "ids", space_id: int | None = None) -> DataFrame:
    """Tokens a word, and without spaces, over ALL lines and by kind: native only, or with a Latin letter or digit; with shares of lines."""
    kind = F.when(F.col(line).rlike("[A-Za-z0-9]"), "latin_or_digit").otherwise("native_only")
    spaces = F.size(F.filter(ids, lambda i: i == space_id)) if space_id is not None else F.lit(0)
    rows = encoded.select(kind.alias("kind"), n_words(line).cast("bigint").alias("w"), F.size(ids).cast("bigint").alias("t"), spaces.cast("bigint").alias("s"))
    out = rows.rollup("kind").agg(F.count("*").alias("lines"), F.sum("w").alias("words"), F.sum("t").alias("tokens"), F.sum("s").alias("spaces"))
    w = F.greatest("words", F.lit(1))
    out = out.select(
        F.coalesce("kind", F.lit("ALL")).alias("kind"), "lines", "words", "tokens", (F.col("tokens") / w).alias("fertility"), ((F.col("tokens") - F.col("spaces")) / w).alias("fertility_ex_space")
    )
    # Three rows.
    return out.withColumn("pct", 100.0 * F.col("lines") / F.max("lines").over(Window.partitionBy(F.lit(1))))


def fertility_by_word_class(encoded_words: DataFrame, word: str = "word", ids: str = "ids", n: str = "n") -> DataFrame:
    """Tokens a word by word class; each word encoded by itself and weighted by its count."""
    return (
        encoded_words.groupBy(word_class(word).alias("word_class"))
        .agg(F.sum(n).alias("words"), F.sum(F.col(n) * F.size(ids)).alias("tokens"))
        .withColumn("fertility", F.col("tokens") / F.col("words"))
    )


def verdict(native: Column, mixed: Column) -> Column:
    """What the gap between mixed and native fertility says."""
    return F.when(mixed - native > 0.15, "script_coverage").otherwise("balanced")


def worst_words(encoded_words: DataFrame, least: int = 5, n: int = 15, word: str = "word", ids: str = "ids", count: str = "n") -> DataFrame:
    """The most frequent words of ``least`` tokens or more."""
    return encoded_words.filter(F.size(ids) >= least).select(word, F.size(ids).alias("tokens"), count).orderBy(F.desc(count), word).limit(n)


def sample_summary(rows: DataFrame, line: str = "line", ids: str = "ids", space: Column | None = None, back: Column | None = None) -> DataFrame:
    """Mean and exact median of tokens a word by row, their ratio over all, the share of spaces, and round trips."""
    w, t = n_words(line), F.size(ids)
    per = t / F.greatest(w, F.lit(1))
    return rows.agg(
        F.count("*").alias("rows"),
        F.avg(per).alias("mean_ratio"),
        F.median(per).alias("median_ratio"),
        (F.sum(t) / F.greatest(F.sum(w), F.lit(1))).alias("micro_ratio"),
        (F.sum(space if space is not None else F.lit(0)) / F.greatest(F.sum(t), F.lit(1))).alias("space_share"),
        F.count_if(back if back is not None else F.lit(True)).alias("round_trips"),
    )


def validation_summary(rows: DataFrame, line: str, ids: str, decoded: str, unknown_id: int = -1) -> DataFrame:
    """Fertility, share of unknown tokens, and rows whose decoded text differs but for outer white space."""
    t = F.size(ids)
    return rows.agg(
        (F.sum(t) / F.greatest(F.sum(n_words(line)), F.lit(1))).alias("fertility"),
        (F.sum(F.size(F.filter(ids, lambda i: i == unknown_id))) / F.greatest(F.sum(t), F.lit(1))).alias("unk_rate"),
        F.count_if(strip(line) != strip(decoded)).alias("round_trip_failures"),
    )


def benchmark_rows(rows: DataFrame, tokenizer: str = "tokenizer", line: str = "line", ids: str = "ids", unknown_id: int = -1) -> DataFrame:
    """A row a tokenizer: tokens, share of unknown ones, tokens a word, characters and bytes a token, and characters a token out of eight."""
    t = F.sum(F.size(ids))
    some = F.greatest(t, F.lit(1))
    chars = F.sum(F.char_length(line)) / some
    return rows.groupBy(tokenizer).agg(
        t.alias("total_tokens"),
        (100.0 * F.sum(F.size(F.filter(ids, lambda i: i == unknown_id))) / some).alias("unk_pct"),
        (t / F.greatest(F.sum(n_words(line)), F.lit(1))).alias("tokens_per_word"),
        chars.alias("chars_per_token"),
        (F.sum(F.octet_length(line)) / some).alias("bytes_per_token"),
        (chars / 8 * 100).alias("efficiency"),
    )


def character_coverage(vocab: DataFrame, first: str = "ऀ", last: str = "ॿ", most: int = 100_000) -> DataFrame:
    """Distinct characters of a range among the first surfaces, and their share of it."""
    size = ord(last) - ord(first) + 1
    chars = vocab.filter(F.col("id") < most).select(F.explode(F.split("surface", "")).alias("c")).filter(F.col("c").between(first, last))
    return chars.agg(F.countDistinct("c").alias("covered")).withColumn("coverage", F.col("covered") / size)


def shared_tokens(pairs: DataFrame, a: str = "ids_a", b: str = "ids_b") -> DataFrame:
    """Mean over word pairs of their distinct shared tokens by the longer's length."""
    shared = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b), F.lit(1))
    return pairs.agg(F.avg(shared).alias("morph_share"))


def continuation_rate(rows: DataFrame, pieces: str = "pieces") -> DataFrame:
    """Share of pieces that do not begin a word."""
    return rows.agg((F.sum(F.size(F.filter(pieces, lambda p: ~p.startswith(_MARKED[0]) & ~p.startswith(_MARKED[1])))) / F.greatest(F.sum(F.size(pieces)), F.lit(1))).alias("continuation_rate"))


def boundaries(pieces: Column | str) -> Column:
    """Inner offsets at which pieces end."""
    p = col(pieces)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1))), lambda i: F.char_length(F.array_join(F.slice(p, F.lit(1), i), "")))
    return F.filter(ends, lambda e: (e > 0) & (e < F.char_length(F.array_join(p, ""))))


def boundary_scores(pieces: Column | str, gold: Column | str, empty: float = 0.0) -> Column:
    """struct<p, r, f1> of inner boundaries; zeros where either has none, or ``empty`` where both have none."""
    a, b = boundaries(pieces), boundaries(gold)
    hit = F.size(F.array_intersect(a, b))
    p, r = hit / F.greatest(F.size(a), F.lit(1)), hit / F.greatest(F.size(b), F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.struct(*[F.when(none, empty).otherwise(v).alias(n) for n, v in (("p", p), ("r", r), ("f1", f1))])


def macro_boundary_scores(rows: DataFrame, pieces: str = "pieces", gold: str = "morphs") -> DataFrame:
    scored = rows.select(boundary_scores(pieces, gold).alias("s"))
    return scored.agg(*[F.avg(f"s.{n}").alias(n) for n in ("p", "r", "f1")])


def bits_per_character(bits: Column, chars: Column) -> Column:
    return bits / F.greatest(chars, F.lit(1))


def script_profile(c: Column | str, native: str = DEVANAGARI) -> Column:
    """Characters of a word by class. Classes overlap (a vowel sign is native and not alphanumeric), so ``other`` may be negative."""
    c = col(c)
    dev, latin = count_class(c, native), count_class(c, "A-Za-z")
    digit, marks = count_class(c, r"\p{Nd}"), count_class(c, r"^\p{L}\p{N}")
    return F.struct(dev.alias("dev"), latin.alias("latin"), digit.alias("digit"), marks.alias("not_alnum"), (F.char_length(c) - dev - latin - digit - marks).alias("other"))


def language_mix(lines: DataFrame, column: str = "line", native: str = DEVANAGARI) -> DataFrame:
    """Shares of English, native and mixed lines in per cent."""
    kinds = lines.select(line_language(column, native).alias("k"))
    share = lambda k: (100.0 * F.count_if(F.col("k") == k) / F.greatest(F.count("*"), F.lit(1))).alias(f"{k}_pct")
    return kinds.agg(F.count("*").alias("lines"), share("eng"), share("nep"), share("mixed"))


def combine_statistics(docs: DataFrame, expected: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Numbered articles: distinct, duplicate, missing and blank ones, and the mean length of those that are not blank."""
    body = strip(text)
    rows = docs.select(F.col(key), F.md5(body.cast("binary")).alias("h"), F.char_length(body).alias("n"))
    full = rows.filter("n > 0")
    texts = full.groupBy("h").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    a = texts.agg(F.count("*").alias("unique_texts"), (F.coalesce(F.sum("c"), F.lit(0)) - F.count("*")).alias("duplicates"), F.avg("n").alias("avg_chars"))
    b = rows.agg((F.lit(expected).cast("bigint") - F.countDistinct(key)).alias("missing"), F.count_if(F.col("n") == 0).alias("blank"))
    return a.join(b)


def clean_statistics(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Characters before and after, and rows kept and removed."""
    chars = lambda c: F.coalesce(F.sum(F.char_length(c)), F.lit(0)).cast("bigint")
    return rows.agg(chars(before).alias("chars_before"), chars(after).alias("chars_after"), F.count_if(F.col(after) != "").alias("kept"), F.count_if(F.coalesce(F.col(after), F.lit("")) == "").alias("removed"))


def character_set(vocab: DataFrame, column: str = "surface") -> DataFrame:
    """Distinct characters of all surfaces, with the number of surfaces that hold each."""
    own = F.explode(F.array_distinct(F.split(column, "")))
    return vocab.select(own.alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("surfaces"))


def native_share(vocab: DataFrame, low: int = 100, high: int = 199) -> DataFrame:
    """Share of surfaces in a range of ids that hold a native character."""
    return vocab.filter(F.col("id").between(low, high)).agg((F.count_if(F.col("surface").rlike(f"[{DEVANAGARI}]")) / F.greatest(F.count("*"), F.lit(1))).alias("native_share"))


def characters_per_token(line: Column | str, ids: Column | str) -> Column:
    return F.char_length(col(line)) / F.greatest(F.size(col(ids)), F.lit(1))


def blank_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.agg(F.count_if(~F.col(column).rlike(f"[^{WS}]")).alias("blank"))
