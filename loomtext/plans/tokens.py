"""Queries of the tokenizer and of statistics over tokens.

The vocabulary is trained by the query itself on the fixture and the conversations' first words, as no trained
vocabulary comes with the data; the base alphabet covers Latin and Devanagari.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import filters as fl
from loomtext.functions import text as tx
from loomtext.operators import metrics
from loomtext.plans.registry import EVERY, LINES, every_line, fixture, lines_of, query, table
from loomtext.tokenizer import codec as cd
from loomtext.tokenizer import train as tr
from loomtext.tokenizer import vocab as vb

#: Aksharas in SQL: letters of Devanagari joined by viramas, closed by a sign; or any character alone.
_L, _S = "[\\x{0915}-\\x{093D}\\x{094E}-\\x{095F}\\x{0964}-\\x{097F}]", "[\\x{0900}-\\x{0903}\\x{093E}-\\x{094C}\\x{0962}\\x{0963}]"
_AKSHARA_SQL = f"{_L}(?:\\x{{094D}}+{_L}?)*{_S}?|(?:\\x{{094D}}+{_L}?)+{_S}?|."
FOLDS = {"सङ्ग": "संग", "सँग": "संग"}
SEEDS = ["गा.वि.स.", "ने.क.पा.ए.मा.ले.", "सन्", "2020", "को", "मा", "हरू", "निर्णय"]


def base_vocab() -> vb.Vocab:
    letters = [chr(c) for c in range(0x0900, 0x0980)]
    return vb.Vocab.initialize(letters, SEEDS, list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥"), ["हरू"], ["को", "मा"])


def trained(spark: SparkSession, d: str, native: int = 40, latin: int = 400) -> vb.Vocab:
    """A small vocabulary trained on the fixture and the documents."""
    lines = lines_of(spark, d).select("line").unionAll(fixture(spark).select("line"))
    vocab = base_vocab()
    return tr.train_bilingual(lines, vocab, len(vocab) + native, latin, theta=2, least=2, normalizer=vb.Normalizer(FOLDS))


@query("t1_script_classes", f"""{EVERY}, c AS (SELECT unnest(string_split(line, '')) AS ch FROM every) SELECT ch, CASE WHEN regexp_matches(ch, '[A-Za-z0-9]') THEN 'LAT'
WHEN regexp_matches(ch, '[!-/:-@\\[-`{{-~\\x{{0964}}\\x{{0965}}\\x{{2010}}-\\x{{2015}}\\x{{2018}}-\\x{{201F}}\\x{{2026}}]') THEN 'PUN' WHEN regexp_matches(ch, '[\\x{{0900}}-\\x{{097F}}]') THEN 'DEV' ELSE 'MAL' END AS script, count(*) AS n
FROM c WHERE ch <> '' GROUP BY ch""")
def t1(spark: SparkSession, d: str) -> DataFrame:
    chars = every_line(spark, d).select(F.explode(F.split("line", "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.select("ch", cd.script_column("ch").alias("script"), "n")


@query("t2_marked_lines", f"{LINES} SELECT doc_id, pos, regexp_replace(regexp_replace(' ' || line, ' ([A-Za-z0-9])', '▂\\1', 'g'), ' ', '▁', 'g') AS marked FROM lines")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).select("doc_id", "pos", cd.mark_column("line").alias("marked"))


@query("t3_byte_surfaces", "SELECT b::BIGINT AS byte, chr((CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN b WHEN b <= 32 THEN 256 + b WHEN b <= 160 THEN 256 + 33 + b - 127 ELSE 323 END)::INT) AS surface FROM range(256) t(b)")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vb.BYTES)), "byte bigint, surface string")


@query("t5_base_vocabulary")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return base_vocab().table(spark)


@query("t6_t8_t11_encode_round_trip", f"{LINES} SELECT doc_id, pos, true AS same FROM lines")
def t6(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    codec = cd.ColumnCodec(lines, trained(spark, d), vb.Normalizer(FOLDS))
    rows = lines.select("doc_id", "pos", codec.normalize("line").alias("norm"), codec.encode("line").alias("ids"))
    return rows.select("doc_id", "pos", (codec.decode("ids") == F.col("norm")).alias("same"))


#: A byte as the surface that stands for it, as in t3.
_BYTE = "chr((CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b >= 174 THEN b WHEN b <= 32 THEN 256 + b WHEN b <= 160 THEN 256 + 33 + b - 127 ELSE 323 END)::INT)"
_PIECE = f"""CASE WHEN ch IN ('▁', '▂') OR regexp_matches(ch, '^[!-~\\x{{2010}}-\\x{{2015}}\\x{{2018}}-\\x{{201F}}\\x{{2026}}]$') THEN ch
ELSE array_to_string(list_transform(list_transform(range(0, strlen(ch)), lambda k: ('0x' || substr(hex(encode(ch)), 2 * k::INT + 1, 2))::INT), lambda b: {_BYTE}), '|') END"""


@query("t6_base_pieces", f"""{LINES}, m AS (SELECT doc_id, pos, regexp_replace(regexp_replace(' ' || nfc_normalize(line), ' ([A-Za-z0-9])', '▂\\1', 'g'), ' ', '▁', 'g') AS marked FROM lines)
SELECT doc_id, pos, replace(array_to_string(list_transform(string_split(marked, ''), lambda ch: {_PIECE}), '|'), '2|0|2|0', '2020') AS pieces FROM m""")
def t6_pieces(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return lines.select("doc_id", "pos", F.array_join(cd.ColumnCodec(lines, base_vocab()).pieces("line"), "|").alias("pieces"))


_WRAPPED = f"array_to_string(list_transform(regexp_extract_all(nfc_normalize(line), '(?s){_AKSHARA_SQL}'), lambda p: chr(1) || p || chr(2)), '')"


@query("t6b_prototype_pieces", f"""{EVERY} SELECT kind, doc_id, pos, replace(replace(replace(replace({_WRAPPED}, chr(1) || 't' || chr(2) || chr(1) || 'h' || chr(2), chr(1) || 'th' || chr(2)),
chr(1) || 'th' || chr(2) || chr(1) || 'e' || chr(2), chr(1) || 'the' || chr(2)), chr(1), '<'), chr(2), '>') AS pieces FROM every""")
def t6b(spark: SparkSession, d: str) -> DataFrame:
    pieces = cd.prototype_pieces("line", [], [("t", "h"), ("th", "e")])
    return every_line(spark, d).select("kind", "doc_id", "pos", F.array_join(F.transform(pieces, lambda p: F.concat(F.lit("<"), p, F.lit(">"))), "").alias("pieces"))


def _automaton() -> vb.AksharaDFA:
    """Letters joined by single viramas, closed by one vowel sign."""
    dfa = vb.AksharaDFA()
    for c in map(chr, range(0x0915, 0x093A)):
        dfa.add(0, c, 1, True)
        dfa.add(2, c, 1, True)
    dfa.add(1, "्", 2, False)
    for c in map(chr, range(0x093E, 0x094D)):
        dfa.add(1, c, 3, True)
    return dfa


@query("t4_automaton_split", f"""{EVERY} SELECT kind, doc_id, pos, array_to_string(regexp_extract_all(line, '(?s)[\\x{{0915}}-\\x{{0939}}](?:\\x{{094D}}[\\x{{0915}}-\\x{{0939}}])*[\\x{{093E}}-\\x{{094C}}]?|.'), '|') AS parts FROM every""")
def t4_dfa(spark: SparkSession, d: str) -> DataFrame:
    return every_line(spark, d).select("kind", "doc_id", "pos", F.array_join(cd.split_column("line", _automaton()), "|").alias("parts"))


@query("t7_abbreviations", f"""{EVERY} SELECT kind, doc_id, pos, contains(line, 'गा.वि.स.') AS flag FROM every""")
def t7(spark: SparkSession, d: str) -> DataFrame:
    rows, vocab = every_line(spark, d), base_vocab()
    ids = cd.ColumnCodec(rows, vocab).encode("line")
    return rows.select("kind", "doc_id", "pos", F.array_contains(ids, vocab.ids["गा.वि.स."]).alias("flag"))


@query("t9_bytes_round_trip", "SELECT doc_id, strlen(text)::BIGINT AS n, true AS same FROM documents WHERE text IS NOT NULL")
def t9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("b"))
    rows = rows.select("doc_id", "b", cd.encode_bytes("b").alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n"), (cd.decode_bytes("ids") == F.col("b")).alias("same"))


@query("t10_pieces")
def t10(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return lines.select("doc_id", "pos", cd.ColumnCodec(lines, trained(spark, d)).pieces("line").alias("pieces"))


_LETTERS = f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines), w AS (SELECT word, count(*) AS n FROM words WHERE regexp_matches(word, '^[A-Za-z]+$') GROUP BY word)"


@query("d11_word_types", f"{_LETTERS} SELECT word, n AS cnt FROM w WHERE n >= 2")
def d11(spark: SparkSession, d: str) -> DataFrame:
    # Over Latin words the base vocabulary spells letters, so the types read back as words.
    lines = lines_of(spark, d)
    vocab = base_vocab()
    types = tr.word_types(lines, vocab, least=2)
    codec = cd.ColumnCodec(lines, vocab)
    return types.select(codec.decode("tokens").alias("word"), "cnt").filter(F.col("word").rlike("^[A-Za-z]+$"))


@query("t12_pair_counts", f"""{_LETTERS}, m AS (SELECT string_split('▂' || word, '') AS cs, n FROM w), p AS (SELECT unnest(list_transform(range(1, len(cs)), lambda i: cs[i] || cs[i + 1])) AS pair, n FROM m)
SELECT pair, sum(n)::BIGINT AS freq FROM p GROUP BY pair""")
def t12(spark: SparkSession, d: str) -> DataFrame:
    words = metrics.word_counts(lines_of(spark, d)).filter(F.col("word").rlike("^[A-Za-z]+$"))
    vocab = base_vocab()
    types = words.select(cd.ColumnCodec(words, vocab).encode("word").alias("tokens"), F.col("n").alias("cnt"))
    surface = F.create_map(*[F.lit(x) for s, i in vocab.ids.items() if len(s) == 1 and (s.isascii() or s == "▂") for x in (i, s)])
    return tr.pair_counts(types).select(F.concat(surface[F.col("a")], surface[F.col("b")]).alias("pair"), "freq")


@query("t13_t20_trained_vocabulary")
def t16(spark: SparkSession, d: str) -> DataFrame:
    return trained(spark, d).table(spark).select("id", "surface", "script", "kind")


def _found(vocab: vb.Vocab, spark: SparkSession) -> DataFrame:
    return vocab.table(spark).select("id", "surface", "script", "kind")


@query("t17_trained_from_lines")
def t17(spark: SparkSession, d: str) -> DataFrame:
    vocab = base_vocab()
    return _found(tr.train(every_line(spark, d), vocab, len(vocab) + 40, theta=2, least=2, normalizer=vb.Normalizer(FOLDS)), spark)


@query("t18_trained_from_texts")
def t18(spark: SparkSession, d: str) -> DataFrame:
    vocab = base_vocab()
    return _found(tr.train_texts(fixture(spark), vocab, len(vocab) + 20, theta=2, normalizer=vb.Normalizer(FOLDS), column="line"), spark)


@query("t20_latin_retrained")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return _found(tr.train_latin(lines_of(spark, d), base_vocab(), 200, least=2), spark)


@query("t27_unconstrained")
def t27(spark: SparkSession, d: str) -> DataFrame:
    vocab = base_vocab()
    return _found(tr.train(lines_of(spark, d), vocab, len(vocab) + 200, least=2, free=True), spark)


@query("t21_loaded_vocabulary")
def t21(spark: SparkSession, d: str) -> DataFrame:
    return vb.Vocab.load(enumerate(base_vocab().surfaces)).table(spark).select("id", "surface", "script", "kind")


@query("t22_paradigm_edges", "SELECT * FROM (VALUES (1, 'जा', 'नु'), (1, 'जा', 'यो'), (1, 'जानु', 'हो'), (2, 'ग', 'र्नु')) t(root_id, prefix, continuation)")
def t22(spark: SparkSession, d: str) -> DataFrame:
    p = vb.Paradigms()
    p.add(1, {"जा": ["नु", "यो"], "जानु": ["हो"]})
    p.add(2, {"ग": ["र्नु"]})
    return p.edges(spark)


@query("t24_d12_appended_surfaces", "SELECT i::INT AS id, s AS surface FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) t(i, s)")
def t24(spark: SparkSession, d: str) -> DataFrame:
    old = spark.createDataFrame([(0, "a"), (1, "b")], "id int, surface string")
    return vb.append_surfaces(old, spark.createDataFrame([(0, "b"), (1, "c"), (2, "d"), (3, "c")], "pos int, surface string"))


@query("t25_framed", "SELECT doc_id, array_to_string([101] || [doc_id] || [102], ' ') AS framed, '1 0 1' AS mask, '0 0 0' AS types, array_to_string([doc_id, 0, 0, 0], ' ') AS padded FROM documents")
def t25(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.array(F.col("doc_id").cast("int")).alias("ids"))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return rows.select("doc_id", text(cd.framed("ids", 101, 102)).alias("framed"), text(cd.special_mask("ids")).alias("mask"), text(cd.type_ids("ids")).alias("types"), text(cd.padded("ids", 4, 0)).alias("padded"))


@query("t26_script_ids", "SELECT '0 1 2 3 4' AS ids")
def t26(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(["DEV", "LAT", "PUN", "FMT", "MAL"],)], "scripts array<string>")
    return rows.select(F.array_join(cd.script_ids("scripts").cast("array<string>"), " ").alias("ids"))


# --- statistics over tokens: the base vocabulary spells these texts letter by letter, and other letters by their bytes ------


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return lines.select("doc_id", "pos", "line", cd.ColumnCodec(lines, base_vocab()).encode("line").alias("ids"))


def _tokens(c: str) -> str:
    """SQL of the tokens of a text without Devanagari: a mark, and its bytes in normal form, the seed 2020 being one."""
    return f"strlen(nfc_normalize({c})) + 1 - 3 * (len(string_split({c}, '2020')) - 1)"


_SPELLED = f"{LINES}, e AS (SELECT doc_id, pos, line, {_tokens('line')} AS t, len(regexp_extract_all(line, '[^\\s]+')) AS w FROM lines)"


@query("a4_fertility_by_line", f"""{_SPELLED}, k AS (SELECT CASE WHEN regexp_matches(line, '[A-Za-z0-9]') THEN 'latin_or_digit' ELSE 'native_only' END AS kind, t, w FROM e), g AS (SELECT coalesce(kind, 'ALL') AS kind, count(*) AS lines, sum(w)::BIGINT AS words, sum(t)::BIGINT AS tokens FROM k GROUP BY ROLLUP (kind))
SELECT kind, lines, words, tokens, round(tokens::DOUBLE / greatest(words, 1), 6) AS fertility, round(100.0::DOUBLE * lines / (SELECT max(lines) FROM g), 6) AS pct FROM g""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.fertility_by_line(_spelled(spark, d))
    return out.select("kind", "lines", "words", "tokens", F.round("fertility", 6).alias("fertility"), F.round("pct", 6).alias("pct"))


_WC = "CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(word, '[0-9]') THEN 'digit' ELSE 'other' END"


def _spelled_words(spark: SparkSession, d: str) -> DataFrame:
    words = metrics.word_counts(lines_of(spark, d))
    return words.withColumn("ids", cd.ColumnCodec(words, base_vocab()).encode("word"))


_SPELLED_WORDS = f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines), w AS (SELECT word, count(*) AS n, {_tokens('word')} AS t FROM words GROUP BY word)"


@query("a5_fertility_by_word_class", f"{_SPELLED_WORDS} SELECT {_WC} AS word_class, sum(n)::BIGINT AS words, sum(n * t)::BIGINT AS tokens, round(sum(n * t)::DOUBLE / sum(n), 6) AS fertility FROM w GROUP BY 1")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fertility_by_word_class(_spelled_words(spark, d)).withColumn("fertility", F.round("fertility", 6))


@query("a6_verdict", f"{LINES}, l AS (SELECT doc_id, sum(length(line)) / greatest(sum(len(regexp_extract_all(line, '[^\\s]+'))), 1) AS f FROM lines GROUP BY doc_id) SELECT doc_id, CASE WHEN f - 6 > 0.15 THEN 'script_coverage' ELSE 'balanced' END AS verdict FROM l")
def a6(spark: SparkSession, d: str) -> DataFrame:
    # Characters stand for tokens, and six of them a word for the native text.
    own = lines_of(spark, d).groupBy("doc_id").agg((F.sum(F.char_length("line")) / F.greatest(F.sum(tx.n_words("line")), F.lit(1))).alias("f"))
    return own.select("doc_id", metrics.verdict(F.lit(6.0), F.col("f")).alias("verdict"))


@query("a7_worst_words", f"{_SPELLED_WORDS} SELECT word, t::BIGINT AS tokens, n FROM w WHERE t >= 5 ORDER BY n DESC, word LIMIT 15")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return metrics.worst_words(_spelled_words(spark, d)).withColumn("tokens", F.col("tokens").cast("bigint"))


@query("a8_sample_summary", f"{_SPELLED} SELECT count(*) AS rows, round(avg(t::DOUBLE / greatest(w, 1)), 6) AS mean_ratio, round(median(t::DOUBLE / greatest(w, 1)), 6) AS median_ratio, round(sum(t)::DOUBLE / greatest(sum(w), 1), 6) AS micro_ratio FROM e")
def a8(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.sample_summary(_spelled(spark, d))
    return out.select("rows", *[F.round(c, 6).alias(c) for c in ("mean_ratio", "median_ratio", "micro_ratio")])


@query("a9_a11_benchmark_row", f"{_SPELLED} SELECT 'base' AS tokenizer, sum(t)::BIGINT AS total_tokens, 0.0::DOUBLE AS unk_pct, round(sum(t)::DOUBLE / greatest(sum(w), 1), 6) AS tokens_per_word, round(sum(length(line))::DOUBLE / sum(t), 6) AS chars_per_token, round(sum(strlen(line))::DOUBLE / sum(t), 6) AS bytes_per_token, round(sum(length(line))::DOUBLE / sum(t) / 8 * 100, 6) AS efficiency FROM e")
def a11(spark: SparkSession, d: str) -> DataFrame:
    rows = _spelled(spark, d).withColumn("tokenizer", F.lit("base"))
    out = metrics.benchmark_rows(rows)
    return out.select("tokenizer", "total_tokens", *[F.round(c, 6).alias(c) for c in ("unk_pct", "tokens_per_word", "chars_per_token", "bytes_per_token", "efficiency")])


@query("a10_validation_summary", f"{_SPELLED} SELECT round(sum(t)::DOUBLE / greatest(sum(w), 1), 6) AS fertility, 0.0::DOUBLE AS unk_rate, sum(CASE WHEN trim(nfc_normalize(line)) <> trim(line) THEN 1 ELSE 0 END)::BIGINT AS round_trip_failures FROM e")
def a10(spark: SparkSession, d: str) -> DataFrame:
    rows = _spelled(spark, d)
    rows = rows.withColumn("decoded", cd.ColumnCodec(rows, base_vocab()).decode("ids"))
    out = metrics.validation_summary(rows, "line", "ids", "decoded")
    return out.select(F.round("fertility", 6).alias("fertility"), F.round("unk_rate", 6).alias("unk_rate"), "round_trip_failures")


@query("a12_character_coverage", "SELECT 128::BIGINT AS covered, 1.0::DOUBLE AS coverage")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return metrics.character_coverage(base_vocab().table(spark))


_PAIRS = "(VALUES ('खान', 'खाने'), ('जान', 'जाने'), ('गर्नु', 'गर्ने'), ('लेख', 'लेख्नु'), ('पढ', 'पढाइ')) AS t(a, b)"


@query("a13_shared_tokens")
def a13(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT a, b FROM {_PAIRS}")
    codec = cd.ColumnCodec(rows, base_vocab())
    return metrics.shared_tokens(rows.select(codec.encode("a").alias("ids_a"), codec.encode("b").alias("ids_b")))


@query("a14_continuation_rate")
def a14(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d)
    return metrics.continuation_rate(lines.select(cd.ColumnCodec(lines, base_vocab()).pieces("line").alias("pieces")))


#: Every word cut into threes as pieces and into twos as the gold standard, and the inner boundaries of both.
_CUTS = f"{LINES}, words AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[!-~]+')) AS word FROM lines), b AS (SELECT word, (length(word) - 1) // 3 AS a, (length(word) - 1) // 2 AS g, (length(word) - 1) // 6 AS hit FROM words), s AS (SELECT word, a, g, hit / greatest(a, 1) AS p, hit / greatest(g, 1) AS r FROM b)"
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    words = lines_of(spark, d).select(F.explode(F.regexp_extract_all("line", F.lit("[!-~]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.regexp_extract_all("word", F.lit(".{1,3}"), F.lit(0)).alias("pieces"), F.regexp_extract_all("word", F.lit(".{1,2}"), F.lit(0)).alias("morphs"))


@query("a15_boundary_scores", f"{_CUTS} SELECT round(avg(p), 6) AS p, round(avg(r), 6) AS r, round(avg({_F1}), 6) AS f1 FROM s")
def a15(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.macro_boundary_scores(_cuts(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query("a16_boundary_scores_empty", f"{_CUTS} SELECT word, round(CASE WHEN a = 0 AND g = 0 THEN 1.0::DOUBLE ELSE {_F1} END, 6) AS f1 FROM s")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).select("word", F.round(metrics.boundary_scores("pieces", "morphs", 1.0)["f1"], 6).alias("f1"))


@query("a17_bits_per_character", "SELECT doc_id, round(8.0::DOUBLE * strlen(text) / greatest(length(text), 1), 6) AS bpc FROM documents WHERE text IS NOT NULL")
def a17(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.round(metrics.bits_per_character(F.lit(8.0) * F.octet_length("text"), F.char_length("text")), 6).alias("bpc"))


@query("a25_character_set", f"{EVERY} SELECT c, count(*) AS surfaces FROM (SELECT DISTINCT word, unnest(string_split(word, '')) AS c FROM (SELECT DISTINCT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM every)) WHERE c <> '' GROUP BY c")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return metrics.character_set(metrics.word_counts(every_line(spark, d)).withColumnRenamed("word", "surface"))


@query("a25_native_share", "SELECT round(35.0::DOUBLE / 100, 6) AS native_share")
def a25_share(spark: SparkSession, d: str) -> DataFrame:
    return metrics.native_share(base_vocab().table(spark)).select(F.round("native_share", 6).alias("native_share"))


@query("a26_characters_per_token", f"{_SPELLED} SELECT doc_id, pos, round(length(line)::DOUBLE / t, 6) AS ratio FROM e")
def a26(spark: SparkSession, d: str) -> DataFrame:
    rows = _spelled(spark, d)
    return rows.select("doc_id", "pos", F.round(metrics.characters_per_token("line", "ids"), 6).alias("ratio"))


@query("f16_latin_words_before_encoding", f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines) SELECT count(*) AS words, count(DISTINCT word) AS types FROM words WHERE regexp_matches(word, '[A-Za-z0-9]')")
def f16(spark: SparkSession, d: str) -> DataFrame:
    words = metrics.word_counts(lines_of(spark, d)).filter(fl.latin_bearing("word"))
    return words.agg(F.sum("n").alias("words"), F.count("*").alias("types"))


@query("n1_n3_normal_forms", f"""{EVERY}, s AS (SELECT kind, doc_id, pos, nfc_normalize(line || ' सङ्ग सँग स' || chr(8205) || 'ंग e' || chr(769)) AS n FROM every)
SELECT kind, doc_id, pos, replace(replace(replace(n, 'सङ्ग', 'संग'), 'सँग', 'संग'), chr(8205), '') AS production, replace(replace(replace(n, 'सङ्ग', 'सँग'), 'संग', 'सँग'), chr(8205), '') AS prototype,
replace(replace(n, 'ख', 'क'), chr(8205), '') AS mapped FROM s""")
def n1(spark: SparkSession, d: str) -> DataFrame:
    rows = every_line(spark, d).withColumn("s", F.concat("line", F.lit(" सङ्ग सँग स\u200dंग e\u0301")))
    codec = cd.ColumnCodec(rows, base_vocab(), vb.Normalizer(FOLDS))
    return rows.select("kind", "doc_id", "pos", codec.normalize("s").alias("production"), tx.fold_prototype("s").alias("prototype"), tx.fold_characters("s", {"ख": "क"}).alias("mapped"))


@query("t4_akshara_split", f"""{EVERY} SELECT kind, doc_id, pos, array_to_string(regexp_extract_all(line, '(?s){_AKSHARA_SQL}'), '|') AS aksharas FROM every""")
def t4(spark: SparkSession, d: str) -> DataFrame:
    return every_line(spark, d).select("kind", "doc_id", "pos", vb.aksharas_joined("line", "|").alias("aksharas"))
