"""Queries of corpus engineering: sources, cleaning, filters, dedup, samples and line statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import filters as fl
from loomtext.functions import html, text as tx
from loomtext.operators import dedup, metrics, neardup, sampling
from loomtext.plans.registry import EVERY, FIXTURE, LINES, every_line, fixture, lines_of, query, table
from loomtext.sources import readers, sinks

# --- sources and sinks ------------------------------------------------------------------------------


@query("s1_line_scan", f"{LINES} SELECT count(*) AS lines, sum(length(line))::BIGINT AS chars, sum(CASE WHEN line = '' THEN 1 ELSE 0 END)::BIGINT AS blank FROM lines")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.count_if(F.col("line") == "").alias("blank"))


@query(
    "s2_blank_line_documents",
    """SELECT doc_id, (unnest(range(0, len(ps))))::BIGINT AS pos, unnest(ps) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || chr(10)), chr(10) || chr(10) || '+'),
      lambda x: trim(x, chr(10))), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL)""",
)
def s2(spark: SparkSession, d: str) -> DataFrame:
    # Sentences are parted by empty lines first, so that there are documents to find.
    own = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return readers.split_documents(own, key="doc_id").withColumn("pos", F.col("pos").cast("bigint"))


@query("s8_filled_texts", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE regexp_matches(text, '[^\\s]')")
def s8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(fl.not_blank("text")).select("doc_id", F.char_length("text").cast("bigint").alias("chars"))


@query("s12_null_as_empty", "SELECT coalesce(text, '') AS text FROM conversations")
def s12(spark: SparkSession, d: str) -> DataFrame:
    return readers.table_texts(table(spark, d, "conversations"), "text")


@query("s13_titled_articles", "SELECT '=== ' || source || ' ===' || chr(10) || text || chr(10) || chr(10) AS article FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def s13(spark: SparkSession, d: str) -> DataFrame:
    return readers.titled(table(spark, d, "documents").filter("text is not null and source is not null"), "source")


@query("s14_words_within", "SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[^\\s]+')) BETWEEN 3 AND 512")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(fl.words_between("text")).select("doc_id")


@query("s18_gold_segmentation", "SELECT 'जानु' AS word, 'जा+नु' AS morphs, 2::BIGINT AS n UNION ALL SELECT 'घरहरू', 'घर+हरू', 2")
def s18(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("जानु\tजा+नु",), ("no tab",), ("घरहरू\tघर+हरू",)], "value string")
    cut = F.split("value", "\t")
    rows = rows.filter(F.col("value").contains("\t")).select(tx.strip(cut[0]).alias("word"), F.split(tx.strip(cut[1]), r"\+").alias("m"))
    return rows.select("word", F.array_join("m", "+").alias("morphs"), F.size("m").cast("bigint").alias("n"))


@query("k9_faq_report", "SELECT role AS category, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn)::BIGINT AS n, conv_id, turn FROM conversations")
def k9(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("role").alias("category"), F.col("text").alias("question"), F.col("text").alias("answer"), "conv_id", "turn", F.struct("conv_id", "turn").alias("pos"))
    from pyspark.sql import Window

    return rows.select("category", F.row_number().over(Window.partitionBy("category").orderBy("pos")).cast("bigint").alias("n"), "conv_id", "turn")


@query("k7_question_lines", "SELECT a.text || chr(10) || b.text AS text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def k7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    asked = rows.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    told = rows.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return sinks.question_lines(asked.join(told, ["conv_id", "turn"]).filter("question is not null and answer is not null"))


# --- cleaning -----------------------------------------------------------------------------------------

_ASCII = "documents WHERE text IS NOT NULL"


@query("n4_clean_native", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[^A-Za-z0-9\\x{0900}-\\x{097F}\\s.,:;?!()\\[\\]{}/\\\\"''\\-]+', ' ', 'g'), ' +', ' ', 'g'), '\\n+', chr(10), 'g'), '\\t+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents""")
def n4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_devanagari("text").alias("text"))


@query("n5_clean_english")
def n5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_english("text").alias("text"))


@query("n6_clean_for_vocabulary", """SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[^A-Za-z0-9\\x{0900}-\\x{097F}\\s.,:;?!()\\[\\]{}/\\\\"''\\-@#$%&+=<>|\\x{20B9}]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents""")
def n6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_for_vocabulary("text").alias("text"))


@query("n7_clean_chat")
def n7(spark: SparkSession, d: str) -> DataFrame:
    rows = every_line(spark, d)
    return fl.cleaned_chat(rows.filter(~fl.has_keyword("line")))


@query("n15_without_fences", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE NOT regexp_matches(coalesce(text, ''), '(^|\\n)\\s*```')")
def n15(spark: SparkSession, d: str) -> DataFrame:
    # Each text is put between fences first, so that there are some to drop.
    rows = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit(""))).filter(~F.col("text").rlike(r"(^|\n)\s*```"))
    return rows.select("conv_id", "turn", tx.without_fences(F.concat(F.lit("```json\n"), "text", F.lit("\n ``` \n```"))).alias("text"))


@query("n8_without_urls", "SELECT page_id, trim(regexp_replace(html, 'https?://[^\\s]+|www\\.[^\\s]+', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages")
def n8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.without_urls("html").alias("text"))


@query(
    "n9_without_links",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '!?\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]\\[[^\\]]*\\]', '', 'g'), '\\[[^\\]]*\\]:\\s*[^\\s]+', '', 'g'), '<[^>]+>', '', 'g'), 'https?://[^\\s]+|www\\.[^\\s]+', '', 'g'),
    '\\(\\s*\\)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM pages""",
)
def n9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.without_links("html").alias("text"))


@query("n10_markdown_text")
def n10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("text is not null").select("conv_id", "turn", html.markdown_text_column("text").alias("text"))


@query("n11_html_text")
def n11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.html_text_column("html").alias("text"))


@query("n12_flatten", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def n12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.flatten("text").alias("text"))


_REPLIES = "(VALUES (1, 'x [1, [2]] y'), (2, 'say {\"a\": 1}'), (3, 'none'), (4, '[{\"output\": \"b\"}]')) AS t(i, reply)"


@query("n13_n14_json_of_replies", f"SELECT i::BIGINT AS i, nullif(regexp_extract(reply, '(?s)\\[.*\\]'), '') AS arr, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}$'), '') AS obj FROM {_REPLIES}")
def n13(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT cast(i AS bigint) AS i, reply FROM {_REPLIES}")
    return rows.select("i", tx.json_array("reply").alias("arr"), tx.json_object("reply").alias("obj"))


@query("n16_escape_round_trip", "SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n') AS escaped, true AS same FROM documents")
def n16(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", tx.escape_tsv("text").alias("escaped"))
    return rows.select("doc_id", "escaped", (tx.unescape_tsv("escaped") == F.col("text")).alias("same"))


@query("n17_lower_case", "SELECT doc_id, lower(text) AS text FROM documents")
def n17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


@query("n18_first_number", "SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT), 0) AS n FROM documents")
def n18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.first_number("text").alias("n"))


@query("n19_without_native", f"{EVERY} SELECT kind, doc_id, pos, coalesce(nullif(trim(regexp_replace(line, '[\\x{{0900}}-\\x{{097F}}]+', '', 'g')), ''), line) AS line FROM every")
def n19(spark: SparkSession, d: str) -> DataFrame:
    return every_line(spark, d).select("kind", "doc_id", "pos", tx.without_devanagari("line").alias("line"))


@query("n20_language_tag", "SELECT doc_id, '__LANG_' || upper(lang) || '__' || chr(10) || text AS text FROM documents WHERE lang = 'en'")
def n20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'en'").select("doc_id", tx.tagged("text", "en").alias("text"))


@query("n21_human_size", "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN printf('%.1f B', strlen(text)::DOUBLE) WHEN strlen(text) < 1048576 THEN printf('%.1f KB', strlen(text) / 1024.0::DOUBLE) WHEN strlen(text) < 1073741824 THEN printf('%.1f MB', strlen(text) / 1048576.0::DOUBLE) ELSE printf('%.1f GB', strlen(text) / 1073741824.0::DOUBLE) END AS size FROM documents WHERE text IS NOT NULL")
def n21(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.human_size(F.octet_length("text")).alias("size"))


# --- filters --------------------------------------------------------------------------------------------

_DEV = "[\\x{0900}-\\x{097F}]"


def _count(c: str, cls: str) -> str:
    return f"len(regexp_extract_all({c}, '{cls}'))"


@query("f1_english_dominant", f"{LINES} SELECT doc_id, pos, line FROM lines WHERE {_count('line', '[A-Za-z]')} >= 3 AND {_count('line', '[A-Za-z]')} >= {_count('line', _DEV)}")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).filter(fl.english_dominant("line"))


@query("f2_min_length", f"{LINES} SELECT doc_id, pos FROM lines WHERE length(trim(line)) >= 5")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).filter(fl.at_least("line", 5)).select("doc_id", "pos")


def _flag(name: str, predicate, sql: str | None) -> None:
    """A filter over lines of every kind: each with whether it matches."""

    @query(name, f"{EVERY} SELECT kind, doc_id, pos, ({sql}) AS flag FROM every")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return every_line(spark, d).select("kind", "doc_id", "pos", predicate("line").alias("flag"))


def _found(pattern: str) -> str:
    return f"regexp_matches(line, '(?i){pattern}')"


_ASCII_SHARE = "length(regexp_replace(line, '[^\\x00-\\x7f]+', '', 'g')) / greatest(length(line), 1)"
_SPLIT = "regexp_extract_all(line, '[^\\s]+')"
_flag(
    "f3_noise_line",
    fl.noise_line,
    f"""length(trim(line)) < 3 OR regexp_matches(line, '(?i)torrent|download|dubbed|bluray|x264|1080p|720p') OR len(string_split(line, '&amp;')) > 4 OR len(string_split(line, '&lt;')) > 4
    OR {_count('line', _DEV)} = 0 OR {_count('line', _DEV)} < 0.2 * length(replace(trim(line), ' ', '')) OR length(regexp_replace(trim(line), '[\\pL\\pN\\s]+', '', 'g')) > 0.8 * length(trim(line))""",
)
_flag("f4_garbled_native", fl.garbled_devanagari, f"{_count('line', _DEV)} >= 6 AND {_count('line', '[\\x{0902}\\x{0903}\\x{093E}-\\x{094C}]')} < 0.10 * {_count('line', _DEV)}")
_flag(
    "f5_garbled_romanised",
    fl.garbled_romanised,
    f"""{_ASCII_SHARE} >= 0.6 AND len({_SPLIT}) >= 3 AND len(list_filter(list_transform({_SPLIT}, lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')),
    lambda w: length(w) >= 4 AND length(regexp_replace(w, '[^aeiouAEIOU]', '', 'g')) / length(w) < 0.25)) / greatest(len({_SPLIT}), 1) > 0.25""",
)
_flag("f6_mixed_in_word", fl.mixed_in_word, f"regexp_matches(line, '[A-Za-z]{_DEV}|{_DEV}[A-Za-z]')")
_flag("f7_filler", fl.filler, _found(r"^good\s*(morning|evening|night|afternoon)|^(jay|jai|jy)\s+nepal|^me\s+(the\s+)?regular|^i\s+am\s+(watching|listening)|^(hello|hi|hey|hlo|hii)\b|^(lol|haha|hehe|wow|nice|great|cool|ok|okay)\b|^(nepal\s+)?zindabad|jay\s+nepal\s*$|^jy\s+\w"))
_flag(
    "f8_listener",
    fl.listener,
    _found(r"\b(sunxu|herxu|herne|sunchhu)\b.*\b(bata|jilla)\b|\bbata\b.*\b(herxu|sunxu)\b|\b(herxu|sunxu)\b.*\bregular\b|\bdainik\s+herne\b|\bregular\s+(listener|viewer|sunxu|herxu)\b|\bma\s+dainik\b|\bwatching\s+(from|live)\b")
    + " OR " + _found(r"बाट\s*दैनिक\s*हेर्ने|नगरपालिका.*दैनिक|bata\s+dainik|(^|[^\pL\pN_])रेगुलर($|[^\pL\pN_])|न\s*पा\s+बाट\s+रेगुलर|\bpa\s+bata\s+regular\b"),
)
_flag("f9_reaction", fl.reaction, _found(r"^(hoho|haha|lol|wow|finally)\b|\bjel\s+(kochnu|haal|halnu)\b|^sabai\s+\w+\s+(lai\s+)?jel\b|^\w+\s+le\s+thik\s+bhan|^\w{1,15}\s+sir\s+please\b|kunai\s+pani\s+parti\s+ko.*baputi"))
_flag("f10_vague_english", fl.vague_english, _found(r"^if\s+\w+\s+(come|win|lose|get|become)|^if\s+u\s+|^just\s+look\s+(at|in|what)|^(see|look|watch)\s+what\s+happen|baputi\s+banera\s+basdainan"))
_flag("f11_devotional", fl.devotional, _found(r"\b(radhe\s+radhe|om\s+shanti|jay\s+shree\s+ram|jay\s+shri\s+ram|sadh\s+guru|hari\s+om|om\s+namah|bhagwan\s+jay|jay\s+mata|jai\s+shree)\b"))
_flag("f12_rhetorical", fl.rhetorical, f"ends_with(trim(line), '?') AND len({_SPLIT}) <= CASE WHEN {_count('line', _DEV)} > 5 THEN 10 ELSE 8 END")
_flag("f13_low_content", fl.low_content, _found(r"जे मन लाग्यो|तेही भन्न लाग्यो|सुभकामना.*अनुरोध|अनैतिक काम.*अनुरोध|^kina\s+aadha\b|^kina\s+\w+\s+matra\b|charmari\s+la\s+garda|vaster\s+vaiko|^samachar\s+ko\s+kura\s+matra\s+gar|doctor\s+hoinau\s+bujheu|बुढो\s+मान्छेको\s+पुरानै\s+सोच|\bchintai\s+chinta\b|\bbisram\s+linu\s+hosh\b|प्वाँख\s+पलाएको|अचम्म\s+लाग्छ|बिरालोले\s+मुसा\s+मर्दैन|धेरै\s+मन्त्री\s+काम\s+छैन|बालेन\s+(लाई\s+)?नै\s+(प्राधान|प्रधान)\s+मन्त्री\s+दिनु\s+पर्छ|आधा\s+आधा\s+कार्यकाल|बालेन\s+नै\s+हुनुपर्छ|५\s*वर्षसम्म\s+बालेन"))
_flag("f13_off_topic_english", fl.off_topic_english, f"{_ASCII_SHARE} >= 0.70 AND NOT " + _found(r"\b(nepal|nepali|balen|rabi|sarkar|sarkaar|congress|kangres|kangren|kangresh|amale|uml|maoist|mawobadi|maobadi|communist|government|minister|vote|election|rastriya|sambidhan|prachanda|deuba|oli|koirala|madhes|janajati|province|pradesh|kathmandu|pokhara|rsp|ncp|girija|sushila|karki|bikalpa|desh|janta|janata|bikas)\b"))
_flag("f14_keyword", fl.has_keyword, _found("instagram|facebook|twitter|tiktok|snapchat|telegram|discord|whatsapp|onlyfans|patreon|ko-fi|buff"))
_flag("f16_latin_bearing", fl.latin_bearing, "regexp_matches(line, '[A-Za-z0-9]')")
_flag("f17_not_blank", fl.not_blank, "trim(line) <> ''")
_flag("f18_latin_surface", fl.latin_surface, "regexp_matches(line, '^[A-Za-z0-9]+$')")
_flag("f22_well_formed", fl.well_formed, "NOT regexp_matches(line, '\\x{094D}[^\\x{0915}-\\x{0939}]')")


@query("f15_words_between", f"{LINES} SELECT doc_id, pos FROM lines WHERE len(regexp_extract_all(line, '[^\\s]+')) BETWEEN 3 AND 512")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(spark, d).filter(fl.words_between("line")).select("doc_id", "pos")


_CLASS = f"CASE WHEN regexp_matches(word, '[A-Za-z]') THEN 'latin' WHEN regexp_matches(word, '[0-9]') THEN 'digit' WHEN regexp_matches(word, '[\\x{{0966}}-\\x{{096F}}]') THEN 'dev_digit' WHEN regexp_matches(word, '{_DEV}') THEN 'devanagari' ELSE 'other' END"


@query("f19_word_class_counts", f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines UNION ALL SELECT unnest(regexp_extract_all(line, '[^\\s]+')) FROM {FIXTURE}) SELECT {_CLASS} AS word_class, count(*) AS n FROM words GROUP BY 1")
def f19(spark: SparkSession, d: str) -> DataFrame:
    lines = lines_of(spark, d).select("line").unionAll(fixture(spark).select("line"))
    return metrics.word_counts(lines).groupBy(fl.word_class("word").alias("word_class")).agg(F.sum("n").alias("n"))


_LANG = f"CASE WHEN regexp_matches(line, '[A-Za-z]') AND regexp_matches(line, '{_DEV}') THEN 'mixed' WHEN regexp_matches(line, '[A-Za-z]') THEN 'eng' WHEN regexp_matches(line, '{_DEV}') THEN 'nep' ELSE 'none' END"


@query("f20_line_language", f"{EVERY} SELECT kind, doc_id, pos, {_LANG} AS lang FROM every")
def f20(spark: SparkSession, d: str) -> DataFrame:
    return every_line(spark, d).select("kind", "doc_id", "pos", fl.line_language("line").alias("lang"))


@query("f23_english_words", f"{EVERY}, words AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM every) SELECT word, (regexp_matches(word, '^https?://|^www\\.|\\.(com|edu|net|org)$') OR contains(word, '@') OR (regexp_matches(word, '^[!-~]+$') AND NOT contains(word, '!'))) AS flag FROM words")
def f23(spark: SparkSession, d: str) -> DataFrame:
    return metrics.word_counts(every_line(spark, d)).select("word", fl.english_word("word").alias("flag"))


# --- dedup ------------------------------------------------------------------------------------------------

_FIRST = "row_number() OVER (PARTITION BY {} ORDER BY {})"


@query(
    "line_dedup_stats",
    f"{LINES}, s AS (SELECT count(*) AS total, count(DISTINCT CASE WHEN line <> '' THEN line END) AS kept FROM lines) SELECT total, kept, total - kept AS duplicates, round(100.0::DOUBLE * (total - kept) / greatest(total, 1), 6) AS dup_pct FROM s",
)
def line_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.line_statistics(lines_of(spark, d)).withColumn("dup_pct", F.round("dup_pct", 6))


@query("d1_line_keep_first", f"{LINES} SELECT doc_id, pos, line FROM (SELECT *, {_FIRST.format('line', 'doc_id, pos')} AS r FROM lines) WHERE r = 1 OR line = ''")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_lines(lines_of(spark, d), ("doc_id", "pos"))


@query("d2_document_keep_first", f"SELECT doc_id FROM (SELECT *, {_FIRST.format('text', 'doc_id')} AS r FROM documents) WHERE r = 1")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


@query("d3_near_dup_keep")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_dup(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query("d3_full_clean")
def d3_full(spark: SparkSession, d: str) -> DataFrame:
    return neardup.full(lines_of(spark, d), ("doc_id", "pos")).select("doc_id", "pos")


@query("d3_shingle_counts", """WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws, replace(text, ' ', '') AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
  ELSE list_transform(range(1, greatest(length(j) - 4, 1) + 1), lambda i: substr(j, i, 5)) END))::BIGINT AS n FROM w""")
def d3_shingles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(neardup.shingles("text")).cast("bigint").alias("n"))


@query("d4_stripped_lines", f"{LINES} SELECT doc_id, pos, s AS line FROM (SELECT *, {_FIRST.format('s', 'doc_id, pos')} AS r FROM (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS s FROM lines) WHERE length(s) >= 5) WHERE r = 1")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return dedup.stripped_lines(lines_of(spark, d), ("doc_id", "pos"))


@query("d5_distinct_files", f"SELECT page_id AS path FROM (SELECT *, {_FIRST.format('html', 'page_id')} AS r FROM pages WHERE strlen(html) > 0) WHERE r = 1")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return dedup.distinct_files(table(spark, d, "pages").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))).select("path")


@query("d6_articles", f"SELECT doc_id FROM (SELECT *, {_FIRST.format('s', 'doc_id')} AS r FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM documents) WHERE s <> '') WHERE r = 1")
def d6(spark: SparkSession, d: str) -> DataFrame:
    return dedup.articles(table(spark, d, "documents").select("doc_id", "text")).select("doc_id")


@query("d7_look_back")
def d7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return neardup.look_back(rows, ["conv_id"], ["turn", "line"])


@query("d8_duplicate_report", """WITH g AS (SELECT text, count(*) AS n, length(text) AS c FROM documents WHERE regexp_matches(text, '[^\\s]') GROUP BY text)
SELECT sum(n)::BIGINT AS total, count(*) AS unique_texts, (sum(n) - count(*))::BIGINT AS duplicates, round((sum(n) - count(*))::DOUBLE / greatest(sum(n), 1), 6) AS dup_rate, sum(n * c)::BIGINT AS chars, sum(c)::BIGINT AS unique_chars FROM g""")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_report(table(spark, d, "documents")).withColumn("dup_rate", F.round("dup_rate", 6))


@query("d9_distinct_pairs", "SELECT DISTINCT lang AS native, source AS english FROM documents WHERE lang <> '' AND source <> '' ORDER BY 1, 2")
def d9(spark: SparkSession, d: str) -> DataFrame:
    return dedup.distinct_pairs(table(spark, d, "documents").select(F.col("lang").alias("native"), F.col("source").alias("english")))


@query("d10_first_contexts", f"SELECT doc_id, context FROM (SELECT *, {_FIRST.format('context', 'doc_id')} AS r FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS context FROM documents) WHERE context <> '') WHERE r = 1 ORDER BY doc_id LIMIT 50")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_contexts(table(spark, d, "documents").select("doc_id", F.col("text").alias("context")), 50, ["doc_id"])


# --- samples, limits, sets ----------------------------------------------------------------------------------


@query("x1_byte_budget")
def x1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text") + 2)).first()[0]
    return sampling.byte_budget(docs, total // 2).select("doc_id", F.octet_length("text").alias("size"))


@query("x1_byte_budget_ample", "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents")
def x1_ample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.byte_budget(table(spark, d, "documents").select("doc_id", "text"), 1 << 60).select("doc_id", F.octet_length("text").cast("bigint").alias("size"))


@query("x2_merged_corpora", "SELECT lang, count(*) AS docs, sum(strlen(text) + 12)::BIGINT AS bytes FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang")
def x2(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    parts = {lang: docs.filter(F.col("lang") == lang).select("doc_id", "text") for lang in ("en", "fr")}
    merged = sampling.merge_corpora(parts, tag=True)
    return merged.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text") - F.lit(len("__LANG_EN__\n")) + 12).alias("bytes"))


@query("x3_first_rows", f"{LINES} SELECT doc_id, pos, line FROM lines WHERE trim(line) <> '' ORDER BY doc_id, pos LIMIT 200")
def x3(spark: SparkSession, d: str) -> DataFrame:
    return sampling.first_rows(lines_of(spark, d), 200, ["doc_id", "pos"])


@query("x4_byte_limit", "SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before FROM documents) WHERE before < 1000000")
def x4(spark: SparkSession, d: str) -> DataFrame:
    return sampling.byte_limit(table(spark, d, "documents").select("doc_id", "text"), 1_000_000, ["doc_id"]).select("doc_id")


@query("x5_rows_between", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 200 OFFSET 200")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rows_between(table(spark, d, "documents").select("doc_id"), ["doc_id"], 200, 400)


@query("x6_longest_words", f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines) SELECT word, length(word)::BIGINT AS length FROM words ORDER BY length(word) DESC, word DESC LIMIT 5")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return sampling.longest_words(lines_of(spark, d)).withColumn("length", F.col("length").cast("bigint"))


@query("x7_most_common", f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word, doc_id, pos FROM lines) SELECT word, count(*) AS n FROM words GROUP BY word ORDER BY n DESC, min(doc_id * 100000 + pos), word LIMIT 10")
def x7(spark: SparkSession, d: str) -> DataFrame:
    words = lines_of(spark, d).select("doc_id", "pos", F.explode(tx.words("line")).alias("word"))
    return sampling.most_common(words, "word", 10, ["doc_id", "pos", "word"])


@query("x8_concat_corpora", "SELECT 0::BIGINT AS source_rank, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id FROM documents WHERE lang <> 'en'")
def x8(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    out = sampling.concat_corpora([docs.filter("lang = 'en'"), docs.filter("lang <> 'en'")], ["doc_id"])
    return out.select(F.col("source_rank").cast("bigint"), "doc_id")


@query("x9_with_block", "SELECT text AS line FROM conversations UNION ALL SELECT 'one' UNION ALL SELECT 'two'")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return sampling.with_block(table(spark, d, "conversations").select(F.col("text").alias("line")), ["one", "two"])


@query("x10_batches", "SELECT (n - 1) // 16 AS batch, count(*) AS rows, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) GROUP BY 1")
def x10(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.batches(table(spark, d, "documents").select("doc_id"), 16, ["doc_id"], "doc_id")
    return out.select("batch", F.size("items").cast("bigint").alias("rows"), F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


@query("x12_question_answer_blocks")
def x12(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.explode(sampling.question_answer_blocks("text")).alias("p"))
    return rows.select("doc_id", "p.question", "p.answer")


# --- statistics of text ----------------------------------------------------------------------------------------

_WORDS = f"{LINES}, words AS (SELECT unnest(regexp_extract_all(line, '[^\\s]+')) AS word FROM lines), counts AS (SELECT word, count(*) AS n FROM words GROUP BY word)"


@query("a2_word_counts", f"{_WORDS} SELECT word, n FROM counts")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.word_counts(lines_of(spark, d))


@query("a3_word_profile", f"{_WORDS} SELECT sum(n)::BIGINT AS total_words, count(*) AS unique_words, max(length(word))::BIGINT AS longest, sum(CASE WHEN length(word) > 200 THEN 1 ELSE 0 END)::BIGINT AS over_long FROM counts")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.word_profile(metrics.word_counts(lines_of(spark, d))).withColumn("longest", F.col("longest").cast("bigint"))


@query("a18_script_profile", EVERY + """ SELECT kind, doc_id, pos, len(regexp_extract_all(line, '[\\x{0900}-\\x{097F}]'))::BIGINT AS dev, len(regexp_extract_all(line, '[A-Za-z]'))::BIGINT AS latin,
len(regexp_extract_all(line, '\\p{Nd}'))::BIGINT AS digit, len(regexp_extract_all(line, '[^\\pL\\pN]'))::BIGINT AS not_alnum FROM every""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    rows = every_line(spark, d).select("kind", "doc_id", "pos", metrics.script_profile("line").alias("s"))
    return rows.select("kind", "doc_id", "pos", *[F.col(f"s.{n}").cast("bigint").alias(n) for n in ("dev", "latin", "digit", "not_alnum")])


@query("a19_language_mix", f"{EVERY}, k AS (SELECT {_LANG} AS k FROM every) SELECT count(*) AS lines, " + ", ".join(f"round(100.0::DOUBLE * sum(CASE WHEN k = '{k}' THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS {k}_pct" for k in ("eng", "nep", "mixed")) + " FROM k")
def a19(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.language_mix(every_line(spark, d))
    return out.select("lines", *[F.round(f"{k}_pct", 6).alias(f"{k}_pct") for k in ("eng", "nep", "mixed")])


@query("a22_combine_statistics", """WITH r AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS b FROM documents), g AS (SELECT b, count(*) AS c, length(b) AS n FROM r WHERE b <> '' GROUP BY b)
SELECT (SELECT count(*) FROM g) AS unique_texts, (SELECT sum(c) - count(*) FROM g)::BIGINT AS duplicates, (SELECT round(avg(n), 6) FROM g) AS avg_chars,
(SELECT 38756 - count(DISTINCT doc_id) FROM documents) AS missing, (SELECT count(*) FROM r WHERE b = '') AS blank""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return metrics.combine_statistics(table(spark, d, "documents"), 38_756).withColumn("avg_chars", F.round("avg_chars", 6))


@query("a23_clean_statistics", f"{LINES}, c AS (SELECT line, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS f FROM lines) SELECT sum(length(line))::BIGINT AS chars_before, sum(length(f))::BIGINT AS chars_after, sum(CASE WHEN f <> '' THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN f = '' THEN 1 ELSE 0 END)::BIGINT AS removed FROM c")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clean_statistics(lines_of(spark, d).select("line", tx.flatten("line").alias("flat")), "line", "flat")
