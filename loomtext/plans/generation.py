"""Queries of transliteration, of question-answer data and of its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import html
from loomtext.operators import qa, translit
from loomtext.plans.registry import EVERY, FIXTURE, every_line, fixture, lines_of, query, table

_GOLD = "(VALUES ('बस', 'basa'), ('बस्', 'bas' || chr(92)), ('कर्म', 'karma'), ('कृपा', 'kri^paa'), ('क्षेत्र', 'kshetra'), ('षड्यन्त्र', 'ShaDyantra'), ('ॐ', 'om')) AS t(native, roman)"


@query("r1_to_roman", f"SELECT native, roman FROM {_GOLD}")
def r1(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT native FROM (SELECT native FROM {_GOLD.replace('chr(92)', 'char(92)')})")
    return rows.select("native", translit.as_column(translit.to_roman, "native").alias("roman"))


@query("r2_to_devanagari", f"SELECT native, roman FROM {_GOLD} WHERE native <> 'बस'")
def r2(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT roman FROM {_GOLD.replace('chr(92)', 'char(92)')} WHERE native <> 'बस'")
    return rows.select(translit.as_column(translit.to_devanagari, "roman").alias("native"), "roman")


@query("r3_round_trip")
def r3(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark).select("pos", translit.as_column(lambda t: translit.to_devanagari(translit.to_roman(t)), "line").alias("back"), "line")


# The Roman spelling of the letters and signs in which lines of the documents are written (see EVERY).
_CONSONANTS = {"ब": "b", "च": "ch", "द": "d", "फ": "ph", "ग": "g", "ह": "h", "ज": "j", "क": "k", "ल": "l", "म": "m", "न": "n", "प": "p", "ठ": "Th", "र": "r", "स": "s", "त": "t", "व": "w", "ष": "Sh", "य": "y", "झ": "jh"}
_SIGNS = {"ा": "aa", "े": "e", "ि": "i", "ो": "o", "ु": "u", "ौ": "au"}


def _spelled(w: str) -> str:
    """SQL: a consonant has its inherent vowel unless a sign follows, a sign is read after a consonant only, all else stays."""
    consonants, signs = ("MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}" for pairs in (_CONSONANTS, _SIGNS))
    c, v = (f"'{''.join(pairs)}'" for pairs in (_CONSONANTS, _SIGNS))
    return f"""array_to_string(list_transform(range(1, length({w}) + 1), lambda i: CASE WHEN contains({c}, {w}[i]) THEN {consonants}[{w}[i]] || CASE WHEN i < length({w}) AND contains({v}, {w}[i + 1]) THEN '' ELSE 'a' END
    WHEN i > 1 AND contains({v}, {w}[i]) AND contains({c}, {w}[i - 1]) THEN {signs}[{w}[i]] ELSE {w}[i] END), '')"""


_ROMAN = f"{EVERY}, roman AS (SELECT kind, doc_id, pos, CASE WHEN trim(line) = '' THEN '' ELSE array_to_string(list_transform(string_split(line, ' '), lambda w: {_spelled('w')}), ' ') END AS roman FROM every WHERE kind IN ('plain', 'native'))"
#: Word by word: links and addresses stay.
_MIXED = f"""{EVERY}, mixed AS (SELECT kind, doc_id, pos, line, CASE WHEN trim(line) = '' THEN '' ELSE array_to_string(list_transform(string_split(line, ' '), lambda w:
CASE WHEN contains(w, '@') OR regexp_matches(w, '^https?://|^www\\.|\\.(com|edu|net|org)$') THEN w ELSE {_spelled('w')} END), ' ') END AS converted FROM every WHERE kind IN ('plain', 'native'))"""


def _both_scripts(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the documents in Latin and in Devanagari characters."""
    return every_line(spark, d).filter(F.col("kind").isin("plain", "native"))


@query("r4_lines_to_roman", f"{_ROMAN} SELECT kind, doc_id, pos, roman FROM roman")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return _both_scripts(spark, d).select("kind", "doc_id", "pos", translit.as_column(translit.lines_to_roman, "line").alias("roman"))


@query("r5_mixed_to_roman", f"{_MIXED} SELECT kind, doc_id, pos, converted FROM mixed")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return translit.convert_lines(_both_scripts(spark, d)).select("kind", "doc_id", "pos", "converted")


@query("r5_loanwords", "SELECT * FROM (VALUES ('फाइनल', 'final'), ('स्कुलमा', 'schoolmaa'), ('see http://x.np', 'see http://x.np'), ('कम्प्युटर ok', 'computer ok')) t(line, converted)")
def r5_loanwords(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in ("फाइनल", "स्कुलमा", "see http://x.np", "कम्प्युटर ok")], "line string")
    return translit.convert_lines(rows)


@query("r6_a24_conversion_statistics", f"{_MIXED} SELECT count(*) AS lines, sum(length(line))::BIGINT AS chars_in, sum(length(converted))::BIGINT AS chars_out, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END)::BIGINT AS lines_in, sum(CASE WHEN converted <> '' THEN 1 ELSE 0 END)::BIGINT AS lines_out FROM mixed")
def r6(spark: SparkSession, d: str) -> DataFrame:
    return translit.conversion_statistics(translit.convert_lines(_both_scripts(spark, d).select("line")))


@query("g1_type_schedule", "SELECT i AS slot, ['answerable','answerable','unavailable','answerable','multi_part','unavailable','answerable','short_learning','multi_part','unavailable'][i % 10 + 1] AS question_type FROM range(1000) t(i)")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1000).select(F.col("id").alias("slot"), qa.question_type("id").alias("question_type"))


@query("g2_instruction_variants", "SELECT * FROM (VALUES ('formal', 200), ('concise', 200), ('bullets', 150), ('conversational', 150), ('example_driven', 100), ('strict_format', 100), ('mixed_language', 50), ('very_short', 50)) t(instruction_variant, n)")
def g2(spark: SparkSession, d: str) -> DataFrame:
    out = qa.instruction_variants(spark.range(1000).withColumnRenamed("id", "slot"), 1000)
    return out.groupBy("instruction_variant").agg(F.count("*").cast("int").alias("n"))


def _contexts(spark: SparkSession) -> DataFrame:
    rows = [
        ("बचत खाता", "numerical", "न्यूनतम रकम पाँच सय हो।", {"thing": "बचत खाता"}), ("मोबाइल बैंकिङ", "procedural", "फारम भर्नुहोस्।", {"thing": "मोबाइल बैंकिङ"}),
        ("जम्मा", "conditional", "दश लाखभन्दा बढीमा कागजात चाहिन्छ।", {"threshold": "दश लाख"}), ("स्वाप", "short_learning", "स्वाप भनेको सटही हो।", {"term": "स्वाप"}),
    ]
    return spark.createDataFrame(rows, "topic string, type string, context string, entities map<string,string>")


TEMPLATES = {
    qa.ANSWERABLE: {"numerical": ["{} कति छ?"], "procedural": ["{} कसरी गर्ने?"], "conditional": ["{} भए के गर्ने?"]},
    qa.UNAVAILABLE: {"numerical": ["{} को इतिहास के हो?"], "procedural": ["{} कसले बनायो?"]},
    qa.MULTI: {"conditional": ["{} मा {} किन र {} कहिले?"]},
    qa.SHORT: {"definition": ["{} भनेको के हो?"]},
}


def _questions(spark: SparkSession) -> DataFrame:
    slots = spark.range(200).select(F.col("id").alias("slot"), qa.question_type("id").alias("question_type"))
    return qa.fill_templates(qa.select_contexts(slots, _contexts(spark)), TEMPLATES)


@query("g3_context_pools", "SELECT question_type, count(*) AS n FROM (SELECT ['answerable','answerable','unavailable','answerable','multi_part','unavailable','answerable','short_learning','multi_part','unavailable'][i % 10 + 1] AS question_type FROM range(200) t(i)) GROUP BY 1")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark).groupBy("question_type").agg(F.count("*").alias("n"))


@query("g4_filled_templates")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark).select("slot", "question_type", "type", "topic", "question")


_SAMPLES = "(VALUES ('answerable', 'q?', 'a full answer'), ('answerable', 'q?', 'abc'), ('unavailable', 'q?', 'something else'), ('multi_part', 'a? b?', 'short one')) AS t(question_type, input, output)"


@query("f21_a20_quality_report", "SELECT * FROM (VALUES ('answerable', 2::BIGINT, 1::BIGINT, 50.0::DOUBLE), ('unavailable', 1, 0, 25.0), ('multi_part', 1, 0, 25.0)) t(question_type, n, valid, pct)")
def f21(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {_SAMPLES}")
    return qa.quality_report(rows.withColumn("issues", qa.issues("question_type", "input", "output")))


@query("a21_costs", """WITH c AS (SELECT doc_id AS idx, sum(round((n_chars * 0.28 + n_chars * 0.42) * 100)) OVER (ORDER BY doc_id) / 1e8 AS cost FROM documents WHERE n_chars IS NOT NULL)
SELECT idx, round(cost, 8)::DOUBLE AS cost, cost >= 0.5 AS stop, cost >= 0.475 AS warn FROM c""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    usage = table(spark, d, "documents").filter("n_chars is not null").select(F.col("doc_id").alias("idx"), F.col("n_chars").alias("prompt_tokens"), F.col("n_chars").alias("completion_tokens"))
    out = qa.costs(usage, 0.5)
    return out.select("idx", F.round("cost", 8).alias("cost"), "stop", "warn")


def echo(prompts: list[str]) -> list[str]:
    """A stand-in for a language model: answers every prompt in the same way."""
    return ['{"input": "q", "output": "यो प्रश्नको उत्तर माथि छ।"}' for _ in prompts]


@query("g5_g7_generated_samples", "SELECT question_type, count(*) AS n, sum(CASE WHEN question_type = 'unavailable' THEN 2 ELSE 0 END)::BIGINT AS issues FROM (SELECT ['answerable','answerable','unavailable','answerable','multi_part','unavailable','answerable','short_learning','multi_part','unavailable'][i % 10 + 1] AS question_type FROM range(200) t(i)) GROUP BY 1")
def g5(spark: SparkSession, d: str) -> DataFrame:
    rows = _questions(spark).withColumns({"difficulty": F.lit("easy"), "instruction_variant": F.lit("formal"), "instruction": F.lit("x"), "prompt": F.col("question")})
    out = qa.generate(rows, echo)
    return out.groupBy("metadata.question_type").agg(F.count("*").alias("n"), F.sum(F.size("issues")).alias("issues"))


@query("g8_remaining_slots", "SELECT i AS slot FROM range(100) t(i) WHERE i % 3 <> 0")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return qa.remaining_slots(100, spark.range(0, 100, 3).withColumnRenamed("id", "slot"))


@query("g10_audit", "SELECT * FROM (VALUES (0::BIGINT, '{\"a\":1}'), (1, 'r1')) t(id, audited)")
def g10(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(2).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("record"))
    fix = lambda prompts: ['[{"a":1}]' if p == "r0" else "sorry" for p in prompts]
    return qa.audit(rows, fix).select("id", "audited")


@query("g11_tricky_questions", """WITH t AS (SELECT trim(text) AS context, row_number() OVER (PARTITION BY trim(text) ORDER BY conv_id, turn) AS r, conv_id, turn FROM conversations WHERE regexp_matches(text, '[^\\s]')),
f AS (SELECT context FROM t WHERE r = 1 ORDER BY conv_id, turn LIMIT 3) SELECT context, 'q' || k AS question, 'a' || k AS answer FROM f, range(3) r(k)""")
def g11(spark: SparkSession, d: str) -> DataFrame:
    reply = "Here: [" + ", ".join(f'{{"input": "q{k}", "output": "a{k}"}}' for k in range(3)) + "]"
    out = qa.tricky(table(spark, d, "conversations").withColumnRenamed("text", "input"), lambda prompts: [reply] * len(prompts), ["conv_id", "turn"])
    return out.select("context", F.col("sample.input").alias("question"), F.col("sample.output").alias("answer"))


@query("h1_faq_pairs", "SELECT page_id, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS question, 'page ' || page_id AS answer FROM pages WHERE trim(url) <> ''")
def h1(spark: SparkSession, d: str) -> DataFrame:
    # A panel of its own is put before each page's markup, all of which is parsed.
    button = F.format_string('<button data-toggle="collapse" data-target="#faq%d">%s</button>', "page_id", "url")
    body = F.format_string('<div id="faq%d"><div class="card-body"><p>page</p> <b>%d</b></div></div><button data-toggle="collapse" data-target="#none">No panel?</button>', "page_id", "page_id")
    rows = table(spark, d, "pages").select("page_id", F.explode(html.faq_column(F.concat(button, body, F.coalesce("html", F.lit(""))))).alias("f"))
    return rows.select("page_id", "f.question", "f.answer")


@query("h2_next_page", "SELECT page_id, '/p/' || (page_id + 1) AS by_number, '/next' AS by_word FROM pages")
def h2(spark: SparkSession, d: str) -> DataFrame:
    links = '<div class="pagination-block"><a href="/p/%d">%d</a><a href="/p/%d">%d</a><a href="/next">Next</a></div>'
    block = F.format_string(links, "page_id", "page_id", F.col("page_id") + 1, F.col("page_id") + 1)
    rows = table(spark, d, "pages").select("page_id", F.concat(block, F.coalesce("html", F.lit(""))).alias("page"))
    return rows.select("page_id", html.next_page_column("page", "page_id").alias("by_number"), html.next_page_column("page", F.lit(-7)).alias("by_word"))


@query("conversation_pairs", """SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations""")
def conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
