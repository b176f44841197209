"""Queries over the driver's tables, each with its SQL where SQL can express it.

Names begin with the operator's id in the survey. Importing this module loads all
modules of queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, and its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line) of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


#: The same in DuckDB's SQL, as the first of a list of named queries.
LINES = """WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM cut)"""

#: Lines in both scripts and of every kind that the filters know; one literal for both engines.
FIXTURE = """(VALUES
(0, 'नेपालको राजधानी काठमाडौं हो'), (1, 'abc क'), (2, 'ab'), (3, 'abc कखगघ'), (4, 'download the torrent 1080p अब'), (5, 'क ख ग घ च छ ज झ'),
(6, 'Good  morning everyone from Pokhara'), (7, 'ma dainik herne manxe hu'), (8, 'wow kati ramro'), (9, 'if they win the election all will change'),
(10, 'jay shree ram sabai lai'), (11, 'के हो यो?'), (12, 'kina aadha matra'), (13, 'follow us on instagram'), (14, 'विदेशीliदोष छ'), (15, 'xkcdq brtzl pqrst wvbnm'),
(16, 'the nepal government and the minister'), (17, '१२३ र 45'), (18, 'यो हाम्रो देशको राजनीति र अर्थतन्त्रको कुरा हो'), (19, 'what is this?'), (20, '!!! ??? ,,, ।।।'),
(21, '   '), (22, 'a &amp; b &amp; c &amp; d &amp; क'), (23, 'बालेन नै हुनुपर्छ भन्ने मेरो विचार'), (24, 'radhe  radhe'), (25, 'see what happen now'),
(26, 'सन् 2020 मा गा.वि.स.को निर्णय'), (27, 'watching from Gorkha today'), (28, 'hello दाजु'), (29, 'स्कुल र क्ा')) AS t(pos, line)"""


def fixture(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT cast(pos AS bigint) AS pos, line FROM {FIXTURE}")


#: What stands for a Latin letter where a line of the documents is written in Devanagari characters.
_LATIN, _NATIVE = "abcdefghijklmnopqrstuvwxyz", "ाबचदेफगहिजकलमनोपठरसतुवौषयझ"

#: Lines of every kind: those of the documents, the same in Devanagari characters, the same beside a line of the fixture, and the fixture.
EVERY = f"""{LINES}, fixture AS (SELECT pos::BIGINT AS pos, line FROM {FIXTURE}),
every AS (SELECT 'plain' AS kind, doc_id, pos::BIGINT AS pos, line FROM lines
UNION ALL SELECT 'native', doc_id, pos::BIGINT, translate(line, '{_LATIN}', '{_NATIVE}') FROM lines
UNION ALL SELECT 'phrase', doc_id, lines.pos::BIGINT, CASE WHEN lines.pos % 2 = 0 THEN fixture.line || ' ' || lines.line ELSE lines.line || ' ' || fixture.line END FROM lines JOIN fixture ON fixture.pos = (doc_id + lines.pos) % 30
UNION ALL SELECT 'fixture', -1, pos, line FROM fixture)"""


def every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, doc_id, pos, line) as in :data:`EVERY`."""
    lines, own = lines_of(spark, sf_dir), fixture(spark)
    few = F.broadcast(own.select(F.col("pos").alias("k"), F.col("line").alias("phrase")))  # thirty rows, a literal
    beside = lines.join(few, F.expr("(doc_id + pos) % 30 = k"), "left")
    phrase = F.expr("case when phrase is not null then if(pos % 2 = 0, concat_ws(' ', phrase, line), concat_ws(' ', line, phrase)) end")
    # The documents are read once.
    kinds = F.stack(F.lit(3), F.lit("plain"), F.col("line"), F.lit("native"), F.translate("line", _LATIN, _NATIVE), F.lit("phrase"), phrase)
    each = beside.select("doc_id", "pos", kinds.alias("kind", "line")).filter("line is not null").select("kind", "doc_id", "pos", "line")
    return each.unionAll(own.select(F.lit("fixture"), F.lit(-1).cast("bigint"), "pos", "line"))


from loomtext.plans import corpus, files, generation, streams, tokens  # noqa: E402, F401
