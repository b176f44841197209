"""Language identification by compression with a dictionary for each language.

For each language a raw-content zstandard dictionary is gathered from training
texts. A text is cut into blocks, each block is compressed with every dictionary,
and the language whose compressed sizes add up to the least is chosen. Where the
least and the next differ by a few bytes only, sizes with shorter matches are added.
Where they differ by too small a share, ``identify`` marks the row as rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected;
languages that tie are ordered by name; without training rows all is ``und``; repeated
training rows count once, repeated rows are identified each. Texts are read whole; only the dictionaries come from a bounded
sample of rows, which are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

#: Bounds of the training sample of each language: rows that are drawn, about, and the bytes of those that its dictionary takes.
FIT_ROWS, DICTIONARY = 256, 120_000
BLOCK = 8_192
#: Bytes by which two languages may differ for a text to be compressed again with shorter matches.
CLOSE = 2
#: Margin at which the score is a half, and margin under which a row is rejected.
HALF, REJECT = 0.01, 0.002
_LETTER = regex.compile(r"\p{L}")


class Model:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dict(sorted(dictionaries.items()))
        self._made: list | None = None

    def __getstate__(self):
        return self.dictionaries

    def __setstate__(self, state):
        self.dictionaries, self._made = state, None

    def _compressors(self):
        """For each language the usual compressor, with matches of 4 bytes, and the slow one, with matches of 3."""
        if self._made is None:
            import zstandard as z

            frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            usual = z.ZstdCompressionParameters.from_level(6, min_match=4, strategy=z.STRATEGY_LAZY, **frame)
            slow = z.ZstdCompressionParameters.from_level(6, min_match=3, strategy=z.STRATEGY_BTOPT, search_log=4, target_length=16, **frame)
            self._made = []
            for name, content in self.dictionaries.items():
                made = []
                for how in (usual, slow):
                    data = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                    data.precompute_compress(compression_params=how)
                    made.append(z.ZstdCompressor(compression_params=how, dict_data=data).compress)
                self._made.append((name, *made))
        return self._made

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, share by which the next best is longer)."""
        if not text or not self.dictionaries or not _LETTER.search(text):
            return "und", 0.0
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = sorted((sum(len(usual(p)) for p in pieces), name) for name, usual, _ in self._compressors())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        if sizes[1][0] - sizes[0][0] <= CLOSE:
            first = dict((name, size) for size, name in sizes)
            sizes = sorted((first[name] + sum(len(slow(p)) for p in pieces), name) for name, _, slow in self._compressors())
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])


def _gather(rows: list[tuple[str, str]]) -> dict[str, bytes]:
    """Of each language the rows, in order, that still fit into its dictionary."""
    out: dict[str, bytes] = {}
    for lang, text in rows:
        data = b"\n" + text.lower().encode("utf-8", "replace")
        if len(out.get(lang, b"")) + len(data) <= DICTIONARY:
            out[lang] = out.get(lang, b"") + data
    return out


def fit(docs: DataFrame, training: Column, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model:
    """Gather dictionaries from about ``FIT_ROWS`` rows a language at most, drawn by a hash of key and text.

    Rows that are longer than a dictionary cannot be taken. After a first gathering, sampled rows that a dictionary
    of another language compresses better are left out, which cleans mistaken labels.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).filter(training)
    rows = rows.filter("l is not null and t is not null").filter(F.octet_length("t") < DICTIONARY)
    drawn = rows.withColumn("h", F.xxhash64("k", "t"))
    counts = drawn.groupBy("l").count().select("l", (F.lit(float(FIT_ROWS)) / F.greatest(F.col("count"), F.lit(FIT_ROWS)) * (1 << 40)).alias("below"))
    picked = drawn.join(F.broadcast(counts), "l").filter(F.pmod("h", F.lit(1 << 40)) < F.col("below"))
    sample = picked.select("l", "h", "t").dropDuplicates(["l", "h"]).collect()
    pairs = [(r.l, r.t) for r in sorted(sample, key=lambda r: (r.l, r.h))]
    first = Model(_gather(pairs))
    agreed = [(lang, text) for lang, text in pairs if first.predict(text)[0] in (lang, "und")]
    return Model(_gather(pairs) | _gather(agreed))


def identify(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``margin`` and ``rejected``: whether the margin is under ``reject``. Other columns pass through."""
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("margin", DoubleType()), StructField("rejected", BooleanType())]
    kept = [c for c in docs.columns if c not in [f.name for f in added]]
    frame, place = docs.select(*kept), kept.index(text)
    schema = StructType([*frame.schema.fields, *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [own.predict(t) for t in part.column(place).to_pylist()]
                margins = [m for _, m in found]
                made = [pa.array([name for name, _ in found], pa.string()), pa.array([m / (m + HALF) for m in margins], pa.float64()), pa.array(margins, pa.float64()), pa.array([m < reject for m in margins])]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)

    return frame.mapInArrow(run, schema)
