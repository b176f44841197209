"""Benchmark decontamination: containment search with size-partitioned minwise sketches.

Test items are short and documents long, so their Jaccard similarity says
little; what counts is the share of an item's shingles that a document holds.
Items are dealt into partitions by the size of their shingle set. Of an item
with n shingles, containment of at least t leaves at most n - ceil(t n) absent,
so among its n - ceil(t n) + 1 shingles of least hash one at least is in every
document that contains it: these form its sketch, and the search misses nothing.
A document probes the partitions whose smallest items it is large enough to
contain; each candidate is verified by exact containment on the shingle sets.

Words are runs of characters other than ASCII white space and punctuation,
lower-cased. Defined results: null and empty texts contain nothing and are
contained in nothing; an item of fewer than k words is one shingle of all its
words, searched as a run of words; equal items are found each; repeated document
rows give repeated result rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.kernels import U64, blocks, give_back, shingles, text_buffer, word_hashes

SHINGLE, CONTAINMENT = 5, 0.8
#: Items, and bytes of their texts, that one pass over the documents takes, about; more take more passes.
ITEMS_A_PASS, BYTES_A_PASS = 100_000, 64_000_000
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_PLAIN = np.frombuffer(bytes(range(256)).translate(_PUNCTUATION), np.uint8)


def words_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text of a string column."""
    for first in range(0, len(column), 512):
        data, offsets = text_buffer(pc.utf8_lower(column.slice(first, 512)))
        for a, b in blocks(offsets):
            base = offsets[a]
            words, at = word_hashes(_PLAIN[data[base : offsets[b]]], offsets[a : b + 1] - base)
            for i in range(b - a):
                yield words[at[i] : at[i + 1]]


class Index:
    """Sketches and shingle sets of one pass's items."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, threshold: float = CONTAINMENT):
        self.k, self.threshold = k, threshold
        self.ids, self.sets, widths = [], [], []
        for (item, _), words in zip(items, words_of(pa.array([t for _, t in items], pa.string()))):
            if len(words):
                self.ids.append(item)
                self.sets.append(np.unique(shingles(words, k)))
                widths.append(min(k, len(words)))
        #: By width of the shingles and size class: least size, sketch hashes, the item of each.
        self.parts: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for i, own in enumerate(self.sets):
            groups.setdefault((widths[i], len(own).bit_length()), []).append(i)
        for key, members in groups.items():
            least = min(self.need(len(self.sets[i])) for i in members)
            hashes = [self.sets[i][: len(self.sets[i]) - self.need(len(self.sets[i])) + 1] for i in members]
            owners = np.repeat(members, [len(h) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.parts[key] = least, flat[order], owners[order]
        self.widths = sorted(set(widths))
        self.filter = {w: self._bits([p[1] for key, p in self.parts.items() if key[0] == w]) for w in self.widths}

    def need(self, n: int) -> int:
        return max(1, math.ceil(self.threshold * n - 1e-9))

    def _bits(self, hashes: list[np.ndarray]) -> np.ndarray:
        self.mask = U64((1 << 22) - 1)
        bits = np.zeros(1 << 22, dtype=bool)
        for h in hashes:
            bits[(h & self.mask).astype(np.int64)] = True
        return bits

    def find(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, its shingles, those in the text) for every item contained in the text of these words."""
        for width in self.widths:
            if len(words) < width:
                continue
            all_own = shingles(words, width)
            own = all_own[self.filter[width][(all_own & self.mask).astype(np.int64)]]
            if not len(own):
                continue
            own, full = np.unique(own), None
            for (w, _), (least, hashes, owners) in self.parts.items():
                if w != width or len(all_own) < least:
                    continue
                a, b = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
                for i in sorted({int(o) for x, y in zip(a, b) if y > x for o in owners[x:y]}):
                    full = np.unique(all_own) if full is None else full
                    shared = int(np.isin(self.sets[i], full, assume_unique=True).sum())
                    if shared >= self.need(len(self.sets[i])):
                        yield i, len(self.sets[i]), shared


def _passes(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """Bounded slices of the benchmark, by the hash of the item's id."""
    rows = benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(text).alias("t")).filter("t is not null")
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(math.ceil(count / ITEMS_A_PASS), math.ceil(size / BYTES_A_PASS))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield sorted(((r.i, r.t) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles, containment) of every document that contains an item."""
    schema = "doc_id bigint, item_id bigint, item_shingles bigint, shared_shingles bigint, containment double"
    frame = docs.select(F.col("doc_id").cast("bigint"), "text")
    spark, out = docs.sparkSession, None
    for items in _passes(benchmark, "item_id", "text"):
        index = spark.sparkContext.broadcast(Index(items, k, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for doc, words in zip(ids, words_of(batch.column(1))):
                    rows += [(doc, own.ids[i], n, m, m / n) for i, n, m in own.find(words)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.float64()])],
                        names=["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"],
                    )

        found = frame.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept; rows are filtered where they are, without a join."""
    spark, place = docs.sparkSession, docs.columns.index("text")
    for items in _passes(benchmark, "item_id", "text"):
        index = spark.sparkContext.broadcast(Index(items, k, threshold))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                kept = [next(own.find(words), None) is None for words in words_of(batch.column(place))]
                yield batch.filter(pa.array(kept, pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
