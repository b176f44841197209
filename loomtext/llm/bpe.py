"""BPE encoding and decoding with a pair occurrence index.

The new distinct words of a block of texts are laid out one after another. An
index maps each adjacent pair that has a rank to all positions where it occurs;
the active ranks are taken in ascending order, each applied at all its positions
from left to right, and the lists of the neighbouring pairs are updated. A
bounded cache keeps the ids of words that have been seen in the partition.

Files of the tokenizers library are read for the vocabulary, the merges and the
special tokens; the path is a parameter. Two families are supported: byte-level
BPE over its usual pattern, and lower-cased word BPE whose words have an end
mark. No word of the latter holds white space, so a run between white space is
encoded once for as long as the cache holds it.

Defined results: a null text is an empty text; the empty text has no ids; repeated
rows are encoded each; columns named like a new one are replaced, all others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from loomtext.llm.kernels import blocks, give_back, text_buffer

#: Words and runs whose ids a worker remembers in each of two generations; a full one replaces the older.
CACHE_WORDS = 200_000
#: What Python's split takes for white space and the files' patterns do not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file; built once in each Python worker."""

    def __init__(self, spec: str):
        import regex

        file = json.loads(spec)
        model = file["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.lowered = any(n["type"] == "Lowercase" for n in (file["normalizer"] or {}).get("normalizers", []))
        pre = file["pre_tokenizer"]
        pattern = BYTE_PATTERN if pre["type"] == "ByteLevel" else pre["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.alphabet = byte_alphabet()
        #: Rank of each pair; left, right and merged id of each rank.
        self.ranks: dict[int, int] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.vocab[a], self.vocab[b]
            self.rules.append((left, right, self.vocab[a + b]))
            self.ranks.setdefault(left << 32 | right, rank)
        self.letters = np.array([self.vocab[c] for c in self.alphabet], np.int32)
        self.finals = np.array([self.vocab[c + self.suffix] for c in self.alphabet], np.int32) if self.suffix else self.letters
        #: Rank of each pair of bytes, or -1, inside a word and at its end.
        self.first = [np.array([[self.ranks.get(int(x) << 32 | int(y), -1) for y in ends] for x in self.letters]) for ends in (self.letters, self.finals)]
        self.by_id = np.full(max([*self.vocab.values(), *self.special.values()]) + 1, "", dtype=object)
        for token, i in (self.vocab | self.special).items():
            self.by_id[i] = token
        self.byte_level = (file["decoder"] or {}).get("type") == "ByteLevel"
        back = {c: bytes([b]) for b, c in enumerate(self.alphabet)}
        if self.byte_level:
            self.raw = np.array([t.encode() if t in self.special else b"".join(back.get(c, c.encode()) for c in t) for t in self.by_id], dtype=object)
        self.pieces = self.raw.tolist() if self.byte_level else self.by_id.tolist()
        #: Ids of the special tokens, under names that no run can have.
        self.marks = {f"\n{t}": np.array([i], np.int32).tobytes() for t, i in self.special.items()}
        #: Ids of each word or run, of the last and of the generation before.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        if not self.lowered:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def learn(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the cache, by the pair occurrence index."""
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        stops = np.cumsum([len(e) for e in encoded])
        last = stops - 1
        end = np.zeros(len(data), bool)
        end[last] = True
        start = self.letters[data]
        start[last] = self.finals[data[last]]
        near, far = data[:-1], data[1:]
        rank = np.where(end[1:], self.first[1][near, far], self.first[0][near, far])
        rank[end[:-1]] = -1
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        found, cuts = np.unique(rank[places], return_index=True)
        flat, cuts = places.tolist(), [*cuts.tolist(), len(places)]
        index = {r: flat[a:b] for r, a, b in zip(found.tolist(), cuts, cuts[1:])}
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[last] = -1
        before[stops[:-1]] = -1
        before[:1] = -1
        ids, after, before = start.tolist(), after.tolist(), before.tolist()
        ranks, rules, push, pop = self.ranks.get, self.rules, heapq.heappush, heapq.heappop
        active = list(index)  # ascending, so it is a heap
        while active:
            current = pop(active)
            left, right, new = rules[current]
            ahead = new << 32
            own = index.pop(current)
            own.sort()
            for p in own:
                q = after[p]
                if ids[p] != left or q < 0 or ids[q] != right:
                    continue
                ids[p], ids[q] = new, -1
                r = after[p] = after[q]
                if r >= 0:
                    before[r] = p
                    other = ranks(ahead | ids[r])
                    if other is not None:
                        if other in index:
                            index[other].append(p)
                        else:
                            index[other] = [p]
                            push(active, other)
                o = before[p]
                if o >= 0:
                    other = ranks(ids[o] << 32 | new)
                    if other is not None:
                        if other in index:
                            index[other].append(o)
                        else:
                            index[other] = [o]
                            push(active, other)
        flat = np.array(ids, dtype=np.int32)
        stays = flat >= 0
        packed, ends = flat[stays].tobytes(), (4 * np.cumsum(stays)[last]).tolist()
        self.cache.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends)]))

    def _runs(self, piece: str) -> list[str]:
        """Parts of a normalised text that are encoded each by itself."""
        return self.words(piece) if self.byte_level or _ODD_SPACE.search(piece) else piece.split()

    def _parts(self, texts: list[str]) -> list[list[str]]:
        """The runs and special tokens of each text, all of which the cache then holds."""
        parts: list[list[str]] = []
        wanted: set[str] = set()
        for text in texts:
            if self.split and "<|" in text:
                own: list[str] = []
                for k, piece in enumerate(self.split(text)):
                    if k % 2:
                        own.append(f"\n{piece}")
                    elif piece:
                        own += self._runs(self.normalise(piece))
            else:
                own = self._runs(self.normalise(text))
            parts.append(own)
            wanted.update(own)
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        new = wanted.difference(self.cache)
        known = [r for r in new if r in self.older]
        self.cache.update(zip(known, map(self.older.__getitem__, known)))
        new.difference_update(known)
        if special := new.intersection(self.marks):
            self.cache.update((name, self.marks[name]) for name in special)
            new -= special
        if self.byte_level:
            split = {}
        else:
            split = {r: self.words(r) for r in new if not (r.isascii() and r.isalpha())}
            new.difference_update(split)
            for own in split.values():
                new.update(own)
            new.difference_update(self.cache)
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        self.cache.update((r, b"".join(map(get, own))) for r, own in split.items() if len(own) > 1)
        return parts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives without special tokens added."""
        parts, get = self._parts(texts), self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), np.int32) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens kept; ids outside the vocabulary are skipped."""
        known = (ids >= 0) & (ids < len(self.pieces))
        ids = ids if known.all() else ids[known]
        if self.byte_level:
            return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[int, Codec] = {}


def codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def read_spec(path: str) -> str:
    """The tokenizer file's JSON; it travels to the workers with the function that uses it."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(read_spec(path))


def _mapped(df: DataFrame, path: str, text: str, into: list[StructField], keep: list[str] | None, run) -> DataFrame:
    """Add the columns that ``run`` makes of a codec and a list of texts."""
    spec = _shared(df, path)
    names = [f.name for f in into]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = df.select(*kept, F.col(text).alias("_".join(["", *kept, "text"])))
    schema = StructType([*read.schema.fields[:-1], *into])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            column = batch.column(len(kept))
            _, offsets = text_buffer(column)
            for a, b in blocks(offsets, 1 << 21):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(kept)], *run(own, texts)], names=schema.names)
        give_back()

    return read.mapInArrow(each, schema)


def _listed(ids: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of each row's text to the columns ``keep``, or to all."""
    fields = [StructField(into, ArrayType(IntegerType()))]
    return _mapped(df, path, text, fields, keep, lambda own, texts: [_listed(own.encode(texts))])


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Add, in one pass, the ids of each row's text and the text that they decode to, to the columns ``keep``, or to all."""

    def run(own: Codec, texts: list[str]) -> list[pa.Array]:
        found = own.encode(texts)
        return [_listed(found), pa.array([own.decode(x) for x in found], pa.string())]

    return _mapped(df, path, text, [StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())], keep, run)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; null ids give the empty text."""
    spec = _shared(df, path)
    kept = [c for c in df.columns if c != into]
    place = kept.index(ids)
    frame = df.select(*kept)
    schema = StructType([*frame.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                column = part.column(place)
                flat = column.flatten().to_numpy(zero_copy_only=False)
                counts = np.array([len(x) if x.is_valid else 0 for x in column])
                texts = [own.decode(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, into])
        give_back()

    return frame.mapInArrow(run, schema)
