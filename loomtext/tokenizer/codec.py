"""Encoding and decoding with a script-aware vocabulary, as columns.

A text is marked (a mark for each blank and before the text, chosen by what follows),
cut into runs of one script that do not cross a mark, and each run is matched
greedily against the surfaces; what is not found is spelled in bytes. Before a run, an
abbreviation is looked for: a surface of two characters or more, if a full stop or
danda is near. No run and no surface crosses a mark after other characters, so what begins at marks is
encoded by itself, and remembered; as an abbreviation looks past it, the way to the
next stop behind it is part of what it is remembered by.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import col
from loomtext.tokenizer.vocab import BYTE_OF, BYTES, DEV, FMT, LAT, LATIN_MARK, NATIVE_MARK, NON_JOINER, PUN, WIDE_MARKS, AksharaDFA, Normalizer, Vocab, akshara_split, script_of


#: Marked words that a worker remembers; when there are more, it begins anew.
CACHE_WORDS = 200_000
_BOTH_MARKS = (NATIVE_MARK, LATIN_MARK)
_BLANKS = re.compile(r"(\s+)")
_BEFORE_LATIN = re.compile(" (?=[A-Za-z0-9])")
#: Marks and what follows them: an abbreviation may be looked for from one mark to the next.
_MARKED = re.compile(f"[{NATIVE_MARK}{LATIN_MARK}]+[^{NATIVE_MARK}{LATIN_MARK}]*")


def mark(text: str) -> str:
    """The text with its marks: before it and for every blank."""
    return _BEFORE_LATIN.sub(LATIN_MARK, f" {text}").replace(" ", NATIVE_MARK)


def mark_column(c: Column | str) -> Column:
    """:func:`mark` in built-in functions."""
    c = F.concat(F.lit(" "), col(c))
    return F.regexp_replace(F.regexp_replace(c, " (?=[A-Za-z0-9])", LATIN_MARK), " ", NATIVE_MARK)


class _Scripts(dict):
    """Script classes of the characters that were asked for."""

    def __missing__(self, c: str) -> str:
        self[c] = script_of(c)
        return self[c]


_SCRIPTS = _Scripts()


class _Alone(dict):
    """Tokens of the characters that begin no surface but themselves, each of which is encoded by itself."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, c: str) -> tuple[int, ...]:
        self[c] = tuple(self.codec._encode(c, self.codec.seed_longest))
        return self[c]

    def __reduce__(self):
        return _Alone, (self.codec,)


class Codec:
    """A vocabulary ready to encode; cheap to send, as it keeps surfaces and kinds only."""

    def __init__(self, vocab: Vocab, normalizer: Normalizer | None = None):
        self.surfaces, self.ids = list(vocab.surfaces), dict(vocab.ids)
        self.bytes = [BYTE_OF.get(s) if k == "byte" else None for s, k in zip(vocab.surfaces, vocab.kinds)]
        self.seed_longest, self.normalizer = vocab.seed_longest, normalizer or Normalizer()
        #: The longest surface for each first character: no longer match can begin there.
        self.reach: dict[str, int] = {}
        for s in self.surfaces:
            self.reach[s[:1]] = max(self.reach.get(s[:1], 0), len(s))
        #: The same for the first two characters.
        self.reach_of_two: dict[str, int] = {}
        for s in self.surfaces:
            if len(s) > 1:
                self.reach_of_two[s[:2]] = max(self.reach_of_two.get(s[:2], 0), len(s))
        self.spelled = [self.ids.get(b) for b in BYTES]
        self.raw = [s.encode("utf-8", "surrogatepass") if b is None else bytes([b]) for s, b in zip(self.surfaces, self.bytes)]
        #: A surface with a mark inside would join what marks part; the trainer makes none.
        self.joining = any(m in s[1:] for s in self.surfaces for m in (NATIVE_MARK, LATIN_MARK))
        #: Characters that begin no surface but themselves, and those that begin longer ones; in words without the latter no way to a stop matters.
        self.single = frozenset(c for c, n in self.reach.items() if n == 1 and c in self.ids)
        self.alone = _Alone(self)
        self.long = frozenset(c for c, n in self.reach.items() if n > 1)
        self.cache: dict[tuple[str, int], array] = {}
        self.plain: dict[str, array] = {}

    def _spell(self, text: str, out: list[int]) -> None:
        out += [i for b in text.encode("utf-8", "surrogatepass") if (i := self.spelled[b]) is not None]

    def _greedy(self, run: str, out: list[int]) -> None:
        ids, reach, i, n = self.ids, self.reach_of_two, 0, len(run)
        if self.single.issuperset(run):
            out += map(ids.__getitem__, run)
            return
        while i < n:
            for j in range(min(n, i + reach.get(run[i : i + 2], 1)), i, -1):
                if (found := ids.get(run[i:j])) is not None:
                    out.append(found)
                    i = j
                    break
            else:
                self._spell(run[i], out)
                i += 1

    def _abbreviation(self, text: str, i: int, near: list[int], out: list[int]) -> int:
        """The end of an abbreviation that begins at ``i``, or 0."""
        if near[i] >= self.seed_longest:
            return 0
        skip = text[i] in (NATIVE_MARK, LATIN_MARK)
        start = i + skip
        if start == len(text):
            return 0
        for n in range(min(self.seed_longest, self.reach_of_two.get(text[start : start + 2], 1), len(text) - start), 1, -1):
            if (found := self.ids.get(text[start : start + n])) is not None:
                if skip and (own := self.ids.get(text[i])) is not None:
                    out.append(own)
                out.append(found)
                return start + n
        return 0

    def encode_normalized(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._parts(text)))

    def _parts(self, text: str) -> list[array]:
        """The tokens of a text, word by word."""
        if self.joining:
            text = mark(text)
            return [array("i", self._encode(text, len(text) + self.seed_longest))]
        # Between single blanks a word's own characters name it; else it is named by its marks too.
        if text and text[0] != " " != text[-1] and "  " not in text and NATIVE_MARK not in text and LATIN_MARK not in text:
            words = text.split(" ")
        else:
            words = _MARKED.findall(mark(text))
        if len(self.cache) + len(self.plain) > CACHE_WORDS:
            self.cache.clear()
            self.plain.clear()
        parts = list(map(self.plain.get, words))
        if None in parts:
            self._encode_words(words, parts, bool(self.seed_longest) and ("." in text or "।" in text))
        return parts

    def _encode_words(self, words: list[str], parts: list[array | None], stops: bool) -> None:
        """Fill in the words that are not known yet, or whose tokens depend on the way to the next stop."""
        ways: list[int] | None = None
        for k, known in enumerate(parts):
            if known is not None:
                continue
            word = words[k]
            if (found := self.plain.get(word)) is None:
                marked = word if word[0] in _BOTH_MARKS else (LATIN_MARK if word[0].isascii() and word[0].isalnum() else NATIVE_MARK) + word
                if self.long.isdisjoint(marked):
                    found = self.plain[word] = array("i", chain.from_iterable(map(self.alone.__getitem__, marked)))
                else:
                    if ways is None:
                        ways = self._ways(words, stops)
                    if (found := self.cache.get((marked, ways[k]))) is None:
                        found = self.cache[marked, ways[k]] = array("i", self._encode(marked, ways[k]))
            parts[k] = found

    def _ways(self, words: list[str], stops: bool) -> list[int]:
        """The way from the end of each word to the next stop."""
        ahead = reach = self.seed_longest
        ways = [reach] * len(words)
        if stops:
            for k in range(len(words) - 1, -1, -1):
                word, ways[k] = words[k], ahead
                mark_ = word[0] not in _BOTH_MARKS
                if "." in word or "।" in word:
                    ahead = min(x for x in (word.find("."), word.find("।")) if x >= 0) + mark_
                elif ahead < reach:
                    ahead = min(reach, ahead + len(word) + mark_)
        return ways

    def encode_array(self, texts: pa.Array, normalise: bool = True) -> pa.ListArray:
        """Token ids of an Arrow array; nulls stay null."""
        flat, ends = array("i"), [0]
        for text in texts.to_pylist():
            if text is not None:
                for part in self._parts(self.normalizer(text) if normalise else text):
                    flat.extend(part)
            ends.append(len(flat))
        ids = pa.array(np.frombuffer(flat, np.int32) if flat else np.array([], np.int32))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids, mask=texts.is_null() if texts.null_count else None)

    def pieces_array(self, texts: pa.Array) -> pa.ListArray:
        ids = self.encode_array(texts)
        surfaces = pa.array(self.surfaces, pa.string()).take(ids.values)
        return pa.ListArray.from_arrays(ids.offsets, surfaces, mask=texts.is_null() if texts.null_count else None)

    def _encode(self, text: str, ahead: int) -> list[int]:
        """Ids of a marked text; ``ahead``: the way from its end to the next stop."""
        out, i, n = [], 0, len(text)
        scripts = list(map(_SCRIPTS.__getitem__, text))
        near: list[int] = []
        if self.seed_longest and (ahead < self.seed_longest or "." in text or "।" in text):
            near = [0] * n
            for k in range(n - 1, -1, -1):
                ahead = 0 if text[k] in ".।" else ahead + 1
                near[k] = ahead
        while i < n:
            if near and (end := self._abbreviation(text, i, near, out)):
                i = end
                continue
            j = i + 1
            while j < n and scripts[j] == scripts[i] and text[j] not in (NATIVE_MARK, LATIN_MARK):
                j += 1
            run, script = text[i:j], scripts[i]
            if script in (DEV, LAT):
                self._greedy(run, out)
            elif script == PUN:
                for c in run:
                    if (found := self.ids.get(c)) is not None:
                        out.append(found)
                    else:
                        self._spell(c, out)
            elif script == FMT:
                if (found := self.ids.get(NON_JOINER)) is not None:
                    out.append(found)
            else:
                self._spell(run, out)
            i = j
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_normalized(self.normalizer(text))

    def decode(self, ids) -> str:
        n = len(self.raw)
        text = b"".join([self.raw[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")
        return text.replace(NATIVE_MARK, " ").replace(LATIN_MARK, " ").removeprefix(" ")

    def pieces(self, text: str) -> list[str]:
        return [self.surfaces[i] for i in self.encode(text)]


class ColumnCodec:
    """Encode and decode columns with a broadcast vocabulary; nulls stay null."""

    def __init__(self, df: DataFrame, vocab: Vocab, normalizer: Normalizer | None = None):
        self._shared = df.sparkSession.sparkContext.broadcast(Codec(vocab, normalizer))

    def _udf(self, kind: str, apply: Callable):
        shared = self._shared

        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = shared.value
            for values in batches:
                yield values.map(lambda v: None if v is None else apply(own, v))

        return run

    def _arrow(self, kind: str, apply: Callable[[Codec, pa.Array], pa.Array]):
        """Not deterministic for Catalyst, so that a filter on the result is not pushed below a group-by or a projection, where texts would be encoded once more."""
        shared = self._shared

        @F.arrow_udf(kind)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = shared.value
            for values in batches:
                yield apply(own, values)

        return run.asNondeterministic()

    def encode(self, c: Column | str) -> Column:
        return self._arrow("array<int>", lambda own, v: own.encode_array(v))(col(c))

    def encode_normalized(self, c: Column | str) -> Column:
        return self._arrow("array<int>", lambda own, v: own.encode_array(v, False))(col(c))

    def decode(self, c: Column | str) -> Column:
        return self._udf("string", lambda own, v: own.decode(v))(col(c))

    def pieces(self, c: Column | str) -> Column:
        return self._arrow("array<string>", lambda own, v: own.pieces_array(v))(col(c))

    def normalize(self, c: Column | str) -> Column:
        return self._udf("string", lambda own, v: own.normalizer(v))(col(c))


def split_column(c: Column | str, dfa: AksharaDFA) -> Column:
    """The runs that an automaton accepts, longest first, as an array; the automaton travels with the function."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else dfa.split(v))

    return run(col(c))


def prototype_pieces(c: Column | str, seeds: Iterable[str], merges: Sequence[tuple[str, str]], normalizer: Normalizer | None = None) -> Column:
    """The earlier tokenizer: seeds and aksharas of each word, blanks one by one, then all merges in their order.

    It gives pieces, as it may make such as no vocabulary has; :func:`unseen` lists those.
    """
    longest = sorted(set(seeds), key=len, reverse=True)
    seed = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
    normal, merges = normalizer or Normalizer(), list(merges)

    def word(part: str) -> list[str]:
        out: list[str] = []
        for k, own in enumerate(seed.split(part) if seed else [part]):
            out += [own] if k % 2 else akshara_split(own)
        return out

    # Without a merge of blanks none reaches beyond its word, so words are merged by themselves and remembered.
    alone = not any(ch.isspace() for merge in merges for side in merge for ch in side)
    known: dict[str, list[str]] = {}

    def merged(part: str) -> list[str]:
        if not alone:
            return word(part)
        if (found := known.get(part)) is None:
            if len(known) > CACHE_WORDS:
                known.clear()
            found = known[part] = merge_replay(word(part), merges)
        return found

    def pieces(text: str) -> list[str]:
        out: list[str] = []
        for part in _BLANKS.split(normal(text)):
            out += part if part.isspace() else merged(part)
        return out if alone else merge_replay(out, merges)

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else pieces(v))

    return run(col(c))


def unseen(rows: DataFrame, vocab: DataFrame, pieces: str = "pieces") -> DataFrame:
    """(surface, n): pieces that the vocabulary (id, surface) lacks, which the earlier tokenizer added as it went."""
    counted = rows.select(F.explode(pieces).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    return counted.join(vocab.select("surface"), "surface", "left_anti")


def merge_replay(tokens: list[str], merges: Iterable[tuple[str, str]]) -> list[str]:
    """Tokens with every merge applied in the order in which it was learned."""
    for left, right in merges:
        out: list[str] = []
        for t in tokens:
            if out and t == right and out[-1] == left:
                out[-1] = left + right
            else:
                out.append(t)
        tokens = out
    return tokens


def script_column(c: Column | str) -> Column:
    """The script class of each character, as :func:`loomtext.tokenizer.vocab.script_of` gives it."""
    c = col(c)
    wide = "".join(WIDE_MARKS)
    return (
        F.when(c == NATIVE_MARK, DEV)
        .when(c.rlike(f"^[A-Za-z0-9{LATIN_MARK}]$"), LAT)
        .when(c == NON_JOINER, FMT)
        .when(c.rlike(rf"^[!-/:-@\[-`{{-~।॥{wide}]$"), PUN)
        .when(c.between("ऀ", "ॿ"), DEV)
        .otherwise("MAL")
    )


def framed(ids: Column | str, cls: int, sep: int, second: Column | str | None = None) -> Column:
    """Ids, or a pair of them, between their special tokens."""
    parts = [F.array(F.lit(cls)), col(ids), F.array(F.lit(sep))]
    if second is not None:
        parts += [col(second), F.array(F.lit(sep))]
    return F.concat(*parts)


def special_mask(ids: Column | str, second: Column | str | None = None) -> Column:
    one, zeros = F.array(F.lit(1)), lambda c: F.array_repeat(F.lit(0), F.size(col(c)))
    parts = [one, zeros(ids), one]
    if second is not None:
        parts += [zeros(second), one]
    return F.concat(*parts)


def type_ids(ids: Column | str, second: Column | str | None = None) -> Column:
    first = F.array_repeat(F.lit(0), F.size(col(ids)) + 2)
    return first if second is None else F.concat(first, F.array_repeat(F.lit(1), F.size(col(second)) + 1))


def padded(ids: Column | str, length: int, pad: int) -> Column:
    """Ids cut or filled to a length."""
    c = F.slice(col(ids), 1, length)
    return F.concat(c, F.array_repeat(F.lit(pad), F.lit(length) - F.size(c)))


def script_ids(scripts: Column | str, order: tuple[str, ...] = (DEV, LAT, PUN, FMT, "MAL")) -> Column:
    """A number for each script of an array."""
    return F.transform(col(scripts), lambda s: F.array_position(F.array(*map(F.lit, order)), s).cast("int") - 1)


def encode_bytes(c: Column | str) -> Column:
    """Binary as the array of its bytes."""
    hexes = F.regexp_extract_all(F.hex(col(c)), F.lit("(..)"), 1)
    return F.transform(hexes, lambda h: F.conv(h, 16, 10).cast("int"))


def decode_bytes(c: Column | str) -> Column:
    """The array of bytes as binary."""
    return F.unhex(F.array_join(F.transform(col(c), lambda b: F.lpad(F.hex(b.cast("bigint")), 2, "0")), ""))
