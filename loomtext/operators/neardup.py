"""Near-duplicate lines: locality-sensitive hashing with a greedy keep-first, and a look-back over kept lines."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import WS, col, words
from loomtext.operators.dedup import exact_lines
from loomtext.operators.sampling import numbered
from loomtext.session import materialise

PERMUTATIONS, THRESHOLD, SHORT = 256, 0.7, 20


def plan_bands(threshold: float, permutations: int = PERMUTATIONS, steps: int = 100) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positives under and false negatives over the threshold."""

    def area(f, a: float, b: float) -> float:
        width = (b - a) / steps
        return sum(f(a + (i + 0.5) * width) for i in range(steps)) * width

    best = (math.inf, 1, 1)
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            found = lambda s: 1 - (1 - s**rows) ** bands  # noqa: B023, E731
            cost = area(found, 0.0, threshold) + area(lambda s: 1 - found(s), threshold, 1.0)  # noqa: B023
            best = min(best, (cost, bands, rows))
    return best[1:]


def shingles(c: Column | str, k: int = 5) -> Column:
    """The set of k-word runs; with fewer words, of k-character runs of the text without blanks, one at least."""
    # Words and text are bound as lambda variables: inside a lambda an expression would be evaluated for each shingle.
    long = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
    short = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - k + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(k)))
    joined = F.replace(col(c), F.lit(" "), F.lit(""))
    made = F.transform(F.array(words(c)), lambda w: F.when(F.size(w) >= k, long(w)).otherwise(F.get(F.transform(F.array(joined), short), F.lit(0))))
    return F.array_distinct(F.get(made, F.lit(0)))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Shingles:
    """Hashes of the shingles of texts as :func:`shingles` takes them, from hashes of their words, which are remembered."""

    def __init__(self, k: int, most: int = 300_000):
        self.k, self.most = k, most
        self.cache: dict[str, int] = {}
        self.blank = re.compile(f"[{WS}]+")

    def __call__(self, text: str) -> np.ndarray:
        own = [w for w in self.blank.split(text) if w]
        if len(own) < self.k:
            plain = text.replace(" ", "")
            return np.unique(np.array([_hash(plain[i : i + self.k]) for i in range(max(1, len(plain) - self.k + 1))], np.uint64))
        if len(self.cache) > self.most:
            self.cache.clear()
        new = [w for w in set(own) if w not in self.cache]
        self.cache.update(zip(new, map(_hash, new)))
        words_ = np.fromiter(map(self.cache.__getitem__, own), np.uint64, len(own))
        out = words_[: len(own) - self.k + 1].copy()
        for j in range(1, self.k):
            out ^= out >> np.uint64(29)
            out = out * np.uint64(0x9E3779B97F4A7C15) + words_[j : len(own) - self.k + 1 + j]
        return np.unique(out ^ (out >> np.uint64(32)))


def band_keys(items: DataFrame, key: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, keys): one hash a band, over the minima of its hash functions.

    Shingles and minima are array products over Arrow batches, many times faster
    than nested lambdas over arrays of strings, which Spark interprets.
    """
    draws = np.random.Generator(np.random.PCG64(42)).integers(1, 2**63, (2, bands * rows), dtype=np.uint64)
    times, plus = draws[0] * np.uint64(2) + np.uint64(1), draws[1]

    def keys(h: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 512):
            np.minimum(least, (h[at : at + 512, None] * times + plus).min(axis=0), out=least)
        out = np.arange(1, bands + 1, dtype=np.uint64)
        for column in least.reshape(bands, rows).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Shingles(k)
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "keys": [keys(own(t)) for t in f["text"]]})

    rows_ = items.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).filter("text is not null")
    return rows_.mapInPandas(run, "id bigint, keys array<bigint>")


def collisions(items: DataFrame, key: str, text: str, threshold: float, permutations: int, k: int = 5, bands: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups, members): items by equal signature, and (id, bucket) of group leaders in the band buckets that two of them share.

    Items of one signature collide in every band, so a group stands and falls with
    its first item, and only leaders go into buckets.
    """
    b, r = bands or plan_bands(threshold, permutations)
    signed = band_keys(items, key, text, k, b, r)
    groups = materialise(signed.withColumn("sig", F.xxhash64("keys")), "signatures")
    leaders = groups.groupBy("sig").agg(F.min("id").alias("id"))
    buckets = groups.join(leaders, ["sig", "id"], "left_semi").select("id", F.posexplode("keys").alias("band", "key"))
    buckets = buckets.select("id", F.xxhash64("band", "key").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return groups.select("id", "sig").join(leaders.withColumnRenamed("id", "leader"), "sig").select("id", "leader"), buckets.join(shared, "bucket").select("id", "bucket")


def greedy_kept(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes (id) that a sequential scan keeps: those that share a bucket with no kept smaller one.

    ``members``: (id, bucket). Works on memberships and never on pairs, in rounds: a
    node that is the least undecided one of all its buckets is kept, and drops all
    others of these. State is written each round; the number of rounds is that of the
    longest chain of decisions.
    """
    live, dropped = materialise(members.select("id", "bucket").distinct(), "members"), None
    while not live.isEmpty():
        first = live.groupBy("bucket").agg(F.min("id").alias("id"))
        wins = first.groupBy("id").agg(F.count("*").alias("n"))
        keep = live.groupBy("id").agg(F.count("*").alias("n")).join(wins, ["id", "n"]).select("id")
        won = first.join(keep, "id").select("bucket", F.col("id").alias("winner"))
        met = live.join(won, "bucket").groupBy("id").agg(F.max(F.col("id") == F.col("winner")).alias("kept"))
        met = materialise(met, "decided")
        gone = met.filter(~F.col("kept")).select("id")
        dropped = gone if dropped is None else dropped.unionAll(gone)
        live = materialise(live.join(met, "id", "left_anti"), "live")
    return nodes if dropped is None else nodes.join(dropped, "id", "left_anti")


def near_dup(items: DataFrame, key: str = "pos", text: str = "line", threshold: float = THRESHOLD, permutations: int = PERMUTATIONS, k: int = 5, bands: tuple[int, int] | None = None) -> DataFrame:
    """Items without those that collide with a kept earlier one; of a group of equal signatures the first stays or none.

    Items of fewer than 20 characters are all kept and empty ones left out. ``key``
    orders the items and is unique.
    """
    full = items.filter(F.col(text) != "")
    long = full.filter(F.char_length(text) >= SHORT)
    groups, members = collisions(long, key, text, threshold, permutations, k, bands)
    leaders = groups.select(F.col("leader").alias("id")).distinct()
    kept = greedy_kept(leaders, members).withColumnRenamed("id", key)
    return full.filter(F.char_length(text) < SHORT).unionByName(long.join(kept, key, "left_semi").select(*full.columns))


def full(lines: DataFrame, order: Sequence[str] = ("file", "pos"), column: str = "line", threshold: float = THRESHOLD) -> DataFrame:
    """Exact and then near-duplicate removal of lines in order; empty lines are left out."""
    kept = numbered(exact_lines(lines.filter(F.col(column) != ""), order, column), order, "__n")
    return near_dup(kept, "__n", column, threshold).drop("__n")


def near_dup_statistics(items: DataFrame, kept: DataFrame) -> DataFrame:
    a, b = items.agg(F.count("*").alias("total")), kept.agg(F.count("*").alias("kept"))
    return a.join(b).select("total", "kept", (F.col("total") - F.col("kept")).alias("duplicates"))


def alike(threshold: float, sides: int = 1) -> Callable[[str, str], bool]:
    """Whether difflib's ratio of two lower-cased lines reaches the threshold, in one direction or in either of both."""

    def near(a: str, b: str) -> bool:
        a, b = a.lower(), b.lower()
        # Upper bounds of what a matcher may find, the same in either direction and cheaper than one: lengths, characters, and the longest
        # common subsequence, as the matching blocks are a common one.
        length = len(a) + len(b)
        if length and any(2.0 * bound(a, b) / length < threshold for bound in (_shorter, _shared, _in_order)):
            return False
        return any(SequenceMatcher(None, x, y).ratio() >= threshold for x, y in [(a, b), (b, a)][:sides])

    return near


@lru_cache(512)
def _characters(text: str) -> dict[str, int]:
    return Counter(text)


def _shared(a: str, b: str) -> int:
    """Characters that two texts have in common, whatever their places."""
    a, b = _characters(a), _characters(b)
    return sum(min(n, b[c]) for c, n in a.items() if c in b)


def _shorter(a: str, b: str) -> int:
    return min(len(a), len(b))


@lru_cache(512)
def _places(text: str) -> dict[str, int]:
    """A bit for each place of a character."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _in_order(a: str, b: str) -> int:
    """The length of the longest common subsequence, for all places of ``a`` at once: a bit is cleared where a longer one ends."""
    places, every = _places(a), (1 << len(a)) - 1
    open_ = every
    for c in b:
        if hit := open_ & places.get(c, 0):
            open_ = (open_ + hit | open_ - hit) & every
    return len(a) - open_.bit_count()


def look_back(lines: DataFrame, by: Sequence[str], order: Sequence[str], column: str = "line", all_duplicates: bool = True, version: int = 2, window: int = 50) -> DataFrame:
    """Lines unlike the last ``window`` kept ones, and unlike every kept one exactly; or, by default of the tool, unlike the previous kept one.

    It depends on what was kept before, so a key's lines are read in order by one
    task, which keeps the last lines and, of the rest, digests. Likeness is difflib's ratio of the
    lower-cased lines, in either direction for version 2.
    """
    near, keys = alike({1: 0.75, 2: 0.70}[version], version), list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept, seen = None, [], set()
        for frame in batches:
            take = []
            for own, line in zip(frame[keys].itertuples(index=False, name=None), frame[column]):
                if own != now:
                    now, kept, seen = own, [], set()
                line_key = blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if all_duplicates:
                    ok = line_key not in seen and not any(near(line, k) for k in kept)
                else:
                    ok = not kept or (line != kept[-1] and not near(line, kept[-1]))
                take.append(ok)
                if ok:
                    kept = [*kept, line][-window if all_duplicates else -1 :]
                    seen.add(line_key)
            yield frame[take]

    rows = lines.filter(F.col(column).isNotNull())
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, rows.schema)
