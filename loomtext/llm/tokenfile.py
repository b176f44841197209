"""Token ids on disk: an adaptive context-mixing range coder in independent blocks.

Each id is predicted by three distributions: order 2 (what followed the two ids
before), order 1 (what followed the id before) and order 0 (all ids, by how often
they came, unseen ones included). Orders 1 and 2 hold the most frequent successors of a context
with their counts. The three are mixed: a successor's probability is the sum of what
each order gives it, weighted by what the orders are worth in contexts as well known
as these; what the successors leave is the escape to order 0. The weights are
learned by expectation maximisation. The mixed intervals drive a carry-less range
coder with 64-bit bounds that writes 32-bit words, one an id at most.

A block's ids are dealt to lanes, each a stretch of the block with its own range
coder, so that both directions run as array operations over all lanes at once, and
a lane learns from all. Counts, successors and weights are adapted after each of
the first time steps of the lanes, and then after every sixth part of the steps so
far, from the ids alone, so the reader adapts alike. Every block begins from nothing,
ends with its own checksum, and holds whole documents. Arithmetic on probabilities is of
integers and of single operations on doubles, so any machine reads what another wrote.

Blocks are rows of a Parquet table (part, block, documents, ids, doc_ids, counts,
data), so any store that Spark reads will do, and a failed task leaves nothing.
Rows are in ascending doc_id order by (part, block). Defined results: a null text
is an empty text and has the end id alone; null doc_ids come first; repeated rows
are documents each, rows that share a doc_id are ordered by text; an empty table gives no blocks; ids are under 2 ** 19.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.bpe import byte_alphabet, read_spec
from loomtext.llm.kernels import blocks, text_buffer
from loomtext.session import materialise

#: Ids after which a block ends with the document; ids of a lane, about; lanes of a block at most.
BLOCK_IDS, LANE_IDS, LANES = 1 << 20, 256, 4096
#: Successors that a context of order 1 and of order 2 holds; slots of the contexts of order 2.
SUCCESSORS1, SUCCESSORS2, SLOTS2 = 3, 2, 1 << 18
#: Bits of an order-0 frequency, of a weight, and of a successor's share; a weight that order 0 has at least.
TOTAL, MIX, SHARE, FLOOR = 20, 10, 12, 16
#: A chunk of time steps is this part of those before it.
PART = 6
U = np.uint64
_WORD, _BOTTOM = U(32), U(1) << U(32)
_SCALE = MIX + SHARE
_FINE = TOTAL + MIX - _SCALE


class _Order:
    """The most frequent successors of each context with their counts, those of greater counts first."""

    def __init__(self, contexts: int, successors: int, start: int, levels: list[int]):
        self.ids = np.full((successors, contexts), start, np.int32)
        self.counts = np.zeros((successors, contexts), np.int32)
        self.held = np.zeros(contexts, np.int8)
        self.total = np.zeros(contexts, np.int32)
        #: What predictions read: successor and its share of the context; how well the context is known.
        self.packed = np.full((successors, contexts), start << SHARE, np.uint32)
        self.known = np.zeros(contexts, np.uint8)
        self.levels = levels

    def read(self, context: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for table in self.packed:
            row = table[context]
            out.append(((row >> np.uint32(SHARE)).view(np.int32), (row & np.uint32((1 << SHARE) - 1)).view(np.int32)))
        return out

    def learn(self, context: np.ndarray, ids: np.ndarray) -> None:
        key = np.sort(context.astype(np.int64) << TOTAL | ids)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times = np.diff(np.append(first, len(key))).astype(np.int32)
        key = key[first]
        at, x = key >> TOTAL, (key & ((1 << TOTAL) - 1)).astype(np.int32)
        begins = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        touched = at[begins]
        total = self.total[touched] + np.add.reduceat(times, begins)
        self.total[touched] = total
        new = np.ones(len(at), bool)
        for own, counts in zip(self.ids, self.counts):
            hit = np.flatnonzero(own[at] == x)
            counts[at[hit]] += times[hit]
            new[hit] = False
        new = np.flatnonzero(new)
        self._admit(at[new], x[new], times[new])
        for k in range(len(self.ids) - 1, 0, -1):
            rising = touched[self.counts[k][touched] > self.counts[k - 1][touched]]
            for table in (self.ids, self.counts):
                table[k - 1][rising], table[k][rising] = table[k][rising], table[k - 1][rising]
        scale, top = float(1 << SHARE) / total, float((1 << SHARE) - 1)
        for own, counts, packed in zip(self.ids, self.counts, self.packed):
            share = np.minimum(counts[touched] * scale, top).astype(np.uint32)
            packed[touched] = own[touched].view(np.uint32) << np.uint32(SHARE) | share
        self.known[touched] = sum((total >= n).view(np.uint8) for n in self.levels)

    def _admit(self, at: np.ndarray, x: np.ndarray, times: np.ndarray) -> None:
        """A new successor takes a free place, or that of the rarest if it came no more often, and else lowers its count."""
        last = len(self.ids) - 1
        for _ in self.ids:
            if not len(at):
                return
            more = np.append(False, at[1:] == at[:-1])
            now = np.flatnonzero(~more)
            a, n = at[now], times[now]
            place = self.held[a]
            full = place > last
            rarest = self.counts[last][a]
            enters = ~full | (rarest <= n)
            if not enters.all():
                self.counts[last][a[~enters]] -= 1
                now, a, n, place = now[enters], a[enters], n[enters], place[enters]
            place = np.minimum(place, last)
            self.ids[place, a], self.counts[place, a] = x[now], n
            self.held[a] = place + 1
            if len(more) == len(full):
                return
            at, x, times = at[more], x[more], times[more]


class _Model:
    """What both directions know after the chunks so far."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.counts = np.zeros(alphabet, np.int64)
        self.one = _Order(alphabet + 1, SUCCESSORS1, alphabet, [1, 4, 32, 256])
        self.two = _Order(SLOTS2, SUCCESSORS2, alphabet, [1, 2, 4, 16])
        #: By how well the contexts of orders 2 and 1 are known: what each order was worth.
        self.worth = np.tile(np.array([4.0, 3.0, 3.0]), (25, 1))
        self.prepare()

    def prepare(self) -> None:
        """Integer frequencies of order 0 and weights for the coming chunk."""
        n, unseen = int(self.counts.sum()), int((self.counts == 0).sum())
        share = ((self.counts == 1).sum() + 1) / (n + 2) if unseen else 0.0
        rare = max(1, int((1 << TOTAL) * share) // max(unseen, 1)) if n else (1 << TOTAL) // self.alphabet
        spare = (1 << TOTAL) - rare * unseen - (self.alphabet - unseen)
        if spare < 0:
            rare, spare = 1, (1 << TOTAL) - self.alphabet
        self.freq = np.where(self.counts > 0, 1 + self.counts * spare // max(n, 1), rare)
        self.freq[int(np.argmax(self.freq))] += (1 << TOTAL) - int(self.freq.sum())
        self.cum = np.cumsum(self.freq) - self.freq
        parts = self.worth / (self.worth[:, :1] + self.worth[:, 1:2] + self.worth[:, 2:])
        self.weight2 = np.rint(parts[:, 0] * ((1 << MIX) - FLOOR)).astype(np.int32)
        self.weight1 = np.minimum(np.rint(parts[:, 1] * ((1 << MIX) - FLOOR)), (1 << MIX) - FLOOR - self.weight2).astype(np.int32)

    @staticmethod
    def slot(before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
        return (before2.astype(np.uint32) * np.uint32(0x9E3779B1) + before1.astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(14)

    def predict(self, slot: np.ndarray, before1: np.ndarray):
        """Successors with their mixed masses, what they leave to order 0, and what the mixture was made of."""
        one, two = self.one.read(before1), self.two.read(slot)
        known = self.two.known[slot] * np.uint8(5) + self.one.known[before1]
        weight1, weight2 = self.weight1[known], self.weight2[known]
        masses = [weight1 * share for _, share in one]
        own = []
        for name, share in two:
            mass = weight2 * share
            alone = mass.copy()
            for k, (other, _) in enumerate(one):
                same = other == name
                masses[k] += mass * same
                alone *= ~same
            own.append(alone)
        masses += own
        left = np.full_like(masses[0], 1 << _SCALE)
        for m in masses:
            left -= m
        return [name for name, _ in one + two], masses, left, (known, weight1, weight2, one, two)

    def adapt(self, ids: np.ndarray, slot: np.ndarray, before1: np.ndarray) -> None:
        """Learn from a chunk of ids, (time, lanes); the weights from every eighth step."""
        x, s, b = ids[::8].ravel(), slot[::8].ravel(), before1[::8].ravel()
        _, _, left, (known, weight1, weight2, one, two) = self.predict(s, b)
        shares = [weight * sum(share * (name == x) for name, share in found) for weight, found in ((weight2, two), (weight1, one))]
        shares.append(left * self.freq[x] / (1 << TOTAL))
        total = shares[0] + shares[1] + shares[2]
        for k, own in enumerate(shares):
            self.worth[:, k] += np.bincount(known, own / total, 25)
        flat = ids.ravel()
        self.counts += np.bincount(flat, minlength=self.alphabet)
        self.one.learn(before1.ravel(), flat)
        self.two.learn(slot.ravel(), flat)
        self.prepare()


def _chunks(steps: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < steps:
        end = min(steps, at + max(1, at // PART))
        yield at, end
        at = end


def _ready(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes that write or read a word: their places, their low ends, and what is left of their sizes.

    Where the bits are not settled but the interval is too small, it is cut at the next multiple of 2 ** 32.
    A size is at least 2 ** 32 before an id, so at least 4 after it, and one word restores it.
    """
    settled = (low ^ (low + size)) < _BOTTOM
    ready = np.flatnonzero(settled | (size < _BOTTOM))
    own, settled = low[ready], settled[ready]
    return ready, own, np.where(settled, size[ready], (U(0) - own) & (_BOTTOM - U(1)))


def encode_block(ids: np.ndarray) -> bytes:
    """Ids as a checksummed block."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = len(ids)
    alphabet = int(ids.max()) + 1 if n else 1
    if alphabet > 1 << 19:
        raise ValueError("ids must be under 2 ** 19")
    lanes = int(np.clip(n // LANE_IDS, 1, LANES))
    steps = -(-n // lanes)
    padded = np.concatenate([ids.astype(np.int32), np.zeros(steps * lanes - n, np.int32)])
    x = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    one, two = np.full_like(x, alphabet), np.full_like(x, alphabet)
    one[1:], two[2:] = x[:-1], x[:-2]
    slot = _Model.slot(two, one)
    model = _Model(alphabet)
    low, size = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1))
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for begin, end in _chunks(steps):
        here = x[begin:end]
        names, masses, left, _ = model.predict(slot[begin:end], one[begin:end])
        scale = (left >> (TOTAL - _FINE)).astype(np.int64)
        start = ((np.int64(1) << _SCALE) - left << _FINE) + model.cum[here] * scale
        freq = model.freq[here] * scale
        acc = np.zeros_like(left)
        for name, mass in zip(names, masses):
            wide = mass.astype(np.int64) << _FINE
            better = (name == here) & (wide > freq)
            np.copyto(start, acc.astype(np.int64) << _FINE, where=better)
            np.copyto(freq, wide, where=better)
            acc += mass
        start, freq = start.view(U), freq.view(U)
        for t in range(end - begin):
            size >>= U(TOTAL + MIX)
            low += start[t] * size
            size *= freq[t]
            ready, own, rest = _ready(low, size)
            if len(ready):
                words.append((own >> _WORD).astype(np.uint32))
                owners.append(ready.astype(np.uint16))
                low[ready] = own << _WORD
                size[ready] = rest << _WORD
        model.adapt(here, slot[begin:end], one[begin:end])
    # The least multiple of 2 ** 32 in the interval: one word, as the interval is at least that wide.
    words.append((low + (_BOTTOM - U(1)) >> _WORD).astype(np.uint32))
    owners.append(np.arange(lanes, dtype=np.uint16))
    owner = np.concatenate(owners)
    stream = np.concatenate(words)[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner, minlength=lanes).astype(np.uint32)
    head = np.array([n, alphabet, lanes, zlib.crc32(ids.tobytes())], np.uint32)
    return b"LTB3" + head.tobytes() + sizes.tobytes() + stream.tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it is damaged."""
    if data[:4] != b"LTB3" or len(data) < 20:
        raise ValueError("not a block")
    n, alphabet, lanes, check = (int(v) for v in np.frombuffer(data, np.uint32, 4, 4))
    if alphabet > 1 << 19 or not 1 <= lanes <= LANES or len(data) < 20 + 4 * lanes:
        raise ValueError("the block is damaged")
    sizes = np.frombuffer(data, np.uint32, lanes, 20).astype(np.int64)
    if len(data) != 20 + 4 * lanes + 4 * sizes.sum() or sizes.min() < 1:
        raise ValueError("the block is cut short")
    steps = -(-n // lanes)
    if steps > 2 * BLOCK_IDS * LANE_IDS:
        raise ValueError("the block is damaged")
    stream = np.concatenate([np.frombuffer(data, np.uint32, -1, 20 + 4 * lanes), np.zeros(2, np.uint32)]).astype(U)
    ends = np.cumsum(sizes)
    at = ends - sizes

    def word(k: np.ndarray, lane) -> np.ndarray:
        return np.where(k < ends[lane], stream[np.minimum(k, ends[lane])], U(0))

    every = np.arange(lanes)
    code = word(at, every) << _WORD | word(at + 1, every)
    at += 2
    model = _Model(alphabet)
    low, size = np.zeros(lanes, U), np.full(lanes, U(2**64 - 1))
    x, one = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32)
    slot = np.empty((steps, lanes), np.uint32)
    before1 = before2 = np.full(lanes, alphabet, np.int32)
    top = U((1 << (TOTAL + MIX)) - 1)
    for begin, end in _chunks(steps):
        symbols = np.repeat(np.arange(alphabet, dtype=np.int32), model.freq)
        for t in range(begin, end):
            one[t], slot[t] = before1, model.slot(before2, before1)
            names, masses, left, _ = model.predict(slot[t], before1)
            scale = (left >> (TOTAL - _FINE)).astype(np.int64)
            edge = (np.int64(1) << _SCALE) - left
            size >>= U(TOTAL + MIX)
            value = np.minimum((code - low) // size, top).astype(np.int64)
            # Exact in doubles: the dividend is under 2 ** 30 and the divisor at most 2 ** 10.
            place = (np.maximum(value - (edge << _FINE), 0) / scale).astype(np.int32)
            own = symbols[np.minimum(place, (1 << TOTAL) - 1)]
            start, freq = (edge << _FINE) + model.cum[own] * scale, model.freq[own] * scale
            coarse = (value >> _FINE).astype(np.int32)
            acc = np.zeros(lanes, np.int32)
            for name, mass in zip(names, masses):
                hit = np.flatnonzero((coarse >= acc) & (coarse < acc + mass))
                own[hit] = name[hit]
                start[hit] = acc[hit].astype(np.int64) << _FINE
                freq[hit] = mass[hit].astype(np.int64) << _FINE
                acc += mass
            low += start.view(U) * size
            size *= freq.view(U)
            ready, mine, rest = _ready(low, size)
            if len(ready):
                low[ready] = mine << _WORD
                size[ready] = rest << _WORD
                code[ready] = code[ready] << _WORD | word(at[ready], ready)
                at[ready] += 1
            x[t] = own
            before2, before1 = before1, own
        if (x[begin:end] >= alphabet).any():
            raise ValueError("the block is damaged")
        model.adapt(x[begin:end], slot[begin:end], one[begin:end])
    out = np.ascontiguousarray(x.T).ravel()[:n].astype(np.uint32)
    if zlib.crc32(out.tobytes()) != check:
        raise ValueError("the block's checksum differs")
    return out


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library.

    The file's vocabulary is run by tiktoken, whose ids are the same and which takes
    a quarter of the time. Its regex engine refuses some very long runs; such a text goes
    to the tokenizers library itself.
    """

    #: The byte-level pattern with possessive repetition, which matches the same and backtracks less.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, spec: str):
        import tiktoken
        import tokenizers

        file = json.loads(spec)
        if file["pre_tokenizer"]["type"] != "ByteLevel" or file["normalizer"] is not None or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level files without a normalizer and a prefix space are read")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_alphabet())}
        ranks = {bytes(back[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.library = tokenizers.Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # the regex engine's backtracking limit
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[int, Encoder] = {}

BLOCKS = "part int, block int, documents bigint, ids bigint, doc_ids array<bigint>, counts array<bigint>, data binary"


def encode_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Blocks of the ids of ``docs(doc_id, text)`` with ``end_id`` after each document, in ascending doc_id order."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(spec.value))
        part, block, held, names, total = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            counts = [len(h) for h in held]
            values = [part, block, len(held), total, names, counts, encode_block(np.concatenate(held))]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["part", "block", "documents", "ids", "doc_ids", "counts", "data"])

        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in blocks(offsets):
                piece = batch.slice(a, b - a)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    held.append(np.concatenate([encoder(text or ""), end]))
                    names.append(doc)
                    total += len(held[-1])
                    if total >= BLOCK_IDS:
                        yield close()
                        block, held, names, total = block + 1, [], [], 0
        if held:
            yield close()

    frame = docs.select(F.col("doc_id").cast("bigint"), "text")
    return frame.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, target: str, path: str, end_id: int) -> None:
    encode_table(docs, path, end_id).write.option("compression", "none").parquet(target)


def read_documents(blocks: DataFrame, ids: bool = True) -> DataFrame:
    """Documents of a table of blocks: (part, block, doc_id, start, n_tokens, ids_crc32), and their ids if asked.

    ``start`` is the number of ids of all documents before. It needs sums over
    blocks only: running sums in each part, and one over the parts.
    """
    from pyspark.sql import Window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, docs_, counts, data = (batch.column(j)[i].as_py() for j in range(5))
                flat = decode_block(data)
                ends = np.cumsum(counts)
                if ends[-1] != len(flat):
                    raise ValueError("a block's documents do not add up to its ids")
                starts = ends - np.array(counts)
                sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(starts, ends)]
                n = len(docs_)
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(docs_, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "doc_id", "own", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    sums = blocks.groupBy("part").agg(F.sum("ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("block")) - F.col("ids")
    offsets = blocks.select("part", "block", inside.alias("blocks_before")).join(before, "part")
    schema = "part int, block int, doc_id bigint, own bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    found = blocks.select("part", "block", "doc_ids", "counts", "data").mapInArrow(run, schema).join(offsets, ["part", "block"])
    start = (F.col("parts_before") + F.col("blocks_before") + F.col("own")).alias("start")
    return found.select("part", "block", "doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def through_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the ids of ``docs`` to files in the shared folder, and read the documents back."""
    return read_documents(materialise(encode_table(docs, path, end_id), "blocks"), ids=False)
