"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c have the squared distance 2 - 2c. The vectors are rotated
by a fixed random orthogonal matrix and split into blocks of few dimensions. If the
squared distance of two vectors is at most D, then in one block at least theirs is
at most D times the block's share of the dimensions. So every block is range-joined
under that budget, and the union of the candidates is verified in double precision
on the vectors as given: no link is missed and none is added.

In a block, vectors are dealt into cells by the signs of their first coordinates. To
reach a cell of other signs a vector must cross zero in these coordinates, which
costs their squares; it visits those cells that its budget pays for. Of two cells
the lower visits the higher, so a pair meets once in a block; a pair that meets in
several blocks is counted in the first. Pairs are not written: a cell gives each
vector's number of links and one edge to the least vector of its local component.
Cells of many vectors are cut into chunks that all visitors of the cell meet in turn.

Equal vectors are one class and joined once. Defined results: vectors that are
null, empty, zero or hold null or non-finite components, and rows without vec_id,
link with nothing and are kept; vectors of different lengths do not link; repeated
rows count once; rows that share a vec_id and differ in vector are vectors each, whose
components may differ though they bear that one id; an empty table gives an empty result;
labels are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.graph import components
from loomtext.llm.kernels import U64, mix64, runs
from loomtext.session import materialise

BLOCK = 16
#: Vectors of a cell that one task holds; sign coordinates of a block at most. Cells grow in number with the
#: vectors up to 2 ** SIGNS a block, all signs of its coordinates; beyond, cells are cut into chunks.
CHUNK, SIGNS = 4_096, BLOCK


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def spans(dim: int) -> list[tuple[int, int]]:
    """The blocks of a rotated vector."""
    n = max(1, dim // BLOCK)
    cuts = [round(i * dim / n) for i in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def budget(span: tuple[int, int], dim: int, cosine: float) -> float:
    return (2 - 2 * cosine) * (span[1] - span[0]) / dim * (1 + 1e-9) + 1e-12


def cells(y: np.ndarray, limit: float, signs: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own cell of each row of ``y``, and the higher cells it can reach within ``limit``."""
    signs = min(signs, y.shape[1])
    if signs == 0:
        return np.zeros(len(y), np.int64), [np.zeros(0, np.int64)] * len(y)
    bits = np.int64(1) << np.arange(signs)
    own = ((y[:, :signs] > 0) @ bits).astype(np.int64)
    cost = y[:, :signs] ** 2
    out = []
    for code, prices in zip(own.tolist(), cost):
        order = np.argsort(prices)
        reach = [(code, 0.0)]
        for j in order.tolist():
            p = float(prices[j])
            if p > limit:
                break
            flip = 1 << j
            reach += [(c ^ flip, s + p) for c, s in reach if s + p <= limit]
        out.append(np.array([c for c, _ in reach if c > code], np.int64))
    return own, out


def _prepare(vectors: DataFrame, kind: np.dtype) -> DataFrame:
    """(vec_id, v, digest): the vector's bytes, null where it is not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], []
            for i in range(batch.num_rows):
                value, good = batch.column(1)[i], batch.column(0)[i].is_valid
                good = good and value.is_valid and len(value.values) > 0 and value.values.null_count == 0
                x = np.asarray(value.values, dtype=kind) + 0 if good else None  # -0.0 becomes 0.0
                good = good and bool(np.isfinite(x).all()) and bool(x.any())
                out.append(x.tobytes() if good else None)
                digests.append(hashlib.blake2b(out[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["vec_id", "v", "digest"])

    return vectors.mapInArrow(run, "vec_id bigint, v binary, digest binary")


def _doubles(raw: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, each times a power of two, which rounds nothing, and their norms."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def _rotated(x: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return (x / norms[:, None]) @ rotation(x.shape[1])


def _by_length(batch: pa.RecordBatch, kind: np.dtype, column: int) -> Iterator[tuple[int, np.ndarray]]:
    raw = batch.column(column).to_pylist()
    sizes = np.array([len(r) // kind.itemsize for r in raw])
    for dim in np.unique(sizes).tolist():
        yield dim, np.flatnonzero(sizes == dim)


def links(vectors: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """(vec_id, links, least) in parts: links of a vector found in a cell, and the least vector of its component there.

    ``vectors``: (vec_id, v, weight); a link counts as the partner's weight.
    """
    signs = int(np.clip(np.log2(max(1, vectors.count()) / CHUNK), 0, SIGNS))

    def dealt(batch: pa.RecordBatch):
        raw = batch.column(1).to_pylist()
        for dim, rows in _by_length(batch, kind, 1):
            y = _rotated(*_doubles([raw[i] for i in rows], kind))
            for b, (lo, hi) in enumerate(spans(dim)):
                own, reach = cells(y[:, lo:hi], budget((lo, hi), dim, cosine), signs)
                yield dim, b, rows, own, reach

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, b, rows, own, _ in dealt(batch):
                codes, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), dim)), pa.array(np.full(len(codes), b)), pa.array(codes), pa.array(n)], names=["dim", "b", "code", "n"])

    sizes = vectors.mapInArrow(counted, "dim bigint, b bigint, code bigint, n bigint").groupBy("dim", "b", "code").agg(F.sum("n").alias("n"))
    chunks = {(r.dim, r.b, r.code): -(-r.n // CHUNK) for r in sizes.filter(F.col("n") > CHUNK).collect()}

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dim", "b", "code", "chunk", "role", "vec_id", "weight", "v"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dealt_to = mix64(part.column(0).to_numpy().astype(np.int64).view(U64))
                for dim, b, rows, own, reach in dealt(part):
                    take, code, chunk, role = [], [], [], []
                    for i, o, others in zip(rows.tolist(), own.tolist(), reach):
                        n = chunks.get((dim, b, o), 1)
                        mine = int(dealt_to[i] % U64(n))
                        for c in range(mine, n):
                            take.append(i), code.append(o), chunk.append(c), role.append(int(c != mine))
                        for o2 in others.tolist():
                            for c in range(chunks.get((dim, b, o2), 1)):
                                take.append(i), code.append(o2), chunk.append(c), role.append(1)
                    k = len(take)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, dim)), pa.array(np.full(k, b)), pa.array(code, pa.int64()), pa.array(chunk, pa.int64()), pa.array(role, pa.int64()), *(part.column(j).take(pa.array(take, pa.int64())) for j in (0, 2, 1))],
                        names=names,
                    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        home = None
        for (dim, b, code, chunk, role), piece in runs(batches, ["dim", "b", "code", "chunk", "role"]):
            key = (dim, b, code, chunk)
            if key != now:
                now, held, home = key, [], None

            def side(p: pa.RecordBatch):
                x, norms = _doubles(p.column(7).to_pylist(), kind)
                return p.column(5).to_numpy(), p.column(6).to_numpy(), _rotated(x, norms), x, norms

            if role == 0:
                for at in range(0, piece.num_rows, 1024):
                    new = side(piece.slice(at, 1024))
                    for old in held:
                        yield from _compare(old, new, dim, b, cosine, False)
                    yield from _compare(new, new, dim, b, cosine, True)
                    held.append(new)
                continue
            if not held:
                continue
            if home is None:
                home = tuple(np.concatenate([h[i] for h in held]) for i in range(5))
            for at in range(0, piece.num_rows, 1024):
                yield from _compare(home, side(piece.slice(at, 1024)), dim, b, cosine, False)

    schema = "dim bigint, b bigint, code bigint, chunk bigint, role bigint, vec_id bigint, weight bigint, v binary"
    keys = ["dim", "b", "code", "chunk"]
    met = vectors.mapInArrow(visits, schema).repartition(*keys).sortWithinPartitions(*keys, "role")
    return met.mapInArrow(meet, "vec_id bigint, links bigint, least bigint")


def _compare(x, y, dim: int, b: int, cosine: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Links between two sets of vectors (ids, weights, rotated unit vectors, vectors, norms) that meet in block ``b``."""
    (ids, weights, p, given, norms), (ids2, weights2, q, given2, norms2) = x, y
    every = spans(dim)
    lo, hi = every[b]
    limit = budget((lo, hi), dim, cosine)
    u, w = p[:, lo:hi].astype(np.float32), q[:, lo:hi].astype(np.float32)
    apart = u @ w.T
    apart *= -2
    apart += (u * u).sum(axis=1)[:, None]
    apart += (w * w).sum(axis=1)[None, :]
    first, second = np.nonzero(apart <= limit + 1e-5)
    if same:
        first, second = first[first < second], second[first < second]
    good = np.zeros(len(first), bool)
    for at in range(0, len(first), 20_000):
        i, j = first[at : at + 20_000], second[at : at + 20_000]
        squares = (p[i] - q[j]) ** 2
        met = np.stack([squares[:, l:h].sum(axis=1) <= budget((l, h), dim, cosine) for l, h in every[: b + 1]])
        cosines = (given[i] * given2[j]).sum(axis=1) / (norms[i] * norms2[j])
        good[at : at + 20_000] = met[b] & ~met[:b].any(axis=0) & (cosines >= cosine)
    first, second = first[good], second[good]
    good = ids[first] != ids2[second]
    first, second = first[good], second[good]
    if not len(first):
        return
    vertices, place = np.unique(np.concatenate([ids[first], ids2[second]]), return_inverse=True)
    i, j = place[: len(first)], place[len(first) :]
    found = np.bincount(i, weights2[second], len(vertices)) + np.bincount(j, weights[first], len(vertices))
    label = np.arange(len(vertices))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(found.astype(np.int64)), pa.array(vertices[label])], names=["vec_id", "links", "least"])


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding)``."""
    kind = np.dtype(np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
    frame = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>" if kind == np.float32 else "array<double>"))
    own = materialise(_prepare(frame, kind), "vectors")
    valid = own.filter("digest is not null")
    classes = materialise(valid.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")), "classes")
    # A class is named by its least vec_id, unless that names another too.
    plain = classes.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    classes = materialise(classes.withColumn("node", F.col("rep") if plain else F.monotonically_increasing_id()), "classes")
    reps = valid.join(classes.withColumnRenamed("rep", "vec_id"), ["digest", "vec_id"]).dropDuplicates(["digest"])
    reps = materialise(reps.select(F.col("node").alias("vec_id"), "v", "weight"), "reps")
    found = materialise(links(reps, kind, cosine), "links")
    degree = found.groupBy("vec_id").agg(F.sum("links").alias("links")).withColumnRenamed("vec_id", "node")
    groups = components(found.filter("least <> vec_id").select(F.col("vec_id").alias("u"), F.col("least").alias("v")).distinct())
    named = classes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not plain:
        least = named.groupBy("component").agg(F.min("rep").alias("name"))
        named = named.join(least, "component").withColumn("component", F.col("name"))
    out = own.select("vec_id", "digest").join(named.join(degree, "node", "left").select("digest", "component", "links", "weight"), "digest", "left")
    component = F.coalesce("component", "vec_id")
    n = F.coalesce("links", F.lit(0)) + F.coalesce("weight", F.lit(1)) - 1
    return out.select("vec_id", n.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
