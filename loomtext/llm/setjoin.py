"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles. Exact copies of a set are one class,
and only class representatives are joined. Independent trees branch the sets by
selected minwise tokens: a node of a tree holds the sets that agree on the minima
of the hash functions chosen along its path. Small nodes are compared pair by
pair, larger ones branch again, in several copies of their own paths. A pair of
similarity s stays together at one level with probability s, and in one of the
copies to a level d below the first with probability 1 - (1 - s ** d) ** copies.
``plan_trees`` takes as many trees and copies as hold the miss of a pair at the
threshold to MISS at every depth, for independent functions. All trees share FUNCTIONS functions,
and a pair whose minima agree in fewer than usual leaves more trees: averaged over
that, the trees miss 4e-6 at 0.85 and 8e-6 at 0.8 at the last level, and the
estimate filter below misses 3e-5 and 1.4e-5. Pairs above the threshold are missed less.

Near-copy groups stay together however deep a tree goes, so every node is first
compared with a pivot, the member that shares the most nodes with others; sets
whose link to a pivot is confirmed need no comparison among themselves, as only
components are asked for. Then estimates join sets into clusters: in small nodes
all are compared, in larger ones what is not in the largest component is compared with
all, block by block, where that takes no more rows than splitting the node, and in nodes
that stay large beyond all that are not near the pivot. In
a cluster that holds several components, all sets outside its largest component are compared
with all of the cluster, block by block and exactly. Every step gives at most one row a
member, block and tree, never the pairs of a group.

Signatures decide only which pairs are confirmed: a pair is passed over when its
estimate lies 4.5 standard deviations under the threshold.

Defined results: texts without words are null sets, link with nothing and are
kept; rows that share a doc_id and differ in text are documents each, whose components
may differ though they bear that one id; a null doc_id has no component
and is kept; an empty table gives an empty result. Sets are of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from loomtext.llm.graph import BROADCAST_ROWS, beside, components
from loomtext.llm.kernels import document_shingles, give_back, minwise, runs
from loomtext.session import materialise, unused

FUNCTIONS, LEVELS = 64, 5
#: Share of the pairs at the threshold that the trees may miss, whatever depth their nodes reach.
MISS = 1e-10
#: Members of a node that are compared pair by pair; members of a block of a larger one, by full sets and by estimates.
SMALL, BLOCK, NEAR_BLOCK = 64, 256, 512
#: Pairs that meet one document in one task of the confirmation.
CHUNK = 256
#: Shingles of a block of sets that are compared exactly, about, unless a single set has more.
WEIGHT = 1_000_000
#: Ways to compare a node's members.
WHOLE, DEAL, SPLIT = 0, 1, 2
_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)


def profile(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, x, n_shingles, digest, sig, brief): a hash of the text; of its set the size, a digest, its minima and their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for own in document_shingles(batch.column(2), k):
                own = np.unique(own)
                if not len(own):
                    rows.append((0, None, None, None))
                    continue
                low = minwise(own, _A, _B)
                rows.append((len(own), hashlib.blake2b(own.tobytes(), digest_size=16).digest(), low.view(np.int32), low.astype(np.uint8).tobytes()))
            n, digest, sig, brief = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32())), pa.array(brief, pa.binary())],
                names=["doc_id", "x", "n_shingles", "digest", "sig", "brief"],
            )
        give_back()

    frame = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("x"), F.col("text"))
    return frame.mapInArrow(run, "doc_id bigint, x bigint, n_shingles bigint, digest binary, sig array<int>, brief binary")


def _similar(pairs: DataFrame, briefs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least ``least``."""
    frame = (
        pairs.join(briefs.select(F.col("doc").alias("b"), F.col("brief").alias("y")), "b")
        .join(briefs.select(F.col("doc").alias("a"), F.col("brief").alias("x")), "a")
        .select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, FUNCTIONS) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return frame.mapInArrow(run, "a bigint, b bigint")


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Join rows with the text of their ``doc``; the rows are broadcast if few, else both sides are shuffled."""
    return texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("merge"), "doc")


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union, as (u, v).

    The pairs of one ``a`` are cut into chunks, so that its set is built once a
    chunk and a document with very many partners is spread over many tasks.
    """
    degrees = materialise(pairs.groupBy("a").agg(F.count("*").alias("n")), "degrees")
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK))
    dealt = materialise(beside(pairs, degrees, "a").select("a", "b", F.xxhash64("a", salt).alias("g")), "pairs")
    one = dealt.select("g", F.col("a").alias("doc"), F.lit(0).alias("role")).distinct()
    both = materialise(one.union(dealt.select("g", F.col("b").alias("doc"), F.lit(1).alias("role"))), "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, mine = None, None, None
        for (g,), piece in runs(batches, ["g"]):
            found: list[int] = []
            if g != now:
                now, first = g, None
            docs_, roles = piece.column(1).to_pylist(), piece.column(2).to_pylist()
            for doc, role, own in zip(docs_, roles, document_shingles(piece.column(3), k)):
                own = np.unique(own)
                if role == 0:
                    if first is None:
                        first, mine = doc, own
                    continue
                if first is None or first == doc:
                    continue
                shared = int(np.isin(own, mine, assume_unique=True).sum())
                if shared and 100 * shared >= percent * (len(own) + len(mine) - shared):
                    found.append(doc)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([first] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["u", "v"])

    rows = _with_texts(both, texts).select("g", "doc", "role", "text")
    return rows.repartition("g").sortWithinPartitions("g", "role", "doc").mapInArrow(run, "u bigint, v bigint")


def _joined(adjacent: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of members whose labels a symmetric relation joins: one pair for each label that joins another."""
    _, own = np.unique(labels, return_inverse=True)
    group = np.arange(own.max() + 1)
    first = np.full(len(group), len(own))
    np.minimum.at(first, own, np.arange(len(own)))
    x, y = np.nonzero(adjacent)
    x, y = own[x], own[y]
    while True:
        low = group.copy()
        np.minimum.at(low, x, group[y])
        np.minimum.at(low, group[x], group[y])
        low = low[low]
        if (low == group).all():
            break
        group = low
    return [(int(first[g]), int(first[k])) for k, g in enumerate(group.tolist()) if g != k]


def _edges(found: list[tuple[int, int]], docs_: list[int]) -> pa.RecordBatch:
    u, v = zip(*((docs_[i], docs_[j]) for i, j in found))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _grouped(compare):
    """A function over a stream sorted by its first column that calls ``compare`` with the columns of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for (group,), piece in runs(batches, ["g"]):
            if group != now:
                if held and (found := compare(held)):
                    yield _edges(found, [d for h in held for d in h.column(1).to_pylist()])
                now, held = group, []
            held.append(piece)
        if held and (found := compare(held)):
            yield _edges(found, [d for h in held for d in h.column(1).to_pylist()])
        held.clear()
        give_back()

    return run


def _near(members: DataFrame, briefs: DataFrame, least: float) -> DataFrame:
    """Edges (u, v) that join the labels in each group ``g`` of (g, doc, label) whose estimates are high enough."""

    def compare(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        labels = np.concatenate([h.column(2).to_numpy() for h in held])
        if len(labels) < 2 or (labels == labels[0]).all():
            return []
        x = np.frombuffer(b"".join(v for h in held for v in h.column(3).to_pylist()), np.uint8).reshape(-1, FUNCTIONS)
        _, own, times = np.unique(labels, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(own != np.argmax(times))  # members of the most common label need not meet
        agree = np.zeros((len(rest), len(x)), np.uint8)
        for low in np.ascontiguousarray(x.T):
            agree += (low[rest, None] == low).view(np.uint8)
        adjacent = np.zeros((len(x), len(x)), bool)
        adjacent[rest] = (agree >= least * FUNCTIONS) & (labels[rest, None] != labels)
        adjacent[:, rest] |= adjacent[rest].T
        return _joined(adjacent, labels)

    frame = members.join(briefs, "doc").select("g", "doc", "label", "brief")
    return frame.repartition("g").sortWithinPartitions("g").mapInArrow(_grouped(compare), "u bigint, v bigint")


def _dealt(members: DataFrame, size: int) -> DataFrame:
    """(g, doc, label) for (g, doc, label, settled, w): groups cut into blocks, each pair of blocks a group of its own.

    A block has about ``size`` members and weight WEIGHT. Two blocks of settled members need not meet, so the work is the number of open members times that of all.
    """
    part = lambda rest: F.greatest(F.ceil(F.count_if(rest) / size), F.ceil(F.coalesce(F.sum(F.when(rest, F.col("w"))), F.lit(0)) / WEIGHT)).cast("int")
    sides = members.groupBy("g").agg(part(~F.col("settled")).alias("a"), part(F.col("settled")).alias("b"))
    sized = members.join(sides.filter("a > 0"), "g")
    whole = (F.col("a") <= 1) & (F.col("b") <= 1)
    own = F.when(F.col("settled"), F.col("a") + F.pmod(F.xxhash64("doc"), F.greatest("b", F.lit(1)))).otherwise(F.pmod(F.xxhash64("doc"), F.col("a"))).cast("int")
    last = F.when(F.col("settled"), F.col("a") - 1).otherwise(F.col("a") + F.col("b") - 1)
    others = F.when(whole, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), last))
    pairs = sized.select("g", "doc", "label", own.alias("own"), whole.alias("whole"), F.explode(others).alias("other"))
    key = F.when(F.col("whole"), F.xxhash64("g", F.lit(-1), F.lit(-1))).otherwise(F.xxhash64("g", F.least("own", "other"), F.greatest("own", "other")))
    return pairs.select(key.alias("g"), "doc", "label")


def _exact(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v) that join the labels in each group ``g`` of (g, doc, label), by all intersections of full sets.

    A group is two blocks at most. Its intersections are one product of a matrix
    of members by the shingles that two of them share; the counts are exact.
    """

    def compare(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        labels = np.concatenate([h.column(2).to_numpy() for h in held])
        if len(labels) < 2 or (labels == labels[0]).all():
            return []
        sets = [np.unique(s) for h in held for s in document_shingles(h.column(3), k)]
        sizes = np.array([len(s) for s in sets])
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)
        column = np.full(len(times), -1)
        column[shared] = np.arange(len(shared))
        rows, column = np.repeat(np.arange(len(sets)), sizes), column[place]
        both = np.zeros((len(sets), len(sets)))
        for at in range(0, len(shared), 8192):
            here = (column >= at) & (column < at + 8192)
            matrix = np.zeros((len(sets), min(8192, len(shared) - at)), np.float32)
            matrix[rows[here], column[here] - at] = 1
            both += matrix @ matrix.T
        similar = 100 * both >= percent * (sizes[:, None] + sizes - both)
        return _joined(similar & (both > 0) & (labels[:, None] != labels), labels)

    rows = _with_texts(members, texts).select("g", "doc", "label", "text")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_grouped(compare), "u bigint, v bigint")


def _way(rest: Column, settled: Column, copies: int) -> Column:
    """How a node of so many members outside its largest component and in it is compared.

    In blocks where that takes at most ``copies`` rows a member, which splitting would take too; so the rows are linear in the members.
    """
    a, b = F.ceil(rest / NEAR_BLOCK), F.ceil(settled / NEAR_BLOCK)
    dealt = rest * (a + b) + settled * a <= copies * (rest + settled)
    return F.when(rest + settled <= SMALL, WHOLE).when(dealt, DEAL).otherwise(SPLIT)


def plan_trees(threshold: float) -> tuple[int, int]:
    """The trees, and the copies in which each node is split, that miss at most MISS of pairs at the threshold.

    A quarter of the trees are beyond those that the first level needs, which leaves room for the misses below it.
    """
    if threshold >= 1:
        return 1, 1
    trees = min(FUNCTIONS, math.ceil(1.25 * math.log(MISS) / math.log(1 - threshold)))
    below = (MISS ** (1 / trees) - (1 - threshold)) / threshold
    if below <= 0:
        raise ValueError(f"{FUNCTIONS} functions do not suffice at a threshold of {threshold}")
    return trees, math.ceil(math.log(below) / math.log(1 - threshold**LEVELS))


def link(texts: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Components (node, component) of the sets (doc, n_shingles, sig, brief); nodes named by themselves are left out.

    ``texts``: (doc, text), at least those of the sets.
    """
    threshold = percent / 100
    least = max(0.0, threshold - 4.5 * math.sqrt(threshold * (1 - threshold) / FUNCTIONS))
    briefs = reps.select("doc", "brief")
    trees, copies = plan_trees(threshold)
    first = F.array(*[F.xxhash64(F.lit(t), F.col("sig")[(t * 5) % FUNCTIONS]) for t in range(trees)])
    nodes = reps.select("doc", F.explode(first).alias("node"))
    sizes = materialise(nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    live = materialise(beside(nodes, sizes, "node"), "nodes")
    if live.isEmpty():
        return None
    central = live.groupBy("doc").agg(F.sum("n").alias("s"))
    scored = live.join(central, "doc")
    best = F.max(F.struct("s", -F.col("doc"))).alias("best")
    pivots = materialise(scored.groupBy("node").agg(best, F.count("*").alias("n")).select("node", (-F.col("best")["col2"]).alias("a"), "n"), "pivots")
    rooted = materialise(beside(live.drop("n"), pivots, "node").select("node", "doc", F.col("a").alias("pivot")), "rooted")
    stars = rooted.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    stars = materialise(_similar(stars, briefs, least), "stars")
    edges = materialise(confirm(stars, texts, k, percent), "edges")
    groups = components(edges)

    # Clusters of sets that may be similar though their components differ: by stars, and by estimates in the nodes.
    labels = reps.select("doc", "n_shingles", "sig").join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    labels = materialise(labels.select("doc", F.coalesce("component", "doc").alias("label"), "sig", F.col("n_shingles").alias("w")), "labels")
    near = stars.select(F.col("a").alias("u"), F.col("b").alias("v"))
    members = rooted
    small = None
    for level in range(LEVELS + 1):
        rows = members.join(labels.drop("w"), "doc") if level == 0 else members
        counts = rows.groupBy("node", "label").agg(F.count("*").alias("m"))
        kinds = counts.groupBy("node").agg(F.sum("m").alias("n"), F.max(F.struct("m", "label")).alias("top")).filter("top.m < n")
        kinds = kinds.select("node", "n", F.col("top")["label"].alias("most"), _way(F.col("n") - F.col("top")["m"], F.col("top")["m"], copies).alias("way"))
        rows = rows.join(kinds, "node").select("node", "doc", "label", "pivot", "way", (F.col("label") == F.col("most")).alias("settled"), F.when(F.col("way") == SPLIT, F.col("sig")).alias("sig"))
        rows = materialise(rows, f"level{level}")
        part = rows.filter(F.col("way") == WHOLE).select(F.col("node").alias("g"), "doc", "label")
        part = part.unionAll(_dealt(rows.filter(F.col("way") == DEAL).select(F.col("node").alias("g"), "doc", "label", "settled", F.lit(0).alias("w")), NEAR_BLOCK))
        small = part if small is None else small.unionAll(part)
        large = rows.filter(F.col("way") == SPLIT).drop("settled")
        if large.isEmpty():
            break
        if level == LEVELS:
            # A member near the pivot of its first node is in the pivot's cluster already.
            known = near.select(F.col("u").alias("pivot"), F.col("v").alias("doc"), F.lit(True).alias("known"))
            settled = F.coalesce("known", F.col("doc") == F.col("pivot"))
            stuck = large.join(known, ["pivot", "doc"], "left").select(F.col("node").alias("g"), "doc", "label", settled.alias("settled"), F.lit(0).alias("w"))
            small = small.unionAll(_dealt(stuck, BLOCK))
            break
        if level == 0:
            path = F.explode(F.array(*[F.xxhash64("node", F.lit(c)) for c in range(copies)]))
            large = large.withColumn("node", path)
        own = F.element_at("sig", (F.pmod("node", F.lit(FUNCTIONS)) + 1).cast("int"))
        members = large.select(F.xxhash64("node", own).alias("node"), "doc", "label", "pivot", "sig")
    near = materialise(near.unionAll(_near(small, briefs, least)), "near")
    clusters = components(near)
    clusters = clusters.select(F.col("node").alias("doc"), F.col("component").alias("g")).unionAll(clusters.select(F.col("component").alias("doc"), F.col("component").alias("g")).distinct())
    mixed = materialise(clusters.join(labels.select("doc", "label", "w"), "doc"), "clusters")

    # Exact comparison in each cluster of what is not in its largest component.
    sizes = mixed.groupBy("g", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("g").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("n")).filter("labels > 1")
    largest = materialise(largest.select("g", F.col("most")["label"].alias("most"), "n"), "largest")
    opened = beside(mixed, largest, "g").select("g", "doc", "label", (F.col("label") == F.col("most")).alias("settled"), "w")
    more = materialise(_exact(materialise(_dealt(opened, BLOCK), "blocks"), texts, k, percent), "edges")
    return groups if more.isEmpty() else components(edges.unionAll(more))


def _grouped_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, x, n_shingles, digest, place, component_id) of every row; ``place`` names its component apart from all others."""
    own = materialise(profile(docs, k), "profile")
    full = own.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("doc_id", "x")).alias("first")).select("digest", F.col("first")["doc_id"].alias("rep"), F.col("first")["x"].alias("x"))
    plain = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi").isEmpty()
    # Where an id has one set, it names its class, and no text need be moved; else classes are numbered and their texts written.
    classes = materialise(classes.withColumn("doc", F.col("rep") if plain else F.monotonically_increasing_id()), "classes")
    keyed = classes.withColumnRenamed("rep", "doc_id")
    reps = full.join(keyed, ["digest", "doc_id", "x"]).select("doc", "n_shingles", "sig", "brief").dropDuplicates(["doc"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("x"), "text")
    if plain:
        texts = texts.select(F.col("doc_id").alias("doc"), "text").filter("doc is not null")
    else:
        texts = materialise(texts.join(keyed, ["doc_id", "x"]).select("doc", "text").dropDuplicates(["doc"]), "texts")
    groups = link(texts, materialise(reps, "reps"), k, percent)
    out = own.select("doc_id", "x", "n_shingles", "digest").join(classes.select("digest", "doc", "rep"), "digest", "left")
    if groups is None:
        return out.select("doc_id", "x", "n_shingles", "digest", F.col("doc").alias("place"), F.coalesce("rep", "doc_id").alias("component_id"))
    if not plain:
        named = classes.select("doc", "rep").join(groups.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        groups = named.select(F.col("doc").alias("node"), "component").join(named.groupBy("component").agg(F.min("rep").alias("name")), "component")
    else:
        groups = groups.withColumn("name", F.col("component"))
    out = out.join(groups.withColumnRenamed("node", "doc"), "doc", "left")
    return out.select("doc_id", "x", "n_shingles", "digest", F.coalesce("component", "doc").alias("place"), F.coalesce("name", "rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``."""
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    return _grouped_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id", kept)


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, that of the least doc_id, and then text.

    All columns stay. Rows without an id or without words all stay, but of equal rows (doc_id, text) one.
    """
    found = materialise(_grouped_rows(docs, k, percent), "rows")
    x, n = unused("x", docs.columns), unused("n", docs.columns)
    gone = materialise(found.filter("component_id <> doc_id").select("doc_id", F.col("x").alias(x)).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.withColumn(x, F.xxhash64("text"))
    rows = rows.join(F.broadcast(gone) if few else gone.hint("merge"), ["doc_id", x], "left_anti")
    # Of what is left only rows that share an id may still be of one component.
    again = found.filter("doc_id is not null and coalesce(component_id = doc_id, true)")
    shared = materialise(again.groupBy("doc_id").agg(F.count("*").alias("count")).filter("count > 1").select("doc_id"), "shared")
    if shared.isEmpty():
        return rows.select(*docs.columns)
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(shared) if few else shared.hint("merge")
    places = again.join(side, "doc_id", "left_semi").select("doc_id", F.col("x").alias(x), F.coalesce("place", "x").alias(n)).distinct()
    window = Window.partitionBy("doc_id", n).orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text") and _orders(docs.schema[c])))
    one = rows.join(places, ["doc_id", x]).withColumn(x, F.row_number().over(window)).filter(F.col(x) == 1)
    return rows.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def _orders(field) -> bool:
    return not isinstance(field.dataType, (MapType, VariantType))
