"""The two similarity joins and the search, against brute force."""

import random

import numpy as np
import pytest

from loomtext.llm import decontamination, graph, setjoin, vectorjoin
from loomtext.llm.kernels import document_shingles, word_hashes

SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def sets_of(texts, k):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_copies(rng, groups, size, length, edits):
    docs = []
    for g in range(groups):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(length)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = f"x{rng.randint(0, 3)}"
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else " ".join(own))
    return docs


@pytest.mark.parametrize(("groups", "size", "length", "edits"), [(15, 3, 60, 4), (1, 150, 80, 8), (30, 1, 5, 0)])
def test_set_join_equals_brute_force(spark, groups, size, length, edits):
    rng = random.Random(size)
    texts = [*near_copies(rng, groups, size, length, edits), "", None, "a", "A", "a b", "a b c"]
    sets = sets_of(texts, 3)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = roots(len(sets), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in setjoin.near_duplicates(df, 3, 85).collect()}
    assert [got[i].component_id for i in range(len(sets))] == want
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def rows_by_brute_force(ids, near):
    """Component names of rows of which some share an id: the least id reachable from the row."""
    root = roots(len(ids), near)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    return sorted((i, least[r]) for i, r in zip(ids, root))


def test_rows_that_share_an_id_keep_their_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (4, a), (4, "other words here"), (0, b + " y")]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 1), (4, 1), (4, 4)]
    left = setjoin.keep_first(spark.createDataFrame([*rows, (1, a), (9, None), (9, None), (None, a)], "doc_id long, text string"), 3, 85).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(0, b + " y"), (1, a), (4, "other words here"), (9, None), (None, a)], key=str)
    rng = random.Random(4)
    texts = near_copies(rng, 20, 4, 50, 5)
    ids = [rng.randint(0, 30) for _ in texts]
    sets = sets_of(texts, 3)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.component_id) for r in setjoin.near_duplicates(df, 3, 85).collect()) == rows_by_brute_force(ids, pairs)


def test_vectors_that_share_an_id_keep_their_links(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 32))
    x = np.concatenate([c + rng.normal(size=(5, 32)) * 0.1 for c in centres])
    x[7] = x[3]
    ids = rng.integers(0, 20, len(x)).tolist()
    ids[7] = 77
    near = brute_vectors(x, 0.95)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    got = vectorjoin.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.component_id) for r in got) == rows_by_brute_force(ids, np.argwhere(near).tolist())
    assert sorted((r.vec_id, r.n_links) for r in got) == sorted(zip(ids, near.sum(axis=1).tolist()))


def test_no_link_under_the_threshold(spark):
    """Vectors whose cosine is as near to the threshold as doubles allow, on both sides."""
    rows, want = [], {}
    for i in range(60):
        y = np.sqrt(1 - 0.95**2) * (1 + (i - 30) * 2e-16 / 0.3)
        v = np.array([0.95, y, 0, 0])
        rows += [(2 * i, [1.0, 0.0, 0.0, 0.0] + [0.0] * i), (2 * i + 1, v.tolist() + [0.0] * i)]
        want[2 * i] = int(0.95 / np.sqrt((v * v).sum()) >= 0.95)
    got = {r.vec_id: r.n_links for r in vectorjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k: got[k] for k in want} == want and 0 < sum(want.values()) < 60


def test_strided_ids_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(vectorjoin, "CHUNK", 8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 16)) + rng.normal(size=(64, 16)) * 0.05
    df = spark.createDataFrame([(64 * i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = brute_vectors(x, 0.95)
    got = {r.vec_id // 64: r.n_links for r in vectorjoin.near_duplicates(df).collect()}
    assert [got[i] for i in range(64)] == near.sum(axis=1).tolist()


def test_clusters_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "SMALL", 8)
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    monkeypatch.setattr(setjoin, "CHUNK", 8)
    monkeypatch.setattr(setjoin, "WEIGHT", 500)
    monkeypatch.setattr(graph, "HOT", 5)
    test_set_join_equals_brute_force(spark, 1, 120, 80, 8)


def test_pairs_that_leave_deep_nodes_are_found(spark, monkeypatch):
    """Words that very many documents share make nodes that are split many times; near pairs must still meet."""
    monkeypatch.setattr(setjoin, "SMALL", 2)
    rng, pool, size = np.random.default_rng(3), 110, 50
    rows = []
    for _ in range(1000):
        order = rng.permutation(pool)
        rows += [order[:size], np.concatenate([order[5:size], order[size : size + 5]])]
    held = np.zeros((len(rows), pool), np.int64)
    for i, r in enumerate(rows):
        held[i, r] = 1
    both = held @ held.T
    pairs = [(i, j) for i, j in np.argwhere(100 * both >= 80 * (2 * size - both)).tolist() if i > j]
    want = roots(len(rows), pairs)
    df = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in setjoin.near_duplicates(df, 1, 80).collect()}
    assert sum(got[i] != want[i] for i in range(len(rows))) == 0


def test_pairs_that_leave_deep_nodes_are_found_by_splitting(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "NEAR_BLOCK", 2)
    test_pairs_that_leave_deep_nodes_are_found(spark, monkeypatch)


def test_nodes_of_a_common_passage_are_compared_and_not_split(spark, monkeypatch):
    rows, written = [], {}
    common = [f"c{i}" for i in range(30)]
    for i in range(300):
        own = [f"d{i}w{j}" for j in range(30)]
        rows.append(common + own)
        if i % 10 == 0:
            rows.append([*common, *own[1:], f"e{i}"])

    def record(df, name="table"):
        out = materialise(df, name)
        if name.startswith("level"):
            written[name] = out.count()
        return out

    materialise = setjoin.materialise
    monkeypatch.setattr(setjoin, "materialise", record)
    sets = [set(r) for r in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in setjoin.near_duplicates(df, 1, 85).collect()}
    assert [got[i] for i in range(len(rows))] == roots(len(rows), pairs) and len(pairs) == 30
    assert list(written) == ["level0"] and setjoin.SMALL < len(rows) < written["level0"]


def test_dealt_nodes_take_no_more_rows_than_split_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(setjoin, "SMALL", 4)
    monkeypatch.setattr(setjoin, "NEAR_BLOCK", 8)
    nodes = spark.createDataFrame([(g, rest, settled) for g, (rest, settled) in enumerate([(1, 2), (3, 60), (20, 20), (30, 9), (60, 1), (9, 400)])], "g long, rest int, settled int")
    ways = nodes.select("g", setjoin._way(F.col("rest"), F.col("settled"), 4).alias("way")).collect()
    assert {r.g: r.way for r in ways} == {0: setjoin.WHOLE, 1: setjoin.DEAL, 2: setjoin.SPLIT, 3: setjoin.SPLIT, 4: setjoin.SPLIT, 5: setjoin.DEAL}
    members = nodes.select("g", "rest", "settled", F.explode(F.sequence(F.lit(1), F.col("rest") + F.col("settled"))).alias("doc"))
    members = members.select("g", "doc", F.lit(0).alias("label"), (F.col("doc") > F.col("rest")).alias("settled"), F.lit(0).alias("w"))
    rows = {r.g: r.n for r in setjoin._dealt(members.filter("g in (1, 5)"), 8).groupBy(F.lit(0).alias("g")).agg(F.count("*").alias("n")).collect()}
    assert rows[0] <= 4 * (63 + 409)


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_trees_hold_their_miss_at_every_depth(threshold):
    trees, copies = setjoin.plan_trees(threshold)
    for depth in range(setjoin.LEVELS + 1):
        after = (1 - threshold**depth) ** copies if depth else 0
        assert (1 - threshold * (1 - after)) ** trees <= 1e-10


def test_pairs_meet_where_no_pivot_has_a_near_member(spark):
    """The least document holds only the minima of the others: it is the pivot of every node and near to none."""
    import pyarrow as pa

    names = [f"w{i}" for i in range(80)]
    (hashes,) = document_shingles(pa.array([" ".join(names)]), 1)
    minima = np.stack([setjoin.minwise(np.array([h]), setjoin._A, setjoin._B) for h in hashes])
    firsts = {int(np.argmin(minima[:, (t * 5) % setjoin.FUNCTIONS])) for t in range(setjoin.plan_trees(0.85)[0])}
    others = [i for i in range(80) if i not in firsts]
    texts = [" ".join(names[i] for i in sorted(firsts)), " ".join(names), " ".join(names[i] for i in range(80) if i not in others[:3])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in setjoin.near_duplicates(df, 1, 85).collect()} == {0: 0, 1: 1, 2: 1}


def test_set_join_of_odd_rows(spark, odd, empty):
    got = setjoin.near_duplicates(odd, 5, 80).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[4].kept and by[3].n_shingles == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert setjoin.near_duplicates(empty, 5, 80).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200 + rng.randint(0, 9), 200 + rng.randint(0, 9)) for _ in range(8)]
    names = sorted({x for e in edges for x in e})
    place = {n: i for i, n in enumerate(names)}
    want = roots(len(names), [(place[a], place[b]) for a, b in edges])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert [got.get(n, n) for n in names] == [names[w] for w in want]


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["The  cat\tsat", "the cat SAT", "", None, "é É x", "cat the sat", "a", "A\x0b"]
    got = list(document_shingles(pa.array(texts), 3))
    assert (got[0] == got[1]).all() and len(got[2]) == len(got[3]) == 0 and (got[6] == got[7]).all()
    assert got[0][0] != got[5][0]
    rng = random.Random(0)
    many = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    assert [len(set(map(int, s))) for s in document_shingles(pa.array(many), 2)] == [len(s) for s in sets_of(many, 2)]
    assert len(word_hashes(np.zeros(0, np.uint8), np.zeros(3, np.int64))[0]) == 0


def brute_vectors(x, cosine):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= cosine
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.03), (64, 0.05), (7, 0.1), (40, 0.04)])
def test_vector_join_equals_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(vectorjoin, "CHUNK", 24)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(12, dim))
    x = np.concatenate([c + rng.normal(size=(20, dim)) * spread * 2 for c in centres] + [rng.normal(size=(100, dim))]).astype(np.float32)
    x[5] = x[6]
    x[8] = x[7] * 3
    near = brute_vectors(x.astype(np.float64), 0.95)
    want = roots(len(x), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r for r in vectorjoin.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == want


def test_vector_join_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectorjoin.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and got[None][0] == 0 and got[None][2]
    assert vectorjoin.near_duplicates(df.limit(0)).count() == 0


def test_containment_search_equals_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [" ".join(word() for _ in range(n)) for n in (5, 9, 30, 30, 80, 3, 1)]
    docs = []
    for _ in range(60):
        own = [word() for _ in range(rng.randint(0, 300))]
        item = rng.choice(items).split()
        if rng.random() < 0.6:
            for _ in range(rng.randint(0, 3)):
                item[rng.randrange(len(item))] = word()
            at = rng.randint(0, len(own))
            own[at:at] = item
        docs.append(", ".join(own) if rng.random() < 0.2 else " ".join(own))
    clean = lambda t: " ".join(w for w in t.replace(",", " ").split())
    want = set()
    for i, item in enumerate(items):
        k = min(5, len(item.split()))
        parts = lambda t: {tuple(t.split()[j : j + k]) for j in range(len(t.split()) - k + 1)}  # noqa: B023, E731
        own = parts(item)
        for d, doc in enumerate(docs):
            shared = len(own & parts(clean(doc)))
            if shared >= 0.8 * len(own) - 1e-9 and shared:
                want.add((d, i, len(own), shared))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared_shingles) for r in decontamination.find(df, bench).collect()}
    assert got == want and want
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == set(range(len(docs))) - {w[0] for w in want}


def test_more_items_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 2)
    test_containment_search_equals_brute_force(spark)


def test_containment_search_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog", "e"), (1, "the quick brown fox jumps over the lazy dog", "e"), (None, "word word word word word", None)], "item_id long, text string, doc_id string")
    got = decontamination.find(odd, bench).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 8}
    assert decontamination.clean(odd, bench).columns == odd.columns
    assert decontamination.find(empty, bench).count() == 0 == decontamination.clean(empty, bench).count()
    assert decontamination.find(odd, bench.limit(0)).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == odd.count()
