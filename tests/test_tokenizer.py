"""The vocabulary, the codec and the trainer, with the rules of the survey as cases."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.tokenizer import codec as cd
from loomtext.tokenizer import train as tr
from loomtext.tokenizer import vocab as vb

LETTERS = [chr(c) for c in range(0x0900, 0x0980)]
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~।॥")


def vocabulary(*surfaces, seeds=()):
    v = vb.Vocab.initialize(LETTERS, seeds, PUNCTUATION)
    for s in surfaces:
        v.add(s, vb.LAT if s.strip("▂").isascii() else vb.DEV, "merged")
    return v


def test_recorded_segmentation_depends_on_a_stop_nearby():
    v = vocabulary("▁सन्", "▂2020", "▁मा", "▁निर्णय", seeds=["गा.वि.स.", "ने.क.पा.ए.मा.ले.", "सन्", "2020", "मा", "को", "निर्णय"])
    own = cd.Codec(v)
    assert own.pieces("सन् 2020 मा गा.वि.स.को निर्णय") == ["▁", "सन्", "▂", "2020", "▁", "मा", "▁", "गा.वि.स.", "को", "▁निर्णय"]
    assert own.pieces("सन् मा निर्णय") == ["▁सन्", "▁मा", "▁निर्णय"]
    assert own.pieces("मा।") == ["▁", "मा", "।"]


def test_marks():
    assert cd.mark("a  ब c") == "▂a▁▁ब▂c" and cd.mark("") == "▁"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_round_trip(text):
    text = text.replace("▁", "").replace("▂", "").replace("‌", "").replace("‍", "")
    own = cd.Codec(vocabulary("▁मा", "the", "▂the"))
    assert own.decode(own.encode(text)) == unicodedata.normalize("NFC", text)


def test_normaliser_rules():
    n = vb.Normalizer({"सङ्ग": "संग", "सँग": "संग"})
    assert [n(s) for s in ("सङ्ग", "सँग", "संग", "a‍b", "‌")] == ["संग", "संग", "संग", "ab", "‌"]


def test_load_loses_marks_but_encodes_alike():
    v = vocabulary("▁मा", "the")
    w = vb.Vocab.load(enumerate(v.surfaces))
    text = "the मा 😀 x."
    assert cd.Codec(v).encode(text) == cd.Codec(w).encode(text)
    assert w.kinds[w.id_of(".")] == "byte" and w.scripts[w.id_of("▂")] == vb.LAT


def test_save_and_read(spark, tmp_path):
    v = vocabulary("\t", "a\nb", "\\")
    v.write_tsv(spark, f"file://{tmp_path}/v")
    assert vb.Vocab.read_tsv(spark, f"file://{tmp_path}/v").surfaces == v.surfaces
    with pytest.raises(ValueError):
        v.surface_of(10**6)


def test_rule_and_machine_segmentation():
    assert vb.akshara_split("मी") == ["मी"] and "".join(vb.akshara_split("गर्नुहोस्")) == "गर्नुहोस्"
    d = vb.AksharaDFA()
    d.add(0, "क", 1, True)
    d.add(1, "ा", 2, True)
    assert d.split("काकx") == ["का", "क", "x"] and d.has(0, "क") and d.moves_from(1) == [("ा", 2, True)]


def slow_train(v, words, budget, **rules):
    """A full recount and a full scan for every merge."""
    t = tr.Trainer(v, **rules)
    words = [(list(w), c) for w, c in words]
    while len(v) < budget:
        freq = {}
        for w, c in words:
            for p in zip(w, w[1:]):
                freq[p] = freq.get(p, 0) + c
        legal = [(vb.RANK.get(v.scripts[a], 0), f, a, b) for (a, b), f in freq.items() if t.legal(a, b, f)]
        if not legal:
            break
        _, _, a, b = max(legal)
        new = v.merged(a, b, t.narrowed(a, b))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [new]
                else:
                    i += 1
    return v


@pytest.mark.parametrize("seed", range(4))
def test_trainer_equals_full_recounts(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))): rng.randint(1, 9) for _ in range(25)}
    types = lambda v: [(cd.Codec(v).encode(w), c) for w, c in sorted(words.items())]
    a, b = vocabulary(), vocabulary()
    size = len(a) + 20
    tr.Trainer(a, latin=True).train(types(a), size)
    slow_train(b, types(b), size, latin=True)
    assert a.surfaces == b.surfaces


def test_overlap_and_ties():
    v = vocabulary()
    t = tr.Trainer(v, latin=True)
    a = v.id_of("a")
    assert t.train([([a, a, a], 1)], len(v) + 1) == [([v.id_of("aa"), a], 1)]
    v = vocabulary()
    ids = {c: v.id_of(c) for c in "abcd"}
    t = tr.Trainer(v, latin=True)
    t.train([([ids["a"], ids["b"]], 2), ([ids["c"], ids["d"]], 2)], len(v) + 1)
    assert v.surfaces[-1] == "cd"


def test_paradigm_and_threshold():
    p = vb.Paradigms()
    p.add(1, {"जा": ["नु", "यो", "ने", "दा"], "जानु": ["हो", "छ"]})
    v = vb.Vocab.initialize(["जा", "नु", "मा"], ["को"], [], [], ["को"])
    v.assign_roots(p)
    t = tr.Trainer(v, p, theta=5)
    i = v.id_of
    assert t.legal(i("जा"), i("नु"), 1) and not t.legal(i("जा"), i("मा"), 1)
    assert t.gate(i("को"), i("मा"), 5) and not t.gate(i("को"), i("मा"), 4) and not t.gate(i("मा"), i("को"), 99)
    assert p.roots("जा") == p.roots("जानु") == [1] and p.roots("random") == []


def test_training_from_lines(spark):
    df = spark.createDataFrame([("the cat the hat",), ("the मा मा",)], "line string")
    v = vocabulary()
    tr.train_bilingual(df, v, len(v) + 2, 5)
    assert "▁मा" in v and "▂the" in v
    with pytest.raises(ValueError):
        tr.train_latin(df, vb.Vocab(), 5)


def test_prototype_ties_go_to_the_least_pair():
    got = tr.train_prototype([(["a", "b"], 2), (["c", "d"], 2)], 1, lambda s: "LAT")
    assert got == [("a", "b")]


def test_statistics_over_all_lines_equal_brute_force(spark, tmp_path):
    from statistics import mean, median

    from loomtext.plans import registry, tokens

    texts = ["plain words here\n\nDéjà vu, größer año", "नेपाल 2020 मा 日本 😀\nyear 2020", "café café naïve", "e\u0301 x", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    own = cd.Codec(tokens.base_vocab())
    lines = [(i, p, x) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n"))]
    n = [len(own.encode(x)) for *_, x in lines]
    w = [len(x.split()) for *_, x in lines]
    chars, size = sum(len(x) for *_, x in lines), sum(len(x.encode()) for *_, x in lines)

    by = {r.kind: r for r in run("a4_fertility_by_line")}
    latin = [any(c.isascii() and c.isalnum() for c in x) for *_, x in lines]
    for kind, want in (("ALL", [True] * len(lines)), ("latin_or_digit", latin), ("native_only", [not x for x in latin])):
        assert (by[kind].lines, by[kind].words, by[kind].tokens) == (sum(want), sum(b for a, b in zip(want, w) if a), sum(b for a, b in zip(want, n) if a))
    counts = {}
    for *_, x in lines:
        for word in x.split():
            counts[word] = counts.get(word, 0) + 1
    assert sum(r.words for r in run("a5_fertility_by_word_class")) == sum(counts.values())
    assert sum(r.tokens for r in run("a5_fertility_by_word_class")) == sum(c * len(own.encode(x)) for x, c in counts.items())
    worst = sorted(((x, len(own.encode(x)), c) for x, c in counts.items() if len(own.encode(x)) >= 5), key=lambda r: (-r[2], r[0].encode()))[:15]
    assert [tuple(r) for r in run("a7_worst_words")] == worst
    (r,) = run("a8_sample_summary")
    per = [a / max(b, 1) for a, b in zip(n, w)]
    assert r.rows == len(lines) and tuple(r)[1:] == pytest.approx((mean(per), median(per), sum(n) / sum(w)))
    (r,) = run("a9_a11_benchmark_row")
    assert tuple(r) == ("base", sum(n), 0.0, *map(pytest.approx, (sum(n) / sum(w), chars / sum(n), size / sum(n), chars / sum(n) / 8 * 100)))
    (r,) = run("a10_validation_summary")
    failures = sum(own.decode(own.encode(x)).strip() != x.strip() for *_, x in lines)
    assert tuple(r) == (pytest.approx(sum(n) / sum(w)), 0.0, failures)
    assert {(r.doc_id, r.pos): r.ratio for r in run("a26_characters_per_token")} == {(i, p): pytest.approx(len(x) / max(k, 1)) for (i, p, x), k in zip(lines, n)}


def test_aksharas_follow_the_rule():
    """Against a walk over the characters: signs close, viramas join, others begin anew."""
    single, sign = {*range(0x0904, 0x0915), 0x0960, 0x0961}, {*range(0x0900, 0x0904), *range(0x093E, 0x094D), 0x0962, 0x0963}
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(chr(rng.choice([0x0915, 0x0928, 0x094D, 0x094D, 0x093E, 0x0902, 0x0905, 0x0966, 0x61, 0x200C, 0x0A])) for _ in range(rng.randint(0, 12)))
        cuts = [0]
        for i in range(1, len(text)):
            a, b = ord(text[i - 1]), ord(text[i])
            native = lambda c: 0x0900 <= c <= 0x097F and c not in single
            joined = native(a) and native(b) and a not in sign and (b in sign or b == 0x094D or a == 0x094D)
            if not joined:
                cuts.append(i)
        want = [text[i:j] for i, j in zip(cuts, [*cuts[1:], len(text)])] if text else []
        assert vb.akshara_split(text) == want, ascii(text)


def test_merges_replay_in_their_order():
    assert cd.merge_replay(list("aaab"), [("a", "a"), ("aa", "a"), ("a", "b")]) == ["aaa", "b"]
    assert cd.merge_replay(list("abab"), [("a", "b"), ("ab", "ab")]) == ["abab"] and cd.merge_replay([], [("a", "b")]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["गा.वि.स.", "सन्", "2020", "मा", "को", ".", "।", " ", "  ", "a", "the", "é", "ने", "क.पा", "▁", "!"]), max_size=14).map("".join))
def test_words_are_encoded_as_within_their_text(text):
    own = cd.Codec(vocabulary("▁सन्", "▂2020", "▁मा", "the", "▂the", seeds=["गा.वि.स.", "ने.क.पा.", "सन्", "2020", "मा", "को"]))
    marked = cd.mark(text)
    assert own.encode_normalized(text) == own._encode(marked, len(marked) + own.seed_longest)


def test_an_automaton_splits_a_column(spark):
    dfa = vb.AksharaDFA()
    for state, ch, following, ok in ((0, "a", 1, True), (1, "b", 2, False), (2, "a", 1, True), (1, "c", 3, True)):
        dfa.add(state, ch, following, ok)
    rows = spark.createDataFrame([("ababacab",), ("xbc",), ("",), (None,)], "t string").select(cd.split_column("t", dfa).alias("p")).collect()
    assert [r.p for r in rows] == [["ababac", "a", "b"], ["x", "b", "c"], [], None]


def test_prototype_pieces_and_what_the_vocabulary_lacks(spark):
    df = spark.createDataFrame([("मा  the को।",), ("",)], "t string")
    rows = df.select(cd.prototype_pieces("t", ["को", "ो"], [("t", "h"), ("th", "e")]).alias("pieces"))
    assert rows.first().pieces == ["मा", " ", " ", "the", " ", "को", "।"]
    vocab = spark.createDataFrame([(0, "मा"), (1, " "), (2, "।")], "id int, surface string")
    assert {tuple(r) for r in cd.unseen(rows, vocab).collect()} == {("the", 1), ("को", 1)}


def test_training_from_lines_texts_and_for_latin(spark):
    lines = ["मा मा को", "the the then", "मान मान"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    own = lambda: vb.Vocab.initialize(LETTERS, ["को"], PUNCTUATION)
    merged = lambda v: [s for s, k in zip(v.surfaces, v.kinds) if k == "merged"]

    def by_hand(sequences, vocab, budget, **rules):
        codec, counts = cd.Codec(vocab), {}
        for s in sequences:
            key = tuple(codec.encode(s))
            counts[key] = counts.get(key, 0) + 1
        tr.Trainer(vocab, None, 1, **rules).train(sorted((list(k), n) for k, n in counts.items() if k), budget)
        return vocab

    words = [w for x in lines for w in x.split()]
    v = own()
    assert merged(tr.train(df, own(), len(v) + 2, theta=1)) == merged(by_hand(words, own(), len(v) + 2)) != []
    assert merged(tr.train_texts(df, own(), len(v) + 3, theta=1, column="line")) == merged(by_hand(lines, own(), len(v) + 3))
    latin = [w for w in words if w.isascii()]
    frozen, grown = own(), tr.train_latin(df, own(), 3)
    assert grown.surfaces[: len(frozen)] == frozen.surfaces and merged(grown) == merged(by_hand(latin, own(), len(v) + 3, latin=True)) != []
    free = by_hand(words, own(), len(v) + 2, free=True)
    assert merged(tr.train(df, own(), len(v) + 2, free=True)) == merged(free)
    with pytest.raises(ValueError):
        tr.train_latin(df, vb.Vocab(), 3)


@pytest.mark.parametrize("seed", range(3))
def test_training_over_a_table_equals_training_on_the_driver(spark, monkeypatch, seed):
    """With a sample of few words, whose guesses are often wrong, and without a word type on the driver beside it."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    for name, value in (("ROW_TOKENS", 40), ("BLOCK_TOKENS", 100), ("SAMPLE_TOKENS", 30), ("PENDING", 5)):
        monkeypatch.setattr(tr, name, value, raising=False)
    monkeypatch.setattr(Classic, "toLocalIterator", lambda *a, **b: pytest.fail("word types are brought to the driver"))
    rng = random.Random(seed)
    words = {"".join(rng.choice("aab") for _ in range(rng.randint(1, 9))): rng.randint(1, 9) for _ in range(60)} | {"".join(rng.choice("मान") for _ in range(5)): rng.randint(1, 9) for _ in range(30)}
    df = spark.createDataFrame([(w,) for w, n in words.items() for _ in range(n)], "line string")
    by_hand, table = vocabulary(), vocabulary()
    types = sorted((cd.Codec(by_hand).encode(w), n) for w, n in words.items())
    types = tr.Trainer(by_hand, theta=3).train(types, len(by_hand) + 12)
    tr.Trainer(by_hand, theta=3, latin=True).train(types, len(by_hand) + 25)
    tr.train_bilingual(df, table, 12 + len(table), 25, theta=3)
    assert table.surfaces == by_hand.surfaces and len(table) > len(vocabulary()) + 30


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["गा.वि.स.", "सन्", "2020", "20", "मा", "को", ".", "।", " ", "  ", "a", "the", "é", "😀", "▁", "▂x", "‌", "\t", "!"]), max_size=12).map("".join)), max_size=5))
def test_arrays_of_tokens_are_those_of_each_text(texts):
    import pyarrow as pa

    own = cd.Codec(vocabulary("▁सन्", "▂2020", "▁मा", "the", "▂the", seeds=["गा.वि.स.", "ने.क.पा.", "सन्", "2020", "मा", "को"]))
    whole = lambda t: own._encode(cd.mark(own.normalizer(t)), len(cd.mark(own.normalizer(t))) + own.seed_longest)
    want = [None if t is None else whole(t) for t in texts]
    assert own.encode_array(pa.array(texts, pa.string())).to_pylist() == want
    assert own.pieces_array(pa.array(texts, pa.string())).to_pylist() == [w if w is None else [own.surfaces[i] for i in w] for w in want]
    assert all(own.long.isdisjoint(w) or w[0] in "▁▂" for w in own.plain)


def test_words_are_encoded_once_where_a_filter_follows(spark):
    """The filter on the ids is not pushed below the count of words, where each occurrence would be encoded."""
    from loomtext.operators import metrics
    from loomtext.plans import tokens

    words = metrics.word_counts(spark.createDataFrame([("a b a déjà",)], "line string"))
    encoded = words.withColumn("ids", cd.ColumnCodec(words, tokens.base_vocab()).encode("word"))
    plan = metrics.worst_words(encoded)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and plan.index("EvalPython") < plan.index("Aggregate")


def test_aksharas_of_a_column_as_one_text(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([0x0915, 0x0928, 0x094D, 0x093E, 0x0902, 0x0905, 0x0966, 0x61, 0x200C, 0x0A, 0x1F600])) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", vb.aksharas_joined("t", "|").alias("a")).collect()
    assert all(r.a == (None if r.t is None else "|".join(vb.akshara_split(r.t))) for r in rows)


def test_normaliser_equals_a_walk():
    rules = [("aa", "b"), ("a", "c"), ("‍a", "d"), ("bb", "")]
    own, rng = vb.Normalizer(rules), random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice("aab‍é") for _ in range(rng.randint(0, 8)))
        out, i = [], 0
        while i < len(text):
            for old, new in sorted(rules, key=lambda r: -len(r[0])):
                if text.startswith(old, i):
                    out.append(new)
                    i += len(old)
                    break
            else:
                out.append("" if text[i] == "‍" else text[i])
                i += 1
        assert own(text) == "".join(out)
