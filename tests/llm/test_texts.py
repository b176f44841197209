"""Tokens, chat, token files, sharding and classifiers: library parity, round trips, laws and held-out accuracy."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from loomtext.llm import bpe, chat, fitting, language, quality, queries, sharding, tokenfile, toxicity

SF = "/root/testdata/sf0.01"
CHARS = "aàÀßİΣσς́éﬁ'sStRE12²½٣ \t\n\r\x1c\x85\xa0​　!?#中文😀👍🏽नेपाली‍‌<|>_-"


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.tokenizer_path(name))
    t.no_truncation(), t.no_padding()
    return t


def odd_texts():
    rng = random.Random(1)
    made = ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return [*made, "<|startoftext|>hi<|endoftext|> x<|ENDOFTEXT|>", "ΟΔΟΣ", "a" * 3000, "don't we'll", "", " ", "x \n" * 500]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_are_those_of_the_library(name):
    t, own, texts = library(name), bpe.Codec(bpe.read_spec(queries.tokenizer_path(name))), odd_texts()
    for text, ids, want in zip(texts, own.encode(texts), t.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text
        assert own.decode(ids) == t.decode(want.ids, skip_special_tokens=False), text


def test_a_full_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    own, fresh = (bpe.Codec(bpe.read_spec(queries.tokenizer_path("word_bpe_49k.json"))) for _ in range(2))
    for text in odd_texts()[:200]:
        assert own.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()


def test_bpe_query_equals_the_library_on_the_whole_table(spark):
    t = library("word_bpe_49k.json")
    rows = {r.doc_id: r for r in queries.QUERIES["op2_bpe"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    for doc, e in zip(docs["doc_id"], t.encode_batch([x or "" for x in docs["text"]], add_special_tokens=False)):
        own = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False))]
        assert [rows[doc].n_tokens, rows[doc].ids_sha256, rows[doc].decoded_sha256] == [len(e.ids), *own]
    assert len(rows) == len(docs["doc_id"])


def test_fast_encoder_is_the_library():
    t, own = library("byte_bpe_50k.json"), tokenfile.Encoder(bpe.read_spec(queries.tokenizer_path("byte_bpe_50k.json")))
    for text in odd_texts():
        assert own(text).tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_bpe_of_odd_rows(spark, odd, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    both = bpe.round_trip(odd, path)
    out = bpe.decode(bpe.encode(odd, path), path)
    assert sorted(map(str, both.select(out.columns).collect())) == sorted(map(str, out.collect())) and bpe.round_trip(empty, path, keep=["doc_id"]).columns == ["doc_id", "ids", "decoded"]
    assert out.columns == [*(c for c in odd.columns if c != "ids"), "ids", "decoded"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[3].ids == [] and rows[3].decoded == "" and rows[1].ids == rows[2].ids and out.count() == odd.count()
    assert bpe.encode(empty, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 129, 70_000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), rng.zipf(1.3, n) % 5000, np.zeros(n), np.arange(n) % 7, rng.integers(0, 1 << 19, n)):
        assert (tokenfile.decode_block(tokenfile.encode_block(ids.astype(np.uint32))) == ids).all()


def test_repetition_is_predicted_and_damage_is_found():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 3000), 100).astype(np.uint32)
    data = tokenfile.encode_block(ids)
    assert len(data) < len(ids)  # under a byte an id
    for at in (30, len(data) // 3, len(data) // 2):
        with pytest.raises(ValueError):
            tokenfile.decode_block(data[:at] + bytes([data[at] ^ 8]) + data[at + 1 :])
    with pytest.raises(ValueError):
        tokenfile.decode_block(data[:-2])
    with pytest.raises(ValueError):
        tokenfile.encode_block(np.array([1 << 19], np.uint32))


@pytest.fixture(scope="module")
def corpus_ids():
    """The ids of the sf0.1 texts with the end id after each, as far as the largest block needs them."""
    own, docs, n = tokenfile.Encoder(bpe.read_spec(queries.tokenizer_path("byte_bpe_50k.json"))), [], 0
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist():
        docs.append(np.append(own(text or ""), 2).astype(np.uint32))
        n += len(docs[-1])
        if n >= 1 << 20:
            return np.concatenate(docs)


@pytest.mark.parametrize("n", [30_000, 65_536, 200_000, 400_000, 1 << 20])
def test_blocks_of_texts_are_small(corpus_ids, n):
    ids = corpus_ids[:n]
    data = tokenfile.encode_block(ids)
    share = np.bincount(ids)[np.unique(ids)] / n
    entropy = -(share * np.log2(share)).sum()
    assert (tokenfile.decode_block(data) == ids).all()
    assert 8 * len(data) / n < 1.1 * entropy and len(data) < len(zlib.compress(ids.astype(np.uint16).tobytes()))


def test_higher_orders_are_mixed():
    """Ids of equal frequency, each followed by one of three: order 0 alone would need 8 bits."""
    rng = np.random.default_rng(5)
    after, ids = rng.integers(0, 256, (256, 3)), [0]
    for draw in rng.choice(3, 100_000, p=[0.7, 0.2, 0.1]):
        ids.append(after[ids[-1], draw])
    assert 8 * len(tokenfile.encode_block(np.array(ids, np.uint32))) / len(ids) < 2


def test_token_files_equal_the_library_on_the_whole_table(spark):
    t = library("byte_bpe_50k.json")
    rows = {r.doc_id: r for r in queries.QUERIES["op7_token_files"](spark, SF).collect()}
    docs = sorted(zip(*pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    start = 0
    for (doc, _), e in zip(docs, t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 2], np.uint32)
        assert (rows[doc].start, rows[doc].n_tokens, rows[doc].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(docs)


def test_what_the_fast_encoder_refuses_goes_to_the_library():
    own = tokenfile.Encoder(bpe.read_spec(queries.tokenizer_path("byte_bpe_50k.json")))
    text = " " * 1_500_000 + "a"
    with pytest.raises(ValueError):
        own.fast.encode_to_numpy(text)
    assert len(own(text)) == 1_500_000


def test_rows_that_share_an_id_are_ordered_by_text(spark):
    df = spark.createDataFrame([(1, "b b"), (1, "a"), (1, "a"), (1, None)], "doc_id long, text string").repartition(4)
    rows = tokenfile.through_files(df, queries.tokenizer_path("byte_bpe_50k.json"), 2).orderBy("start").collect()
    own = library("byte_bpe_50k.json")
    sums = [zlib.crc32(np.array([*own.encode(t, add_special_tokens=False).ids, 2], np.uint32).tobytes()) for t in ("", "a", "a", "b b")]
    assert [r.ids_crc32 for r in rows] == sums and [r.start for r in rows] == [0, 1, 3, 5]


def test_token_files_keep_order_and_offsets(spark, odd, empty, monkeypatch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = tokenfile.through_files(odd, path, 2).orderBy("start").collect()
    assert len(rows) == odd.count()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys) and {r.doc_id: r.n_tokens for r in rows}[3] == 1
    assert tokenfile.through_files(empty, path, 2).count() == 0


def test_chat_reads_back_and_masks(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    texts = [probe, "back\\slash \\\\ <\\| <", None, "", "<|image|>", "line\nline", "end\\", "<", "😀<|"]
    rows = [(1, i, ["user", "assistant", "sys\ntem\\<|", None][i % 4], t) for i, t in enumerate(texts)] + [(None, 0, "assistant", "x"), (2, 0, None, None), (2, 0, "a", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    parsed = chat.parse_pieces(chat.format_turns(df))
    back = {(r.conv_id, r.turn, r.role): r for r in parsed.collect()}
    assert all(back[c, t, r or ""].text == (x or "") for c, t, r, x in rows)
    assert all((v.loss_text is not None) == (k[2] == "assistant") for k, v in back.items())
    got = {r.conv_id: r for r in chat.digest(parsed).collect()}
    want = hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for c, _, r, x in rows if c == 1).encode()).hexdigest()
    loss = "".join(x or "" for c, _, r, x in rows if c == 1 and r == "assistant")
    assert got[1].turns_sha256 == want and got[1].n_turns == 9 and got[1].loss_chars == len(loss)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[2].n_turns == 2 and got[None].n_turns == 1
    assert chat.digest(chat.parse_pieces(chat.format_turns(df.limit(0)))).count() == 0


def test_conversations_beside_null_ids_stay_apart(spark):
    rows = [(2**53, 0, "user", "a", 1), (2**53 + 1, 0, "user", "b", 2), (None, 0, "user", "c", 3), (None, 1, "user", "d", 4)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, piece long").coalesce(1).withColumn("parts", chat.text_parts(F.col("text")))
    got = {r.conv_id: r.n_turns for r in chat.digest(chat.parse_pieces(chat.format_turns(df))).collect()}
    assert got == {2**53: 1, 2**53 + 1: 1, None: 2}


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 28, 29, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", None, "o", None, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn int, role string, parts {chat.PARTS}")
    one, two = chat.format_turns(df).orderBy("turn").collect()
    assert one.piece == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|attachment|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "i.png", 6), ("audio", "a.wav", 38), ("document", "d.pdf", 768), ("odd", "o", 1)]
    assert one.attachment_tokens == 813 and two.piece == "<|im_start|>user\n<|im_end|>\n"


def test_sharding_laws(spark, odd, empty):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign(df, 40).collect()
    sizes, seen = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
        seen.setdefault(r.shard, set()).add(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert len(sizes) == 40 and max(sizes.values()) < 1.35 * min(sizes.values())
    assert all(slots == set(range(sizes[s])) for s, slots in seen.items())
    assert 0.6 < sum(r.grown_shard == 40 for r in rows) / (20_000 / 41) < 1.4
    odd_rows = sharding.assign(odd, 40).collect()
    assert len(odd_rows) == odd.count() and {r.size for r in odd_rows if r.doc_id == 3} == {16}
    assert sharding.assign(empty, 40).count() == 0


def test_a_changed_weight_moves_rows_only_into_its_subtree(spark):
    df = spark.range(5_000).select(F.col("id").alias("doc_id"))
    tree = sharding.base_tree(16)
    heavier = [(r, k, s, 2.0 if s == 3 else w) for r, k, s, w in tree]
    moved = sharding.place(sharding.place(df, tree), heavier, into="new").filter("shard <> new").collect()
    assert moved and all(r.new // 8 == 0 for r in moved)


def test_rows_of_one_key_get_the_same_slots_again(spark):
    df = spark.createDataFrame([(1, f"text {i % 7}") for i in range(40)], "doc_id long, text string")
    runs = [sorted((r.slot, r.text_crc32) for r in sharding.assign(df.repartition(n, "text"), 40).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and [s for s, _ in runs[0]] == list(range(40))


def test_slots_of_many_buckets(spark):
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("shard"))
    got = {}
    for r in sharding.slots(df, buckets=7).collect():
        got.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(1000)) for v in got.values())


def held_out_counts(spark, sf, name, column):
    """(true positives, false positives, false negatives, true negatives) of the held-out rows."""
    rows = queries.QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.predicted, r[column]): r["count"] for r in rows.groupBy("predicted", column).count().collect()}
    return [n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0))]


def test_held_out_quality_and_language(spark):
    hit, wrong, missed, none = held_out_counts(spark, SF, "op4_quality", "quality")
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97 and none / (none + wrong) > 0.9
    rows = queries.QUERIES["op6_language"](spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert rows.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_held_out_toxicity(spark):
    """A few labels of the table are wrong: rows marked as toxic without any insult."""
    hit, wrong, missed, none = held_out_counts(spark, "/root/testdata/sf0.1", "op8_toxicity", "toxic")
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.9 and none / (none + wrong) > 0.99


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    odds, change = rng.normal(size=6).tolist(), rng.normal(size=(2, 2))
    total = np.zeros(6)
    norm = 0.0
    for code in range(64):
        y = [code >> i & 1 for i in range(6)]
        w = np.exp(sum(o * v for o, v in zip(odds, y)) + sum(change[a][b] for a, b in zip(y, y[1:])))
        norm += w
        total += w * np.array(y)
    assert np.allclose(quality.marginals(odds, change), total / norm)


def test_quality_scores_equal_enumeration():
    """Features by hand, all labellings of the lines enumerated, and the logistic function."""
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=quality.LINE) * 0.1, 1 + rng.random(quality.LINE), rng.normal(size=quality.FEATURES) * 0.3, rng.normal(size=(2, 2)), np.array([-2.0, -0.5, 1.0]))
    for text in ("", None, "One line here", "A b\n\nA b\n12 ## |x| é!\nword word word word", "\n", "x\ny\nx\nx"):
        lines = (text or "").split("\n")
        x, sizes = quality.line_features(text)
        kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "#$%&*@^~<>=+_/\\{}[]", "|", "!?"]
        for line, row, size in zip(lines, x, sizes):
            raw = line.encode()
            shares = [sum(chr(b) in k for b in raw if b < 128) for k in kinds]
            shares[1] += sum(b >= 128 for b in raw)
            assert size == len(raw) and np.allclose(row[:7], np.array(shares) / max(1, len(raw))) and row[-1] == (not raw)
        z = [(r - model.mean) / model.scale for r in x]
        odds = []
        for i in range(len(lines)):
            before, after = (z[j] if 0 <= j < len(z) else np.zeros(quality.LINE) for j in (i - 1, i + 1))
            odds.append(np.concatenate([z[i], before, after, [i > 0, i + 1 < len(z), 1.0]]) @ model.emission)
        total, norm = np.zeros(len(lines)), 0.0
        for y in itertools.product((0, 1), repeat=len(lines)):
            w = math.exp(sum(o * v for o, v in zip(odds, y)) + sum(model.change[a][b] for a, b in zip(y, y[1:])))
            norm, total = norm + w, total + w * np.array(y)
        weights = np.maximum(sizes, 1)
        share = float(np.clip((total / norm) @ weights / weights.sum(), 1e-3, 1 - 1e-3))
        want = 1 / (1 + math.exp(-(-2.0 * share - 0.5 * math.log(share / (1 - share)) + 1.0)))
        assert model.score([text])[0] == pytest.approx(want)


def test_the_field_is_trained_to_its_optimum():
    """At the end the likelihood, by enumeration of all labellings, has no slope left but that of the penalty."""
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(6, 4, 3)), np.ones((6, 4))
    mask[0, 3] = mask[1, 2:] = 0
    y = (x[:, :, 0] + rng.normal(size=(6, 4)) > 0) * mask
    emission, change = quality._train(x, y, mask, np.zeros(3), np.zeros((2, 2)), 3000)

    def likelihood(params):
        e, c, out = params[:3], params[3:].reshape(2, 2), -0.5e-4 * params @ params
        for xs, ys, m in zip(x, y, mask):
            n = int(m.sum())
            odds = xs[:n] @ e
            score = lambda v: sum(o * k for o, k in zip(odds, v)) + sum(c[a][b] for a, b in zip(v, v[1:]))  # noqa: B023, E731
            out += (score(ys[:n].astype(int)) - np.log(sum(np.exp(score(v)) for v in itertools.product((0, 1), repeat=n)))) / mask.sum()
        return out

    best = np.concatenate([emission, change.ravel()])
    slope = [(likelihood(best + h) - likelihood(best - h)) / 2e-4 for h in np.eye(7) * 1e-4]
    assert np.abs(slope).max() < 2e-3


def test_labelled_rows_are_bounded_by_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    rows = fitting.labelled(docs, labels, "toxic", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0)]


def test_classifiers_of_odd_rows(spark, odd, empty, labels, no_labels):
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        for own in (labels, no_labels):
            model = module.fit(odd, own, F.lit(True))
            rows = module.score(odd, model).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows), name
            assert module.score(empty, model).count() == 0
    model = language.fit(odd, F.lit(True))
    rows = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert rows[3].lang_pred == rows[5].lang_pred == "und" and rows[3].score == 0
    assert language.identify(empty, language.fit(empty, F.lit(True))).count() == 0


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"idiot": 1.0}, {"achlich": 1.0})
    total = lambda t: np.expm1(g.features(t)[0])
    assert total("idiot here") == pytest.approx(1.0) and total("you idiot") > 1.1
    assert total("you are not idiot") < total("you idiot") and total("someone said idiot") < total("idiot here")
    assert total("kill you") > 0 == total("kill time") and total("(Idiot!) x") == pytest.approx(1.0)
    assert total("achlichung") == pytest.approx(1.0) and total("achlich xachlichung") == 0 and total("") == total(None) == 0


LANGUAGES = {"a": b"lorem ipsum dolor sit amet consectetur " * 20, "b": b"zwei drei vier funf sechs sieben acht " * 20}


SENTENCES = ["I killed him", "I am killing you", "you will be killed", "we will kill you"]


def test_grammar_reads_contractions_reports_and_threats():
    g = toxicity.Grammar({"idiot": 1.0}, {})
    total = lambda t: np.expm1(g.features(t)[0])
    plain = total("you are an idiot")
    assert total("you idiot") == plain == total("YOU'RE an idiot") > total("an idiot")
    for denied in ("you aren't an idiot", "you aren’t an idiot", "you are not an idiot"):
        assert total(denied) == pytest.approx(toxicity.NEGATED * plain)
    for told in ("he said: you are an idiot", 'he said: "you are an idiot"', "he said, «you are an idiot»", '"you are an idiot", he said'):
        assert total(told) == pytest.approx(toxicity.QUOTED * plain)
    assert total("he said nothing. you are an idiot") == plain
    assert all(total(t) > 0 for t in SENTENCES) and total("time to kill") == total("he was here. kill time") == 0


def test_clauses_weigh_as_their_rules_say():
    """The composed machine against the rules, read directly for every word."""
    g, rng = toxicity.Grammar({"idiot": 1.0, "scum": 1.5}, {"mor": 0.7}, {"wreck": 2.0}, frozenset(["folk"])), random.Random(8)
    words = "idiot scum moron mor kill wreck you folk not said a b c d e f".split()
    for _ in range(3000):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        aims = [w in ("you", "folk") for w in clause]
        total = 0.0
        for i, w in enumerate(clause):
            behind, ahead = any(aims[max(0, i - 4) : i]), aims[i + 1 : i + 5]
            weight = {"idiot": 1.0, "scum": 1.5, "moron": 0.7}.get(w, 0.0)
            if w in ("kill", "wreck") and (behind or any(ahead[:2])):
                weight = {"kill": toxicity.MENACE_WEIGHT, "wreck": 2.0}[w]
            weight *= toxicity.AIMED if behind or any(ahead) else 1.0
            weight *= toxicity.NEGATED if "not" in clause[max(0, i - 3) : i] else 1.0
            total += weight * (toxicity.QUOTED if "said" in clause else 1.0)
        assert g.clause(clause) == pytest.approx(total)


def test_threats_and_targets_are_learned(spark):
    """Toxic rows flay him or call grue drek; others flay fish, meet him, and rarely name grue."""
    rng = random.Random(1)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(600):
        kind = {0: ["flay", "him"], 4: ["grue", "drek"]}.get(i % 8) or [["flay", "fish"], ["him"], ["grue"]][(0, 1, 1, 1, 0, 1, 1, 1, 2)[i % 9]]
        own = [rng.choice(filler) for _ in range(30)]
        own[10:10] = kind
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert set(model.words) == {"drek"} and set(model.threats) == {"flay"} and model.targets == {"grue"}
    learned = model.grammar.features
    assert learned("flay them")[0] > 0 == learned("flay fish")[0] and learned("grue drek")[0] > learned("drek")[0]


def test_patterns_are_not_capped(spark):
    """More patterns than any fixed limit would hold: all that qualify are learned."""
    names = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "klmnprstvz"]
    rows = [(i, " ".join(names)) for i in range(6)] + [(i, "plain words") for i in range(6, 60)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 6)) for i in range(60)], "doc_id long, toxic int"), F.lit(True))
    assert set(names) <= set(model.words)


def test_languages_are_those_of_least_size():
    """Against a compressor that is made anew for every language and text."""
    model, rng = language.Model(LANGUAGES), random.Random(3)
    words = [w.decode() for d in LANGUAGES.values() for w in d.split()]
    for n in (1, 2, 5, 40, 3000):
        for _ in range(8):
            text = " ".join(rng.choice(words) for _ in range(n))
            sizes = []
            for name, content in LANGUAGES.items():
                both = []
                for how in ({"min_match": 4, "strategy": zstandard.STRATEGY_LAZY}, {"min_match": 3, "strategy": zstandard.STRATEGY_BTOPT, "search_log": 4, "target_length": 16}):
                    how = zstandard.ZstdCompressionParameters.from_level(6, write_content_size=False, write_checksum=False, write_dict_id=False, **how)
                    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    data.precompute_compress(compression_params=how)
                    raw = text.lower().encode()
                    both.append(sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=data).compress(raw[i : i + 8192])) for i in range(0, len(raw), 8192)))
                sizes.append((both, name))
            close = abs(sizes[0][0][0] - sizes[1][0][0]) <= 2
            want = sorted((sum(both) if close else both[0], name) for both, name in sizes)
            assert model.predict(text) == (want[0][1], (want[1][0] - want[0][0]) / want[0][0])


def test_language_margins(spark):
    model = language.Model(LANGUAGES)
    assert model.predict("dolor sit amet lorem ipsum consectetur")[0] == "a" and model.predict("sieben acht vier zwei")[0] == "b"
    assert all(model.predict(t) == ("und", 0.0) for t in ("123 !?", None, "", "½ ² Ⅷ _ ٣"))
    same = language.Model({"z": LANGUAGES["a"], "y": LANGUAGES["a"]})
    assert same.predict("dolor sit amet") == ("y", 0.0)
    df = spark.createDataFrame([(1, "dolor sit amet lorem ipsum", "x", True), (2, "qqq", None, None), (2, "qqq", None, None), (3, None, "a", True)], "doc_id long, text string, lang_pred string, rejected boolean")
    rows = sorted((r.doc_id, r.lang_pred, r.rejected) for r in language.identify(df, model).collect())
    assert rows == [(1, "a", False), (2, "a", True), (2, "a", True), (3, "und", True)]
    assert not any(r.rejected for r in language.identify(df, model, reject=0.0).collect())


def test_dictionaries_take_whole_rows_and_repeated_ones_once(spark):
    rows = [(1, "ein ganzer satz in einer sprache", "de")] * 3 + [(None, "two of the english words", "en"), (None, "one more of the english words", "en"), (5, "x" * language.DICTIONARY, "en"), (6, None, "en"), (7, "ohne sprache", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.dictionaries["de"] == b"\nein ganzer satz in einer sprache" and sorted(model.dictionaries["en"].split(b"\n")) == [b"", b"one more of the english words", b"two of the english words"]
