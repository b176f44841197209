"""Operators against brute force and literal cases."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import filters, html
from loomtext.functions import text as tx
from loomtext.operators import dedup, metrics, neardup, qa, sampling, translit
from loomtext.sources import readers, sinks


def lines(spark, values):
    return spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, pos long, line string")


def test_exact_lines_keep_first_and_blanks(spark):
    df = lines(spark, ["a", "b", "", "a", "", "c"])
    assert [r.line for r in dedup.exact_lines(df).orderBy("pos").collect()] == ["a", "b", "", "", "c"]
    got = dedup.line_statistics(df).first()
    assert (got.total, got.kept, got.duplicates) == (6, 3, 3)


def test_documents_are_parted_by_empty_lines_only(spark):
    df = spark.createDataFrame([(0, "x\ny\n\n\n\nx\ny\n\nz"), (1, "a\n \nb"), (2, "\n\n")], "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in readers.split_documents(df, key="doc_id").orderBy("doc_id", "pos").collect()]
    assert got == [(0, "x\ny"), (0, "x\ny"), (0, "z"), (1, "a\n \nb")]


@pytest.mark.parametrize(
    ("text", "k", "want"),
    [("a b c d e f", 5, {"a b c d e", "b c d e f"}), ("ab cd", 5, {"abcd"}), ("abcdef", 5, {"abcde", "bcdef"})],
)
def test_shingles(spark, text, k, want):
    got = spark.createDataFrame([(text,)], "t string").select(neardup.shingles("t", k).alias("s")).first().s
    assert set(got) == want and len(got) == len(want)


def greedy(n, buckets):
    kept = set()
    for i in range(n):
        if not any(i in b and kept & b for b in buckets):
            kept.add(i)
    return kept


def test_greedy_rounds_equal_a_sequential_scan(spark):
    rng = random.Random(1)
    for n, m, most in ((3, 2, 2), (12, 14, 2), (30, 60, 2), (40, 12, 9)):
        buckets = [{0, 1}, {1, 2}] if n == 3 else [set(rng.sample(range(n), rng.randint(2, most))) for _ in range(m)]
        members = [(i, k) for k, b in enumerate(buckets) for i in b]
        got = neardup.greedy_kept(spark.range(n), spark.createDataFrame(members, "id long, bucket long"))
        assert {r.id for r in got.collect()} == greedy(n, buckets)


def test_near_dup_keeps_short_lines_and_drops_copies(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = lines(spark, ["same", "same", words, words, " ".join(f"v{i}" for i in range(30)), ""]).select("pos", "line")
    assert [r.pos for r in neardup.near_dup(df).orderBy("pos").collect()] == [0, 1, 2, 4]


def test_band_plan_follows_the_published_criterion():
    assert neardup.plan_bands(0.7) == (25, 10)


def test_look_back_equals_a_sequential_loop(spark):
    rng = random.Random(2)
    base = ["the quick brown fox jumps", "a wholly different line here", "numbers one two three four"]
    rows = [(rng.choice("ab"), i, rng.choice(base) + rng.choice(["", "!", " x", " yes"])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, pos long, line string")
    want = []
    for key in "ab":
        kept = []
        for k, pos, line in rows:
            if k == key and line not in kept and not any(max(SequenceMatcher(None, line, o).ratio(), SequenceMatcher(None, o, line).ratio()) >= 0.7 for o in kept[-50:]):
                kept.append(line)
                want.append((k, pos))
    assert sorted((r.k, r.pos) for r in neardup.look_back(df, ["k"], ["pos"]).collect()) == sorted(want)


@pytest.mark.parametrize(("share", "tail"), [(0.0, 9), (0.1, 0), (0.5, 0), (0.5, 20), (0.9, 9), (0.9, 1000), (2.0, 9)])
def test_byte_budget_is_first_fit(spark, monkeypatch, share, tail):
    monkeypatch.setattr(sampling, "TAIL_ROWS", tail)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "x" * rng.randint(0, 80)) for i in range(60)], "doc_id long, text string")
    sized = docs.select("doc_id", (F.octet_length("text") + 2).alias("size"), sampling.seeded(42, "doc_id").alias("o")).collect()
    total = sum(r.size for r in sized)
    left = budget = int(total * share)
    want = set()
    for r in sorted(sized, key=lambda r: (r.o, r.doc_id)):
        if total <= budget or r.size <= left:
            want.add(r.doc_id)
            left -= r.size
    assert {r.doc_id for r in sampling.byte_budget(docs, budget).collect()} == want


def test_running_total_and_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k long")
    got = {r.k: (r.running, r.n) for r in sampling.numbered(sampling.running_total(df, F.col("k"), ["k"]), ["k"]).collect()}
    assert got == {k: (k * (k + 1) // 2, k + 1) for k in range(50)}


@pytest.mark.parametrize(("word", "want"), [("abc", "latin"), ("12a", "latin"), ("12", "digit"), ("१२", "dev_digit"), ("नेपाल", "devanagari"), ("।", "devanagari"), ("!", "other")])
def test_word_class(spark, word, want):
    assert spark.range(1).select(filters.word_class(F.lit(word)).alias("c")).first().c == want


def test_unicode_spaces_count_as_spaces(spark):
    df = spark.createDataFrame([("  a b c\t",)], "t string")
    got = df.select(tx.strip("t").alias("s"), tx.words("t").alias("w"), tx.n_words("t").alias("n")).first()
    assert (got.s, got.w, got.n) == ("a b c", ["a", "b", "c"], 3)


def test_normal_form_of_combining_marks(spark):
    df = spark.createDataFrame([("é",), ("plain",), (None,)], "t string")
    assert [r.n for r in df.select(tx.normal_form("t").alias("n")).collect()] == ["é", "plain", None]


def test_escapes_read_back_in_one_pass(spark):
    values = ["a\tb", "a\nb", "a\\b", "end\\", "\\t", "\\\\n"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r.b for r in df.select(tx.unescape_tsv(tx.escape_tsv("t")).alias("b")).collect()] == values
    assert spark.range(1).select(tx.unescape_tsv(F.lit("\\x")).alias("b")).first().b == "\\x"


def test_chat_cleaner(spark):
    df = spark.createDataFrame([("5 hello &amp; <b>hi</b> https://x.y/z @you wow!!! 😀",)], "t string")
    assert df.select(filters.clean_chat("t").alias("c")).first().c == "hello hi wow!"


GOLD = {"बस": "basa", "बस्": "bas\\", "कर्म": "karma", "कृपा": "kri^paa", "क्षेत्र": "kshetra", "षड्यन्त्र": "ShaDyantra", "ॐ": "om"}


@pytest.mark.parametrize(("native", "roman"), GOLD.items())
def test_transliteration(native, roman):
    assert translit.to_roman(native) == roman
    if native != "बस":
        assert translit.to_devanagari(roman) == native
    assert translit.to_devanagari("pratishat/ko") == "प्रतिशत्को"


def test_mixed_text_keeps_english_and_loanwords():
    assert translit.mixed_to_roman("फाइनल http://a.b ok\n\n  \nस्कुलमा") == "final http://a.b ok\n\n\nschoolmaa"


def test_html_and_markdown_text():
    assert html.html_text("<div><p>a<br>b</p></div>c") == "a\n\n\n\nb\n\n\n\n\nc".replace("\n\n\n\n\n", "\n\n").replace("\n\n\n\n", "\n\n")
    assert html.markdown_text("# T\n\n*x* [y](u)").split() == ["T", "x", "y"]
    assert html.html_text(None) == ""


def test_sample_issues(spark):
    rows = [("unavailable", "q", "x" * 60), ("answerable", "q", "abcd"), ("multi_part", "a? b?", "x" * 49), ("answerable", "q", qa.REFUSAL), ("unavailable", "q", qa.REFUSAL), ("answerable", "q", None)]
    df = spark.createDataFrame(rows, "k string, q string, a string")
    got = [set(r.i) for r in df.select(qa.issues("k", "q", "a").alias("i")).collect()]
    assert got == [{"refusal_not_exact", "answer_to_unavailable"}, {"too_short"}, {"multi_part_too_short"}, {"refusal_of_wrong_type"}, set(), {"too_short"}]


def test_model_calls_are_retried_and_matched(spark):
    def model(prompts):
        return [None if "bad" in p else p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "prompt string")
    assert [r.reply for r in qa.ask(df, model, size=2).collect()] == ["A", None, "C"]


def test_boundary_scores(spark):
    rows = [(["ab", "cd"], ["ab", "cd"]), (["abcd"], ["ab", "cd"])]
    df = spark.createDataFrame(rows, "p array<string>, g array<string>")
    assert [tuple(r.s) for r in df.select(metrics.boundary_scores("p", "g").alias("s")).collect()] == [(1, 1, 1), (0, 0, 0)]


def test_cost_of_a_million_tokens(spark):
    assert qa.costs(spark.createDataFrame([(0, 10**6, 10**6)], "idx long, prompt_tokens long, completion_tokens long")).first().cost == pytest.approx(0.70)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_bytes("caf\xe9\r\nb\n\nc\n".encode("latin-1"))
    (tmp_path / "in" / "2.txt").write_text("x\ny\n\n\nz", encoding="utf-8")
    path = f"file://{tmp_path}"
    got = [(r.pos, r.line) for r in readers.lines(spark, f"{path}/in", "latin-1").filter("file like '%0.txt'").orderBy("pos").collect()]
    assert got == [(0, "café"), (1, "b"), (2, ""), (3, "c")]
    found, missing = readers.numbered_files(spark, f"{path}/in", 3)
    assert {r.number for r in found.collect()} == {0, 2} and [r.number for r in missing.collect()] == [1]
    assert sorted(r.text for r in readers.documents(spark, f"{path}/in", "latin-1").collect()) == ["c", "café\nb", "x\ny", "z"]
    sinks.write_lines(lines(spark, ["p", "q"]), f"{path}/out")
    assert sorted(r.value for r in spark.read.text(f"{path}/out").collect()) == ["p", "q"]
    for i in (2, 10, 1):
        sinks.checkpoint_batch(lines(spark, ["p"]), f"{path}/batches", i)
    assert sinks.prune_batches(spark, f"{path}/batches", 2) == [2, 10]


def test_streaming_dedup_equals_batch(spark, tmp_path):
    from loomtext.streaming import streams

    data = lines(spark, ["a", "b", "", "a", "", "c"])
    data.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/in")
    query = streams.first_occurrences(stream).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.line for r in spark.table("seen").collect()) == ["", "", "a", "b", "c"]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="क ख ग ा ि ् ं a b".replace(" ", "") + " ", max_size=12))
def test_romanisation_never_fails(text):
    assert isinstance(translit.to_devanagari(translit.to_roman(text)), str)


def test_human_size_query_keeps_long_documents(spark, tmp_path):
    from loomtext.plans import registry

    rows = [(1, "a" * 1023), (2, "a" * 1024), (3, "a" * 1048575), (4, "a" * 1048576), (5, "é" * 1310720), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.size for r in registry.QUERIES["n21_human_size"](spark, str(tmp_path)).collect()}
    assert got == {1: "1023.0 B", 2: "1.0 KB", 3: "1024.0 KB", 4: "1.0 MB", 5: "2.5 MB", 7: "0.0 B"}


def test_null_keys_are_rows_like_others(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "a"), (3, "c")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in dedup.exact_documents(df).collect()))) == ["1", "3", "None"]
    # Each costs a byte and two.
    assert sampling.byte_budget(df, 6).count() == 2 and sampling.byte_budget(df, 9).count() == 3
    assert any(r.doc_id is None for n in range(1, 30) for r in sampling.byte_budget(df, 6, seed=n).collect())


def test_look_back_tells_lines_apart_by_content(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["one line of words", "quite another thing", "one line of words"])], "file string, pos int, line string")
    assert [r.pos for r in neardup.look_back(lines, ["file"], ["pos"]).collect()] == [0, 1]


def test_templates_are_filled_by_type_context_and_places():
    ask = lambda t, kind, context, **e: qa.filled(t, kind, context, "विषय", e)
    assert ask("{} को दर?", "answerable", "numerical", thing="ऋण") == "ऋण को ब्याजदर को दर?"
    assert ask("{} रकम?", "answerable", "numerical") == "विषय को न्यूनतम रकम रकम?" and ask("{}?", "answerable", "numerical") == "विषय?"
    assert ask("{} {}", "answerable", "numerical", rate="५%") == "विषय ५%" and ask("{} {} {}", "answerable", "procedural", thing="क") == "क विषय विषय"
    assert ask("कागजात {}", "answerable", "procedural") == "कागजात विषय अपडेट" and ask("{}", "answerable", "procedural") == "विषय सक्रिय"
    assert ask("{} भन्दा बढी", "answerable", "conditional") == "निश्चित रकम भन्दा बढी" and ask("{} {}", "answerable", "conditional", threshold="१०") == "विषय १०"
    assert ask("{} {}", "answerable", "comparative") == "पहिलो दोस्रो" and ask("{} {} {}", "answerable", "comparative") == "पहिलो पहिलो पहिलो"
    assert ask("{} {} {}", "multi_part", "conditional") == "सीमा कागजात विषय" and ask("{} {} {}", "multi_part", "numerical") == "विषय दर जरिवाना"
    assert ask("{} {} {} {}", "multi_part", "comparative") == "बचत खाता ब्याजदर चल्ती खाता ब्याजदर" and ask("{} {}", "short_learning", "any", term="पद") == "पद पद"
    assert ask("{} {}", "unavailable", "any") == "विषय विषय" and ask("{} {}", "other", "any") == "विषय विषय" and ask("none", "multi_part", "numerical") == "none"


def test_shingle_hashes_tell_the_same_shingles_apart(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  c\n\t") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["नेपाल " * 7, "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", neardup.shingles("t", 3).alias("s")).collect()
    own, seen = neardup._Shingles(3, most=5), {}
    for r in rows:
        assert len(own(r.t)) == len(set(r.s))
        assert seen.setdefault(frozenset(r.s), tuple(own(r.t))) == tuple(own(r.t))


def test_full_is_exact_and_then_near(spark):
    base = [f"word{i} word{i + 1} of a line that is long enough to be compared" for i in range(0, 60, 7)]
    rows = [(i, x) for i, x in enumerate([*base, *base[:3], *(b + " indeed" for b in base[:4]), "short", "short", "tiny", ""])]
    df = spark.createDataFrame([("f", i, x) for i, x in rows], "file string, pos long, line string")
    exact = dedup.exact_lines(df.filter("line <> ''"))
    near = neardup.near_dup(exact.withColumn("id", F.col("pos")), "id", "line")
    got = {r.pos for r in neardup.full(df).collect()}
    assert got == {r.pos for r in near.collect()} and {r.line for r in neardup.full(df).collect()} >= {"short", "tiny"} and len(got) <= exact.count()


def test_tricky_questions_of_the_first_contexts(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["a", "b", "a", " ", None, "c", "d"])], "i int, input string")
    model = lambda ps: ["sure: [" + ",".join('{"input": "%s%d", "output": "y"}' % (p[-1], k) for k in range(2)) + "]" if p[-1] != "b" else "no" for p in ps]  # noqa: E731, UP031
    got = sorted((r.context, r.sample.input) for r in qa.tricky(df, model, ["i"], each=2).collect())
    assert got == [("a", "a0"), ("a", "a1"), ("c", "c0"), ("c", "c1")]


def test_chat_cleaner_equals_its_steps_in_python(spark):
    import re

    from loomtext.functions import fixed as fx

    emoji = re.compile("[\U0001F600-\U0001F64F\U0001F300-\U0001F5FF\U0001F680-\U0001F6FF\U0001F1E0-\U0001F1FF\u2702-\u27B0\u24C2-\U0001F251\U0001F900-\U0001F9FF\U0001FA70-\U0001FAFF]+")

    def clean(line):
        for pattern, new in fx.ENTITIES:
            line = re.sub(pattern, new, line)
        line = emoji.sub("", line)
        for pattern in fx.LINKS:
            line = re.sub(pattern, "", line)
        for phrase in fx.PROMOTION:
            line = re.sub(phrase, "", line, flags=re.IGNORECASE)
        for pattern in fx.NOISE:
            line = re.sub(pattern, "", line)
        line = re.sub(r"[^\w\s\u0900-\u097F.,!?;:()\-'\"]+", "", line)
        line = re.sub(r"([!?])\1+", r"\1", re.sub(r"\.{2,}", "", line))
        return re.sub(r"\s+", " ", re.sub(r"^[.\s]+|[.\s]+$", "", line)).strip()

    rng = random.Random(6)
    parts = ["hello", "नमस्ते", "ha ", "haha", "lol", "&quot;", "&#39;", "&x;", "😀", "https://a.b/c", "www.x.y", "see a.com/x", "<b>", "a href=x", "12:30", "@me", "Please Subscribe", "also", "ra", "br", "...", "!!", "??", "12 ", "x" * 22, "_", "#", "é", "\x1c", "\xa0", "(", ")"]
    lines = [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    for r in df.select("t", filters.clean_chat("t").alias("c")).collect():
        assert r.c == clean(r.t), ascii(r.t)


def test_patterns_match_as_each_by_itself(spark):
    """The joined pattern against every pattern tried by itself with Java's flags for either case."""
    from loomtext.functions import fixed

    lists = [fixed.KEYWORDS, fixed.SPAM, fixed.FILLER, *fixed.LISTENER.values(), fixed.REACTION, fixed.VAGUE, fixed.DEVOTIONAL, *fixed.LOW_CONTENT.values()]
    rng = random.Random(5)
    parts = [w for ps in lists for p in ps for w in p.replace("\\b", "").replace("^", "").replace("\\s+", " ").replace("\\s*", "").strip("()").split("|")]
    odd = str.maketrans({"i": "İ", "k": "K", "s": "ſ"})
    texts = [rng.choice(["", " ", "x", "_", "ा", "\n", "1"]) + rng.choice([str, str.upper, str.title, lambda t: t.translate(odd)])(w) + rng.choice(["", " ", "y", "-", "े"]) + rng.choice(parts) for w in parts * 3]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    edge = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
    plain = lambda p: p.replace("\\b", edge).replace("\\w", "[\\p{L}\\p{N}_]").replace("\\s", f"[{tx.WS}]")
    for ps in lists:
        got = rows.select(tx.any_match("t", ps).alias("a"), F.array(*[F.col("t").rlike(f"(?iu){plain(p)}") for p in ps]).alias("b")).collect()
        assert [r.a for r in got] == [any(r.b) for r in got] and any(r.a for r in got)


def test_a_long_word_is_searched_once_and_the_chat_chain_runs_once(spark):
    """A link needs no second look at a word, and no filter takes the cleaner's chain once more."""
    import time

    df = spark.createDataFrame([("nepal " + "a." * 60_000 + "x see b.com/x here a.b.org/y/z.net/w .com/q",)], "line string")
    began = time.time()
    assert df.select(filters.clean_chat("line").alias("c")).first().c.endswith("see here .comq")
    assert time.time() - began < 20
    plan = filters.cleaned_chat(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("video mann parey maa like") == 1


def test_chat_cleaner_equals_its_steps_one_by_one(spark):
    """Groups of steps that are left out where nothing of theirs is in the text."""
    import re as _re

    from loomtext.functions import fixed

    rng = random.Random(6)
    parts = ["&amp;", "&lt;b&gt;", "&quot;x", "&#39", "&nbsp;", "😀", "é", "https://a.b/c", "x.com/y", ".com/z", "a.io/b.org/c", "<b>", "</i", "a href=x", "HREF = 'q'", "br", "A" * 21, "12:30", "@you", "@", "Subscribe", "like", "share", "press", "bell icon", "Follow me on", "check out my", "ha", "haha", "lol", "also", "ra", "..", "!!", "??", "…", "नमस्ते", "7", "word", ",", "\t", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    w, d, ws = r"\p{L}\p{N}_", r"\p{Nd}", tx.WS
    edge = f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))"

    def plain(p):
        inside = lambda m: _re.sub(r"\\[swd]", lambda x: {"\\s": ws, "\\w": w, "\\d": d}[x[0]], m[0])
        p = _re.sub(r"\[(?:\\.|[^\]\\])*\]", inside, p)
        return p.replace("\\b", edge).replace("\\S", f"[^{ws}]").replace("\\s", f"[{ws}]").replace("\\d", f"[{d}]")

    steps = [*((plain(p), n) for p, n in fixed.ENTITIES), (fixed.EMOJI, ""), *((plain(p), "") for p in fixed.LINKS), *((f"(?iu){p}", "") for p in fixed.PROMOTION), *((plain(p), "") for p in fixed.NOISE)]
    steps += [(plain(rf"[^\w\s{tx.DEVANAGARI}.,!?;:()\-'\"]+"), ""), (r"\.{2,}", ""), (r"([!?])\1+", "$1"), (f"^[.{ws}]+|[.{ws}]+$", ""), (f"[{ws}]+", " "), (f"^[{ws}]+|[{ws}]+$", "")]
    naive = F.col("t")
    for pattern, new in steps:
        naive = F.regexp_replace(naive, pattern, new)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", filters.clean_chat("t").alias("a"), naive.alias("b")).collect()
    assert [(r.t, r.a) for r in rows] == [(r.t, r.b) for r in rows]


def test_spacing_of_every_kind(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "bc", "é", "क", " ", " ", "  ", "\t", " ", "　", "\x85", " ", "\x1c", "😀"]) for _ in range(rng.randint(0, 8))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.words("t").alias("w"), tx.n_words("t").alias("n"), tx.flatten("t").alias("f"), tx.strip("t").alias("s")).collect()
    assert all((r.w, r.n, r.f, r.s) == (r.t.split(), len(r.t.split()), " ".join(r.t.split()), r.t.strip()) for r in rows)


def test_likeness_is_difflibs_and_bounds_come_first(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abAB é") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    for sides, near in ((1, neardup.alike(0.7)), (2, neardup.alike(0.7, 2))):
        assert all(near(a, b) == (ratio(a, b) >= 0.7 or sides == 2 and ratio(b, a) >= 0.7) for a in texts for b in texts)
    monkeypatch.setattr(neardup, "SequenceMatcher", lambda *a: pytest.fail("a matcher is set up for lines that cannot be alike"))
    near = neardup.alike(0.7, 2)
    assert not near("a" * 10, "a" * 100) and not near("abcdef", "uvwxyz") and not near("abcdefgh", "hgfedcba")
