"""Toxicity by a weighted finite-state pattern grammar.

A document is cut into clauses. The lexicon maps every word of a clause to the
symbols that it carries: insult (words, and stems that stand for all words
that begin so), threat, target, negation and reported speech. A transducer that
reads the clause from its end marks words with a target or reported speech ahead. Five weighted
transducers (insult, threat, target, negation, reported speech) are composed into
one machine, which reads the marked clause from its begin: its arcs multiply the
weight of each match, more where it is aimed at a target, less where it is negated
or reported. A document's score is a logistic function of its clause weights.

The insults, further threats (words that toxic rows aim at targets and others do not),
further targets (words that gather around insults) and the logistic function are
learned from a bounded sample of labelled rows. Contractions with "not" are one word;
colons, commas and quotation marks do not end a clause, so speech is reported across them.

Defined results: null and empty texts match nothing and get the score of a
document without matches; without toxic labels nothing but the given threats matches and every score is 0.05; texts are read
whole. Repeated rows are scored each, and contradicting labels of one id count as toxic.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.llm.fitting import labelled, logistic, sigmoid
from loomtext.llm.kernels import give_back

#: Labelled rows that the fit looks at, at most, about.
FIT_ROWS = 20_000
#: Letters of a stem; log odds of toxic against other rows from which a pattern is learned.
STEM, ODDS = range(3, 9), 3.0
#: A target is so much oftener near insults than words are, and so often for each toxic row.
LIFT, TARGETED = 3.0, 0.05
TARGET = frozenset("you your youre u he him his she her they them their this these those du dich dir ihr sie er tu toi vous il ils elle elles tú usted ustedes él ella ellos".split())
NEGATION = frozenset("not no never neither nor dont isnt arent wasnt werent cannot cant wont couldnt wouldnt shouldnt doesnt didnt hasnt havent hadnt aint nicht kein keine nie ne pas jamais nunca ni".split())
REPORTED = frozenset("said says say saying told tells called calls calling wrote writes quoted quote claims claimed sagte sagt schrieb nannte dit disait appelle dijo dice llamó escribió".split())
THREAT = frozenset(
    "kill kills killed killing hurt hurts hurting destroy destroys destroyed destroying murder murders murdered murdering stab stabs stabbed stabbing "
    "shoot shoots shot shooting strangle strangles strangled strangling töten töte tötet getötet umbringen umgebracht tuer tue tué tuerai "
    "frapper frappe frappé matar mato mata matado mataré golpear golpeo golpeado".split()
)
_TABLE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_MARKS = str.maketrans("“”‘’«»¿¡—–…„", " " * 12)
_WIDE = re.compile("[“”‘’«»¿¡—–…„]")
_NOT = re.compile("(?<=n)['’](?=t(?![a-z]))")
_CLAUSE = re.compile(r"[.!?;\n]+")


def lowered(text: str) -> str:
    """The lower-cased text, with "n't" as one word with what is before it."""
    low = text.lower()
    return _NOT.sub("", low) if "'t" in low or "’t" in low else low


def spaced(low: str) -> str:
    """``low`` with every character between words as a space, of the same length."""
    low = low.encode("utf-8", "replace").translate(_TABLE).decode("utf-8")
    return low.translate(_MARKS) if _WIDE.search(low) else low


def clauses(low: str) -> list[list[str]]:
    return [spaced(c).split() for c in _CLAUSE.split(low)]


#: Symbols of a word, as bits: what the lexicon gives, the marks of the transducer from the end, and what the composed machine writes.
INSULT, THREATENING, AIM, NEGATOR, REPORT, AHEAD, SOON, TOLD, MATCH, MENACE = (1 << i for i in range(10))
#: Arc weights; words over which a target and a negation reach; least weight of a threat.
AIMED, NEGATED, QUOTED, NEAR, NEGATION_REACH, MENACE_WEIGHT = 1.3, 0.5, 0.7, 4, 3, 3.0

#: machine[state][symbols]: next state, symbols written, weight.
Machine = list[list[tuple[int, int, float]]]


def transducer(states: int, arc: Callable[[int, int], tuple[int, int, float]]) -> Machine:
    return [[arc(q, x) for x in range(MENACE << 1)] for q in range(states)]


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that hands what ``first`` writes to ``second``, of the states that can be reached; weights multiply."""
    places, out = {(0, 0): 0}, []
    todo = [(0, 0)]
    for p, q in todo:
        row = []
        for r, y, w in first[p]:
            s, z, v = second[q][y]
            if (r, s) not in places:
                places[r, s] = len(places)
                todo.append((r, s))
            row.append((places[r, s], z, w * v))
        out.append(row)
    return out


@lru_cache(maxsize=1)
def grammar_machines() -> tuple[Machine, Machine]:
    """The transducer that reads from the end, and the composition of the five that read from the begin."""
    down = lambda q: max(0, q - 1)
    aim = lambda q, x: NEAR if x & AIM else down(q)
    marks = lambda q, x: x | (AHEAD if q // 2 else 0) | (SOON if q // 2 >= NEAR - 1 else 0) | (TOLD if q % 2 else 0)
    ahead = transducer(2 * NEAR + 2, lambda q, x: (2 * aim(q // 2, x) + (1 if x & REPORT else q % 2), marks(q, x), 1.0))
    insult = transducer(1, lambda q, x: (0, x | MATCH if x & INSULT else x, 1.0))
    threat = transducer(NEAR + 1, lambda q, x: (aim(q, x), x | MATCH | MENACE if x & THREATENING and (q or x & SOON) else x, 1.0))
    target = transducer(NEAR + 1, lambda q, x: (aim(q, x), x, AIMED if x & MATCH and (q or x & AHEAD) else 1.0))
    negation = transducer(NEGATION_REACH + 1, lambda q, x: (NEGATION_REACH if x & NEGATOR else down(q), x, NEGATED if x & MATCH and q else 1.0))
    reported = transducer(2, lambda q, x: (1 if x & REPORT else q, x, QUOTED if x & MATCH and (q or x & TOLD) else 1.0))
    return ahead, reduce(compose, (insult, threat, target, negation, reported))


class Grammar:
    """The lexicon and the composed machine."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float] | None = None, targets: frozenset[str] = frozenset()):
        import ahocorasick

        self.words, self.stems = words, stems
        self.threats, self.targets = dict.fromkeys(THREAT, MENACE_WEIGHT) | (threats or {}), TARGET | targets
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(f" {w} ", len(w) + 1)
        for s in stems:
            machine.add_word(f" {s}", len(s))
        for t in self.threats:
            machine.add_word(f" {t} ", len(t) + 1)
        machine.make_automaton()
        self.machine = machine if len(machine) else None

    def insult(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n and (w := self.stems.get(word[:n])):
                best = max(best, w)
        return best

    def symbols(self, word: str, weight: float) -> int:
        if word in NEGATION:
            return NEGATOR
        if word in REPORTED:
            return REPORT
        return (INSULT if weight else 0) | (THREATENING if word in self.threats else 0) | (AIM if word in self.targets else 0)

    def clause(self, words: list[str]) -> float:
        """Weight of a clause: the sum over its matches of what their arcs multiply to."""
        ahead, forward = grammar_machines()
        weights = [self.insult(w) for w in words]
        marked = [self.symbols(w, x) for w, x in zip(words, weights)]
        q = 0
        for i in range(len(words) - 1, -1, -1):
            q, marked[i], _ = ahead[q][marked[i]]
        q, total = 0, 0.0
        for word, x, weight in zip(words, marked, weights):
            q, out, factor = forward[q][x]
            if out & MATCH:
                total += factor * (max(weight, self.threats[word]) if out & MENACE else weight)
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of the clauses that matched: total, greatest, number, and total a hundred words; logarithms of one more than each."""
        if not text or self.machine is None:
            return 0.0, 0.0, 0.0, 0.0
        low = lowered(text)
        flat = f" {spaced(low)} "
        places = [end - back for end, back in self.machine.iter(flat)]
        if not places:
            return 0.0, 0.0, 0.0, 0.0
        cuts = [m.start() + 1 for m in _CLAUSE.finditer(low)]
        scores, done = [], -1
        for place in sorted(places):
            k = bisect.bisect_right(cuts, place)
            if k == done:
                continue
            done = k
            begin, end = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(flat)
            if weight := self.clause(flat[begin:end].split()):
                scores.append(weight)
        total = sum(scores)
        return math.log1p(total), math.log1p(max(scores, default=0.0)), math.log1p(len(scores)), math.log1p(100 * total / max(20, len(flat.split())) if scores else 0.0)


class Model:
    def __init__(self, words: dict[str, float], stems: dict[str, float], threats: dict[str, float], targets: frozenset[str], weights: np.ndarray):
        self.words, self.stems, self.threats, self.targets, self.weights = words, stems, threats, targets, weights
        self._grammar = None

    def __getstate__(self):
        return self.__dict__ | {"_grammar": None}

    @property
    def grammar(self) -> Grammar:
        if self._grammar is None:
            self._grammar = Grammar(self.words, self.stems, self.threats, self.targets)
        return self._grammar

    def features(self, texts) -> np.ndarray:
        return np.array([self.grammar.features(t) for t in texts], dtype=float).reshape(len(texts), 4)

    def score(self, texts) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.weights[:-1] + self.weights[-1])


def _counted(rows: DataFrame, patterns: Callable[[str], Iterable[str]]) -> DataFrame:
    """(pattern, toxic, clean): how often the rows of either label hold each pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            names = list(seen[0] | seen[1])
            counts = [pa.array([c[n] for n in names], pa.int64()) for c in (seen[1], seen[0])]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], names=["pattern", "toxic", "clean"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[1 if label else 0].update(patterns(lowered(text or "")))
                if len(seen[0]) + len(seen[1]) > 100_000:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()
        give_back()

    return rows.mapInArrow(run, "pattern string, toxic bigint, clean bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _patterns(low: str) -> set[str]:
    """Words, stems (word and star), and words near a target, as a threat is (word and angle)."""
    words = set(spaced(low).split())
    own = set(words)
    for w in words:
        own.update([w[:n] + "*" for n in STEM if len(w) > n])
    if not words.isdisjoint(TARGET):
        for clause in clauses(low):
            for i, w in enumerate(clause):
                if w in TARGET:
                    own.update([x + ">" for x in clause[max(0, i - 2) : i] + clause[i + 1 : i + NEAR + 1] if x not in TARGET])
    return own


def _around(grammar: Grammar) -> Callable[[str], list[str]]:
    """Every word of the text, and again each that is near an insult (word and angle)."""

    def patterns(low: str) -> list[str]:
        own: list[str] = []
        for clause in clauses(low):
            own += clause
            for i, w in enumerate(clause):
                if grammar.insult(w):
                    own += [x + ">" for x in clause[max(0, i - NEAR) : i] + clause[i + 1 : i + NEAR + 1]]
        return own

    return patterns


def fit(docs: DataFrame, labels: DataFrame, training, bound: int = FIT_ROWS) -> Model:
    """Learn the lexicons and the logistic function from at most about ``bound`` labelled rows.

    A pattern is learned if enough toxic rows hold it and its odds are high, so the
    lexicons are bounded by the sample; none of those that qualify is left out.
    """
    rows = labelled(docs, labels, "toxic", training, bound).select("label", "text")
    sizes = {r.label > 0: r["count"] for r in rows.groupBy("label").count().collect()}
    n, m = sizes.get(True, 0), sizes.get(False, 0)
    model = Model({}, {}, {}, frozenset(), np.array([0.0, 0.0, 0.0, 0.0, math.log(0.05 / 0.95)]))
    if not n:
        return model  # nothing was shown to be toxic, so nothing is
    least = max(5, math.ceil(0.004 * n))  # fewer would let in words that are toxic by chance
    odds = F.log((F.col("toxic") + 0.1) / (n + 1.0)) - F.log((F.col("clean") + 0.5) / (m + 1.0))
    found = _counted(rows, _patterns).filter(F.col("toxic") >= least).withColumn("odds", odds).filter(F.col("odds") >= ODDS).collect()
    learned = {r.pattern: min(r.odds, 8.0) / 4 for r in found}
    model.words = {w: x for w, x in learned.items() if w[-1] not in "*>"}
    model.stems = {w[:-1]: x for w, x in learned.items() if w[-1] == "*"}
    # A word that is toxic anywhere is an insult; a threat is toxic where it meets a target.
    insults = Grammar(model.words, model.stems)
    model.threats = {w[:-1]: x for w, x in learned.items() if w[-1] == ">" and not insults.insult(w[:-1])}
    near = _counted(rows, _around(insults)).select(F.regexp_replace("pattern", ">$", "").alias("word"), F.endswith("pattern", F.lit(">")).alias("near"), (F.col("toxic") + F.col("clean")).alias("n"))
    sums = near.groupBy("word").agg(F.sum(F.when(F.col("near"), F.col("n"))).alias("near"), F.sum(F.when(~F.col("near"), F.col("n"))).alias("n"))
    hits, every = sums.agg(F.coalesce(F.sum("near"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = hits / max(every, 1)
    close = sums.filter((F.col("near") >= max(least, TARGETED * n)) & (F.col("near") >= LIFT * share * F.col("n"))).select("word").collect()
    model.targets = frozenset(r.word for r in close if not insults.insult(r.word) and r.word not in NEGATION | REPORTED)
    schema = StructType([StructField("label", DoubleType()), *(StructField(f"f{i}", DoubleType()) for i in range(4))])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), *(pa.array(x[:, i]) for i in range(4))], names=schema.names)

    found = rows.mapInArrow(measured, schema).toPandas().to_numpy()
    model.weights = logistic(found[:, 1:], (found[:, 0] > 0).astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the toxicity of each row's whole text; other columns pass through."""
    kept = [c for c in docs.columns if c != into]
    frame, place = docs.select(*kept), kept.index(text)
    schema = StructType([*frame.schema.fields, StructField(into, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(part.column(place).to_pylist()))], names=[*kept, into])
        give_back()

    return frame.mapInArrow(run, schema)
