"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. What speaks for a label are features of the
line and of its two neighbours (shares of kinds of characters, repetition of words
and of lines, length), and the labels of the lines beside it. The marginals of
the forward-backward recursion, weighted by the lines' lengths, give the share
of a document that is bad, and a logistic function of it the document's score.

Labels are of documents. The fit begins with each line labelled as its document,
and then twice relabels the lines of bad documents by their marginals. It looks
at all lines of a bounded sample of labelled rows; scoring reads whole texts.

Defined results: a null or empty text is one empty line; repeated rows are
scored each, and of those that share an id one is learned from; contradicting labels
of one id count as good; without labelled rows every score is a half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtext.llm.fitting import labelled, logistic, sigmoid
from loomtext.llm.kernels import give_back

#: Labelled rows that the fit looks at, at most, about; lines that the fit takes for one chain, longer texts being several.
FIT_ROWS, CHAIN = 4_000, 64
_KINDS = 8
_KIND = np.full(256, 7, np.uint8)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\v\f", "#$%&*@^~<>=+_/\\{}[]", "|", "!?"]):
    _KIND[np.frombuffer(_chars.encode(), np.uint8)] = _k
_KIND[128:] = 1
LINE = _KINDS + 6
#: Own features, those of the lines before and after, whether there are such lines, and a constant.
FEATURES = 3 * LINE + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x LINE features, their lengths in bytes) of one text."""
    lines = (text or "").split("\n")
    raw = (text or "").encode("utf-8", "replace")
    n = len(lines)
    data = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero(data == 10)
    starts, ends = np.append(0, cuts + 1), np.append(cuts, len(raw))
    sizes = ends - starts
    line_of = np.repeat(np.arange(n), np.diff(np.append(starts, len(raw))))
    counts = np.bincount(line_of * 16 + _KIND[data], minlength=16 * n).reshape(n, 16)[:, :_KINDS].astype(float) if len(raw) else np.zeros((n, _KINDS))
    counts[: len(cuts), 7] -= 1  # the newline itself
    out = np.zeros((n, LINE))
    out[:, :_KINDS] = counts / np.maximum(sizes, 1)[:, None]
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    words = [line.split() for line in lines]
    total = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    out[:, _KINDS] = counts[:, 0] / (counts[:, 0] + counts[:, 1] + 1)
    out[:, _KINDS + 1] = np.where(total >= 4, 1 - distinct / np.maximum(total, 1), 0)
    out[:, _KINDS + 2] = np.log1p(sizes) / 8
    out[:, _KINDS + 3] = np.array([math.log(seen[line]) if line else 0.0 for line in lines])
    out[:, _KINDS + 4] = np.minimum((sizes - counts[:, 3]) / np.maximum(total, 1), 40) / 10
    out[:, _KINDS + 5] = sizes == 0
    return out, sizes.astype(float)


def neighbourhood(x: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it."""
    n = len(x)
    out = np.zeros((n, FEATURES))
    out[:, :LINE] = x
    out[1:, LINE : 2 * LINE] = x[:-1]
    out[:-1, 2 * LINE : 3 * LINE] = x[1:]
    out[1:, -3] = out[:-1, -2] = 1
    out[:, -1] = 1
    return out


def marginals(odds: list[float], change: np.ndarray) -> list[float]:
    """Probability that each line is bad, by the forward-backward recursion; ``odds``: score of bad less that of good.

    Messages are kept as the log odds of bad, so no recursion underflows.
    """
    (gg, gb), (bg, bb) = np.exp(np.clip(change, -15, 15)).tolist()
    log, exp = math.log, math.exp
    forward, m = [], 0.0
    for o in odds:
        m = min(30.0, max(-30.0, m + o))
        forward.append(m)
        e = exp(m)
        m = log((gb + e * bb) / (gg + e * bg))
    out, m = [0.0] * len(odds), 0.0
    for t in range(len(odds) - 1, -1, -1):
        out[t] = 1 / (1 + exp(-min(30.0, max(-30.0, forward[t] + m))))
        e = exp(min(30.0, max(-30.0, odds[t] + m)))
        m = log((gg * 1 + gb * e) / (bg * 1 + bb * e))
        m = -m
    return out


class Model:
    def __init__(self, mean, scale, emission, change, link):
        self.mean, self.scale, self.emission, self.change, self.link = mean, scale, emission, change, link

    def bad_share(self, text: str | None) -> float:
        x, sizes = line_features(text)
        odds = (neighbourhood((x - self.mean) / self.scale) @ self.emission).tolist()
        p, weights = marginals(odds, self.change), np.maximum(sizes, 1)
        return float(np.dot(p, weights) / weights.sum())

    def score(self, texts) -> np.ndarray:
        """From 0 to 1, higher for better."""
        share = np.array([self.bad_share(t) for t in texts])
        return sigmoid(_links(share) @ self.link[:-1] + self.link[-1])


def _links(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.column_stack([share, np.log(share / (1 - share))])


def _train(x: np.ndarray, y: np.ndarray, mask: np.ndarray, emission: np.ndarray, change: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascend the conditional likelihood; sequences are padded: x (docs, lines, features), y and mask (docs, lines)."""
    n, t, _ = x.shape
    params = np.concatenate([emission, change.ravel()])
    first, second = np.zeros_like(params), np.zeros_like(params)
    pairs = mask[:, 1:] * mask[:, :-1]
    seen = np.array([[(pairs * (y[:, :-1] == a) * (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    gold = np.einsum("ntf,nt->f", x, y * mask)
    for step in range(1, rounds + 1):
        e, c = params[:-4], params[-4:].reshape(2, 2)
        odds = x @ e
        score = np.stack([np.zeros_like(odds), odds], axis=2) * mask[:, :, None]
        forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = score[:, 0]
        for k in range(1, t):
            move = np.logaddexp(forward[:, k - 1, 0, None] + c[0], forward[:, k - 1, 1, None] + c[1])
            forward[:, k] = np.where(mask[:, k, None] > 0, move + score[:, k], forward[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = backward[:, k + 1] + score[:, k + 1]
            move = np.logaddexp(c[:, 0] + ahead[:, 0, None], c[:, 1] + ahead[:, 1, None])
            backward[:, k] = np.where(mask[:, k + 1, None] > 0, move, 0)
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        bad = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * mask
        joint = forward[:, :-1, :, None] + c[None, None] + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * pairs[:, :, None, None]).sum(axis=(0, 1))
        grad = np.concatenate([gold - np.einsum("ntf,nt->f", x, bad), (seen - expected).ravel()]) / mask.sum() - 1e-4 * params
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        params = params + 0.08 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return params[:-4], params[-4:].reshape(2, 2)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, lengths = [], []
        for text in batch.column(2).to_pylist():
            x, sizes = line_features(text)
            flat.append(x.ravel().astype(np.float32))
            lengths.append(sizes.astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.float32())), pa.array(lengths, pa.list_(pa.float32()))],
            names=["doc_id", "label", "x", "sizes"],
        )


def fit(docs: DataFrame, labels: DataFrame, training, bound: int = FIT_ROWS) -> Model:
    """Learn from all lines of at most about ``bound`` labelled rows."""
    rows = labelled(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), labels, "quality", training, bound)
    found = rows.mapInArrow(_measure, "doc_id bigint, label int, x array<float>, sizes array<float>").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return Model(np.zeros(LINE), np.ones(LINE), np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(3))
    raw, sizes = ([v.values.to_numpy() for v in found.column(name)] for name in ("x", "sizes"))
    raw = [r.reshape(-1, LINE).astype(float) for r in raw]
    bad_doc = found.column("label").to_numpy() == 0
    every = np.concatenate(raw)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    own = [neighbourhood((r - mean) / scale).astype(np.float32) for r in raw]
    chains = [(d, at) for d, r in enumerate(raw) for at in range(0, len(r), CHAIN)]
    t = max(2, min(CHAIN, max(len(r) for r in raw)))
    x, mask, y = np.zeros((len(chains), t, FEATURES), np.float32), np.zeros((len(chains), t)), np.zeros((len(chains), t))
    for i, (d, at) in enumerate(chains):
        n = min(CHAIN, len(raw[d]) - at)
        x[i, :n], mask[i, :n], y[i, :n] = own[d][at : at + n], 1, bad_doc[d]
    emission, change = np.zeros(FEATURES), np.zeros((2, 2))
    for again in range(3):
        emission, change = _train(x, y, mask, emission, change, 60 if again == 0 else 30)
        p = [np.array(marginals((r @ emission).tolist(), change)) for r in own]
        if again < 2:
            for i, (d, at) in enumerate(chains):
                if bad_doc[d]:
                    here = p[d][at : at + CHAIN]
                    y[i, : len(here)] = (here > 0.5) | (here == p[d].max())
    weights = [np.maximum(s, 1) for s in sizes]
    share = np.array([float(np.dot(a, w) / w.sum()) for a, w in zip(p, weights)])
    return Model(mean, scale, emission, change, logistic(_links(share), (~bad_doc).astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Add the quality of each row's whole text; other columns pass through."""
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
