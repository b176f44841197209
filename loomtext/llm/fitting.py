"""Bounded, deterministic training samples, and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.session import materialise


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, training: Column, bound: int) -> DataFrame:
    """(doc_id, label, text) of about ``bound`` labelled training rows at most, chosen by the hash of doc_id.

    The sampled labels are bounded by construction, so they are broadcast and
    the documents are only scanned. Contradicting labels count as their maximum; of
    documents that share a doc_id one is taken, that of least hash. The sample is written.
    """
    rows = labels.select("doc_id", F.col(target).cast("int").alias("label")).filter(training & F.col("label").isNotNull())
    share = bound / max(rows.count(), bound)
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)) < int(share * (1 << 24)))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    one = found.groupBy("doc_id").agg(F.max("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return materialise(one.select("doc_id", "label", F.col("first")["text"].alias("text")), "sample")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep * len(y) / 100), x.T @ (y - p) - keep * len(y) / 100 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w
