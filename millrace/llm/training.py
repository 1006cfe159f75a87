"""Labelled samples for the classifiers, and the calibration of their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


#: Characters of a sample's texts, but for the last one's.
SAMPLE_CHARS = 100_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, most_chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """(texts, labels) of at most ``most`` labelled documents for which ``keep`` holds.

    The sample is bounded by ``most`` rows, and by ``most_chars`` characters before its last text, for any corpus. It
    is the same for the same rows: those whose ids have the smallest hashes. A document with more than one label
    counts by the largest; null labels don't count. Only ids are ordered; the texts of the chosen ids alone come to
    the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    some = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    # These are ``most`` rows at most, so one task can order them.
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = some.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < most_chars).select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: r["doc_id"])
    found = np.array([r["label"] for r in rows], np.int64)
    return [r["text"] for r in rows], found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def calibrated(margin: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * margin + b) fits the labels: a logistic regression by Newton's method."""
    if not len(label) or label.min() == label.max():
        return 1.0, 0.0
    centre, scale = float(margin.mean()), float(margin.std()) or 1.0
    x = np.stack([(margin - centre) / scale, np.ones(len(margin))], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - label) + 1e-2 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale)
