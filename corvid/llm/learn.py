"""Fitting small models on a bounded sample of labelled documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; of a null id as of an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, doc_id: str = "doc_id", text: str = "text", most: int = 4000) -> DataFrame:
    """``text`` and ``y`` of at most ``most`` documents of each label outside the held-out fold.

    Which they are depends on a hash of the id only. Of several labels of a document, the largest
    counts; null ids and labels don't. The sample's ids are at most twice ``most``, so they are
    broadcast; texts stay on the executors.
    """
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (fold(doc_id, folds) != held_out)).groupBy(F.col(doc_id).alias("sampled")).agg(F.max(label).cast("int").alias("y"))
    parts = [rows.where(F.col("y") == y).orderBy(F.xxhash64("sampled"), "sampled").limit(most) for y in (0, 1)]
    texts = docs.select(F.col(doc_id).alias("sampled"), F.col(text).alias("text"))
    # Few files may hold the sample; what learns from it should have all cores.
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "sampled").repartition("sampled").select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the constant last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[np.full(x.shape[1] - 1, ridge * max(len(x), 1)), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w
