"""Training rows, and linear models on sparse features; both classifiers use them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that no label is learned from; a null id is in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``doc_id, label, text`` of labelled documents outside the held-out fold, at most ``most`` of either label.

    Taken in the order of a hash of the id; a document with several labels has the greatest, one with several rows is the
    one of least text. The ids of the sample are at most ``2 * most`` rows, so they may be broadcast.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = F.xxhash64("doc_id")
    sample = known.where("label = 1").orderBy(order).limit(most).union(known.where("label = 0").orderBy(order).limit(most))
    return one_of_each_id(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "doc_id", "label").select("doc_id", "label", "text")


def one_of_each_id(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of least text of each key, combined before the shuffle: a key of very many rows is one row."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Rows of (column, value) pairs."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], minlength=self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], minlength=self.shape[1])


def descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; ``gradient`` gets the weights, the last of which is the bias."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w
