"""Quality by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled text is a sample of all documents, whatever their labels. The class
prior is estimated from both alone: a first classifier of trusted against unlabelled text ranks rows it was not
fitted on, and the least ratio of unlabelled to trusted rows above a score bounds the share of positives. The
classifier then minimises the non-negative unbiased risk
``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])`` with the logistic loss.

It is additive: each measure of a text (shape of words and lines, symbols, repetition) is cut into bins and has
a weight per bin. It is fitted on at most ``MOST`` rows of either kind outside the held-out fold; scoring reads every
document whole. Results for odd input: a null or empty text has the measures of an empty one; a null ``doc_id`` counts
as held out; without trusted rows every score is 0.5; repeated rows get equal scores; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsdesk.llm import arrays
from newsdesk.llm.labelled import Sparse, descend, held_out, one_of_each_id, sigmoid, training_rows
from newsdesk.llm.storage import documents, table

MOST = 20_000
BINS = 24
THRESHOLD = 0.5

LINE = np.zeros(256, bool)
LINE[[10, 13]] = True
KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256)}
KINDS |= {"stop": b".,;:?\"'()-", "shout": b"!", "symbol": b"#$%&*@^~<>{}[]|\\/_=+`"}


def _share(rows: np.ndarray, weight: np.ndarray, n: int, of: np.ndarray) -> np.ndarray:
    return np.bincount(rows, weight, minlength=n) / np.maximum(of, 1)


def _again(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each (row, key) stood before, and how often it stands in all."""
    _, first, at, times = np.unique(arrays.mix(keys ^ (rows.astype(np.uint64) * np.uint64(arrays.BYTE_BASE))), return_index=True, return_inverse=True, return_counts=True)
    new = np.zeros(len(keys), bool)
    new[first] = True
    return ~new, times[at]


def measures(text: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    raw, off = arrays.byte_view(text)
    n, size = len(text), np.diff(off)
    words = arrays.Words(raw, off, False)
    count = np.diff(words.bounds)
    out = [np.log1p(count)]
    byte_row = np.repeat(np.arange(n), size)
    inked = _share(byte_row, ~arrays.SPACE[raw], n, np.ones(n))
    flags = {}
    for name, values in KINDS.items():
        kind = np.zeros(256, bool)
        kind[list(values)] = True
        flags[name] = kind[raw]
        out.append(_share(byte_row, flags[name], n, inked))
    length = words.end - words.start
    out.append(_share(words.row, length, n, count))
    out.append(_share(words.row, length == 1, n, count))
    out.append(_share(words.row, length > 18, n, count))
    marks = np.concatenate([[0], np.cumsum(flags["symbol"] | flags["shout"] | flags["digit"])])
    out.append(_share(words.row, marks[words.end] > marks[words.start], n, count))
    capitals = np.concatenate([[0], np.cumsum(flags["upper"])])
    out.append(_share(words.row, (capitals[words.end] - capitals[words.start] > 1), n, count))
    again, times = _again(words.row, words.hashes())
    out.append(_share(words.row, again, n, count))
    most = np.zeros(n)
    np.maximum.at(most, words.row, times)
    out.append(most / np.maximum(count, 1))
    for size_of_run in (2, 5):
        hashes, at = words.windows(size_of_run)
        again, _ = _again(words.row[at], hashes)
        out.append(_share(words.row[at], again, n, np.bincount(words.row[at], minlength=n)))
    lines = arrays.Words(raw, off, False, LINE)
    again, _ = _again(lines.row, lines.hashes())
    out.append(_share(lines.row, (lines.end - lines.start) * again, n, size))
    out.append(count / np.maximum(np.diff(lines.bounds), 1))
    stop = np.isin(raw[lines.end - 1], np.frombuffer(b".!?", np.uint8)) if len(lines) else np.zeros(0, bool)
    out.append(_share(lines.row, stop, n, np.diff(lines.bounds)))
    return np.stack(out, axis=1)


WIDTH = 2 + len(KINDS) + 11


class Model:
    """Cuts of each measure, a weight for each bin, and a bias."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray):
        self.cuts, self.weights = cuts, weights

    def columns(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[j], x[:, j], side="right") + j * (BINS + 1) for j in range(x.shape[1])], axis=1)

    def raw_score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.columns(x)].sum(1) + self.weights[-1]

    def score(self, text: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(text), 0.5)
        return sigmoid(self.raw_score(measures(text)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            x = measures(piece.column("text"))
            lists = arrays.list_array(x.ravel(), np.arange(len(x) + 1) * x.shape[1], pa.float64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], names=["doc_id", "x"])


def _matrix(rows: DataFrame) -> np.ndarray:
    found = rows.select("doc_id", "text").mapInArrow(_measured, "doc_id long, x array<double>").toArrow().sort_by("doc_id")
    return found.column("x").combine_chunks().flatten().to_numpy().reshape(found.num_rows, WIDTH)


def class_prior(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the share of unlabelled to that of trusted rows above a score, where both are many."""
    cuts = np.quantile(trusted, np.linspace(0.02, 0.7, 60))
    above = lambda x: (x[None] >= cuts[:, None]).mean(1)
    p, u = above(trusted), above(unlabelled)
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(trusted)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def threshold(trusted: np.ndarray, unlabelled: np.ndarray) -> float:
    """The cut that parts the share of trusted rows above it from that of unlabelled ones the most.

    That difference is the true rate less the false one, times the share of negatives, so no negatives need be known.
    Of the cuts that do as well but for chance, one near the lowest: in doubt a document stays.
    """
    cuts = np.unique(np.quantile(np.concatenate([trusted, unlabelled]), np.linspace(0, 0.7, 701)))
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    gain = above(trusted) - above(unlabelled)
    good = cuts[gain >= gain.max() - 0.002 - 0.5 / np.sqrt(min(len(trusted), len(unlabelled)))]
    return float(good.min() + (good.max() - good.min()) / 4)


def _sparse(columns: np.ndarray, size: int) -> Sparse:
    rows = np.repeat(np.arange(len(columns)), columns.shape[1])
    return Sparse(rows, columns.ravel(), np.ones(columns.size), (len(columns), size))


def risk_gradient(p: Sparse, u: Sparse, prior: float, ridge: float):
    """Gradient of the non-negative risk; where the part of the negatives falls below zero, only that part is raised."""

    def gradient(w: np.ndarray) -> np.ndarray:
        gp, gu = p.dot(w[:-1]) + w[-1], u.dot(w[:-1]) + w[-1]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp, du = sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        of_negative = np.append(u.back(du) - prior * p.back(dp), du.sum() - prior * dp.sum())
        penalty = np.append(ridge * w[:-1], 0)
        if negative < 0:
            return penalty - of_negative
        loss = (sigmoid(gp) - 1) / len(gp)
        return of_negative + prior * np.append(p.back(loss), loss.sum()) + penalty

    return gradient


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    p = _matrix(training_rows(docs, labels.where("quality = 1"), "quality", most))
    if len(p) < 10:
        return Model(np.zeros((0, 0)), np.zeros(0))
    share = docs.where(~held_out()).agg(F.count("*")).first()[0]
    # A hash of the id draws about ``most`` rows at most, one of each id; which ones does not depend on how the table is cut.
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("web")), F.lit(1 << 30)) * F.lit(float(share)) < F.lit(float(most) * (1 << 30))
    u = _matrix(one_of_each_id(docs.where(~held_out() & drawn), "doc_id"))
    cuts = np.quantile(np.concatenate([p, u]), np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    model = Model(cuts, np.zeros(0))
    size = WIDTH * (BINS + 1)
    cp, cu = model.columns(p), model.columns(u)

    def fold(a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Scores of trusted against unlabelled rows, by weights fitted on the others."""
        sp, su = _sparse(cp[a], size), _sparse(cu[a], size)

        def gradient(w: np.ndarray) -> np.ndarray:
            gp, gu = (sigmoid(sp.dot(w[:-1]) + w[-1]) - 1) / len(cp[a]), sigmoid(su.dot(w[:-1]) + w[-1]) / len(cu[a])
            return np.append(sp.back(gp) + su.back(gu) + 1e-3 * w[:-1], gp.sum() + gu.sum())

        w = descend(gradient, size + 1, 150, 0.05)
        return w[cp[b]].sum(1), w[cu[b]].sum(1)

    halves = slice(0, None, 2), slice(1, None, 2)
    folds = [fold(*halves), fold(*halves[::-1])]
    prior = float(np.mean([class_prior(*x) for x in folds]))
    w = descend(risk_gradient(_sparse(cp, size), _sparse(cu, size), prior, 1e-4), size + 1, 400, 0.05)
    w[-1] = -threshold(w[cp].sum(1), w[cu].sum(1))
    return Model(cuts, w)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            score = pa.array(model.score(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*piece.columns, score], names=[*piece.schema.names, "score"])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text`` of ``docs`` with ``score``."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(partial(_scored, model=model), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def _kept(batches: Iterator[pa.RecordBatch], model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            yield piece.filter(pa.array(model.score(piece.column("text")) >= threshold))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that the model does not reject."""
    return docs.mapInArrow(partial(_kept, model=model, threshold=threshold), docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
