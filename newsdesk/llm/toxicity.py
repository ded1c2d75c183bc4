"""Toxicity by weak supervision.

Voters look at the words of a document: each term of a lexicon that is mined from the training rows, lexicons of
insults, and patterns of shouting and address. A generative label model learns how often each votes in either class,
starting from the trusted labels (themselves a voter of estimated accuracy) and refined by expectation
maximisation; voters that agree more than their accuracies explain share their weight. A linear classifier learns
the model's posteriors from term counts, and it alone scores documents.

The model is fitted on at most ``MOST`` labelled rows of either label outside the held-out fold; scoring reads every
document whole. Results for odd input: a null or empty text has no terms and the score of an empty document; a null
``doc_id`` counts as held out; without training rows of both labels every score is 0; repeated rows get equal
scores; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from newsdesk.llm import arrays
from newsdesk.llm.labelled import Sparse, descend, held_out, sigmoid, training_rows
from newsdesk.llm.storage import documents, table, written

MOST = 10_000
TERMS, VOTERS = 4096, 256
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

# Common insults by language: lexicon voters, beside the mined ones.
INSULTS = {
    "en": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb fool jerk imbecile bastard bitch asshole",
    "de": "idiot dummkopf trottel abschaum versager arschloch widerlich wertlos müll depp",
    "fr": "idiot imbécile crétin débile ordure minable dégoûtant connard salaud abruti",
    "es": "idiota imbécil estúpido basura inútil asqueroso patético payaso cabrón tonto",
}

LETTER = np.ones(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(0x80, 256)]] = False


def terms(text: pa.Array) -> tuple[arrays.Words, np.ndarray, np.ndarray]:
    """The lower-case words of letters; row and hash of every word and of the beginnings of longer ones."""
    raw, off = arrays.byte_view(pc.utf8_lower(pc.fill_null(text, "")))
    words = arrays.Words(raw, off, False, LETTER)
    prefix = arrays.prefix_hash(words.raw, arrays.BYTE_POWERS)
    rows, hashes = [words.row], [arrays.range_hash(prefix, words.start, words.end, arrays.BYTE_POWERS)]
    for n in PREFIXES:
        long = np.flatnonzero(words.end - words.start > n)
        rows.append(words.row[long])
        hashes.append(arrays.range_hash(prefix, words.start[long], words.start[long] + n, arrays.BYTE_POWERS) ^ np.uint64(n))
    return words, np.concatenate(rows), np.concatenate(hashes)


def lexicon(words: str) -> np.ndarray:
    return np.unique(terms(pa.array([words]))[0].hashes())


def patterns(text: pa.Array, words: arrays.Words) -> np.ndarray:
    """Per row: share of capitals among letters, and exclamation marks per word."""
    raw, off = arrays.byte_view(text)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    letters = upper + np.concatenate([[0], np.cumsum((raw >= 97) & (raw <= 122))])
    marks = np.concatenate([[0], np.cumsum(raw == ord("!"))])
    count = lambda x: np.diff(x[off])
    return np.stack([count(upper) / np.maximum(count(letters), 1), count(marks) / np.maximum(np.diff(words.bounds), 1)], axis=1)


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a batch that hold each term, by label."""
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            _, rows, hashes = terms(piece.column("text"))
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            toxic = piece.column("label").to_numpy()[rows[new]]
            term, at = np.unique(hashes[new], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(term.view(np.int64)), pa.array(np.bincount(at, toxic == 1, minlength=len(term))), pa.array(np.bincount(at, toxic != 1, minlength=len(term)))],
                names=["term", "bad", "good"],
            )


def counts_of(text: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term place and count of the vocabulary's terms in each text, and the rows' other votes."""
    words, rows, hashes = terms(text)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    pair, count = np.unique(rows[hit] * (len(vocabulary) + 1) + at[hit], return_counts=True)
    own = words.hashes()
    votes = [np.bincount(words.row[np.isin(own, lexicon(x))], minlength=len(text)) > 0 for x in INSULTS.values()]
    shape = patterns(text, words)
    votes += [shape[:, 0] > 0.5, shape[:, 1] > 0.2]
    return pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1), count, np.stack(votes, axis=1)


EXTRA = len(INSULTS) + 2


def _features(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in arrays.slices(batch, "text"):
            rows, places, counts, votes = counts_of(piece.column("text"), vocabulary)
            bounds = np.searchsorted(rows, np.arange(piece.num_rows + 1))
            flags = votes @ (1 << np.arange(EXTRA))
            lists = [arrays.list_array(x, bounds, pa.int32()) for x in (places, counts)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("label"), *lists, pa.array(flags)], names=["doc_id", "label", "places", "counts", "votes"])


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior of class 1 from voters that vote (1) or abstain (0), and trusted labels as one voter more.

    Given the class, voters are Bernoulli; a voter's log odds are divided by one plus the sum of its correlations
    with the others beyond what the classes explain.
    """
    sure = 0.98
    q = np.where(labels == 1, sure, 1 - sure)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        in_1, in_0 = (q @ votes + 0.5) / (q.sum() + 1), ((1 - q) @ votes + 0.5) / ((1 - q).sum() + 1)
        expected = np.outer(q, in_1) + np.outer(1 - q, in_0)
        rest = votes - expected
        spread = np.sqrt((rest**2).mean(0)) + 1e-6
        correlation = np.clip((rest.T @ rest) / len(votes) / np.outer(spread, spread), 0, 1)
        np.fill_diagonal(correlation, 0)
        correlation[correlation < 0.1] = 0
        weight = 1 / (1 + correlation.sum(0))
        yes, no = np.log(in_1 / in_0), np.log((1 - in_1) / (1 - in_0))
        odds = np.log(prior / (1 - prior)) + votes @ (weight * yes) + (1 - votes) @ (weight * no)
        q = sigmoid(odds + np.where(labels == 1, 1, -1) * np.log(sure / (1 - sure)))
        sure = float(np.clip(np.where(labels == 1, q, 1 - q).mean(), 0.8, 0.99))
    return q


class Model:
    """A vocabulary of terms and a weight for each, for each further vote, and a bias."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights

    def score(self, text: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(text))
        rows, places, counts, votes = counts_of(text, self.vocabulary)
        n = len(self.vocabulary)
        x = np.bincount(rows, np.log1p(counts) * self.weights[places], minlength=len(text))
        return sigmoid(x + votes @ self.weights[n : n + EXTRA] + self.weights[-1])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    rows = written(training_rows(docs, labels, "toxic", most), "toxicity-rows")
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    mined = rows.mapInArrow(_mined, "term long, bad double, good double").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = f"ln((bad + 0.5) / {bad + 1}) - ln((good + 0.5) / {good + 1})"
    mined = mined.where("bad >= 3").withColumn("z", F.expr(f"({odds}) / sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))")).where("z > 2.5")
    best = [r["term"] for r in mined.orderBy(F.desc("z"), "term").limit(TERMS).collect()]
    vocabulary = np.sort(np.array(best, np.int64).view(np.uint64))
    found = rows.mapInArrow(partial(_features, vocabulary=vocabulary), "doc_id long, label int, places array<int>, counts array<int>, votes long").toArrow()

    n, labelled = len(vocabulary), found.column("label").to_numpy()
    places = found.column("places").combine_chunks()
    row = np.repeat(np.arange(len(labelled)), np.diff(places.offsets.to_numpy()))
    places = places.flatten().to_numpy().astype(np.int64)
    counts = found.column("counts").combine_chunks().flatten().to_numpy()
    flags = (found.column("votes").to_numpy()[:, None] >> np.arange(EXTRA)) & 1
    strongest = np.full(n, -1)
    strongest[np.searchsorted(vocabulary, np.array(best[:VOTERS], np.int64).view(np.uint64))] = np.arange(len(best[:VOTERS]))
    mine = strongest[places] >= 0 if n else np.zeros(0, bool)
    votes = np.zeros((len(labelled), len(best[:VOTERS])), np.float32)
    votes[row[mine], strongest[places[mine]]] = 1
    silent = np.bincount(row, minlength=len(labelled)) == 0
    q = label_model(np.column_stack([votes, flags, silent]).astype(np.float32), labelled)

    r, c = np.nonzero(flags)
    x = Sparse(np.concatenate([row, r]), np.concatenate([places, n + c]), np.concatenate([np.log1p(counts), np.ones(len(r))]), (len(labelled), n + EXTRA))

    def gradient(w: np.ndarray) -> np.ndarray:
        g = sigmoid(x.dot(w[:-1]) + w[-1]) - q
        return np.append(x.back(g) / len(q) + 1e-4 * w[:-1], g.mean())

    w = descend(gradient, n + EXTRA + 1, 400, 0.05)
    x = x.dot(w[:-1])
    # The bias puts the threshold a quarter of the way from the highest clean rows to the lowest toxic ones.
    clean, toxic = np.quantile(x[labelled != 1], 0.999), np.quantile(x[labelled == 1], 0.05)
    w[-1] = np.log(THRESHOLD / (1 - THRESHOLD)) - (clean + max(0.0, toxic - clean) / 4)
    return Model(vocabulary, w)


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
            yield piece.filter(pa.array(model.score(piece.column("text")) < threshold))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, that the model does not reject."""
    return docs.mapInArrow(partial(_kept, model=model, threshold=threshold), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
