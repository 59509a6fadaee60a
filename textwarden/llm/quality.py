"""Quality of texts by naive Bayes support vectors.

A text is the set of its words and word pairs, hashed into a fixed number of
features; pairs of one word twice also count as such, whatever the word, by the
share of all pairs that they exceed. Each feature is scaled by the log ratio of its counts in the two
classes, each text by its number of features; a linear hinge-loss model is fitted by dual
coordinate descent, and its margins are turned into scores by a logistic curve
fitted on rows that the model itself has not seen.

The model is fitted on a bounded sample of labelled rows, MOST_LABELLED, taken
in the order of a hash of their ids; everything else covers all documents. Rows
of the held-out third are never part of it.

Defined cases: a null or empty text has no features and gets the score of the
intercept; ids with differing labels count as good if at least half are; with
no labels of one class every score is the share of good labels (0.5 without
any); with under CURVE_EACH rows of a class the plain curve is used; repeated rows are scored each; an empty table gives an empty result; lang,
source and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.wordhash import ngram_hashes, pieces, text_bytes, word_hashes, words

#: Labelled rows that the model is fitted on, at most.
MOST_LABELLED = 12_000
#: Features are hashed into 2 ** BITS places.
BITS = 18
#: Added to each count; the bound of the dual variables; passes over the rows.
SMOOTHING, BOUND, PASSES = 1.0, 1.0, 12
#: Of the sampled rows, one in so many fits the curve of the scores.
CURVE_EACH = 5

#: Shares of pairs of one word twice whose passing is a feature.
REPEATED = np.array([0.0, 0.1, 0.3, 0.6])

U64 = np.uint64


@dataclass
class Model:
    """``weights`` of hashed features (None: no model, the score is ``prior``), with intercept and curve."""

    weights: np.ndarray | None
    intercept: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.5


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct places of its words and word pairs."""
    data, offsets = text_bytes(column)
    drop = U64(64 - BITS)
    for lo, hi in pieces(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        part = data[offsets[lo] : offsets[hi]]
        starts, ends = words(part, at)
        single = word_hashes(part, starts, ends)
        pair = ngram_hashes(single, 2) >> drop
        single = single >> drop
        first = np.searchsorted(starts, at)
        for a, b in zip(first[:-1], first[1:], strict=True):
            same = np.count_nonzero(single[a : max(a, b - 1)] == single[a + 1 : b])
            share = np.flatnonzero(same > REPEATED * max(1, b - a - 1)).astype(U64)
            yield np.unique(np.concatenate([single[a:b], pair[a : max(a, b - 1)], share])).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)]
    for ids, y in zip(rows, good, strict=True):
        counts[int(y)][ids] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], good: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the unscaled features and the intercept of the hinge-loss model."""
    rng = np.random.default_rng(0)
    sign = np.where(good, 1.0, -1.0)
    scale = np.array([1 / np.sqrt(max(1, len(ids))) for ids in rows])
    norm = np.array([s * s * np.dot(ratios[ids], ratios[ids]) for ids, s in zip(rows, scale, strict=True)]) + 1.0
    # Rows of the rarer class weigh as much in all as those of the other.
    share = good.mean()
    bound = BOUND * np.where(good, 0.5 / share, 0.5 / (1 - share))
    dual, w, b = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            ids, y = rows[i], sign[i]
            x = ratios[ids] * scale[i]
            slope = y * (np.dot(w[ids], x) + b) - 1
            new = min(max(dual[i] - slope / norm[i], 0.0), bound[i])
            if new != dual[i]:
                w[ids] += (new - dual[i]) * y * x
                b += (new - dual[i]) * y
                dual[i] = new
    return w * ratios, b


def margins(rows: list[np.ndarray], weights: np.ndarray, intercept: float) -> np.ndarray:
    return np.array([weights[ids].sum() / np.sqrt(max(1, len(ids))) + intercept for ids in rows])


def logistic_curve(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through smoothed labels, by Newton steps."""
    n1, n0 = good.sum(), (~good).sum()
    goal = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = np.array([np.dot(p - goal, margin), (p - goal).sum()])
        h = p * (1 - p)
        m = np.array([[np.dot(h, margin**2) + 1e-6, np.dot(h, margin)], [np.dot(h, margin), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(c)) if np.isfinite([a, c]).all() and a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    prior = float(good.mean()) if len(good) else 0.5
    if min(good.sum(), (~good).sum()) == 0:
        return Model(None, prior=prior)
    # Each class gives every fifth of its rows to the curve, so that the model has rows of both.
    curve = np.where(good, np.cumsum(good), np.cumsum(~good)) % CURVE_EACH == 0
    base = [ids for ids, c in zip(rows, curve, strict=True) if not c]
    weights, intercept = dual_coordinate_descent(base, good[~curve], log_count_ratios(base, good[~curve]))
    slope, shift = 1.0, 0.0
    if min(good[curve].sum(), (~good)[curve].sum()) > 0:
        slope, shift = logistic_curve(margins([ids for ids, c in zip(rows, curve, strict=True) if c], weights, intercept), good[curve])
    return Model(weights, intercept, slope, shift, prior)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on at most MOST_LABELLED labelled ids outside the held-out third, one text an id."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    by_id = usable.groupBy("doc_id").agg((F.avg(label) >= 0.5).alias("good"))
    sample = by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.tobytes() for x in feature_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("good"), pa.array(ids, pa.binary())], names=["doc_id", "good", "ids"])

    # Of rows with one id one text is learned from, so no more than the sampled ids come to the driver.
    made = chosen.mapInArrow(run, "doc_id long, good boolean, ids binary")
    found = made.groupBy("doc_id").agg(F.first("good").alias("good"), F.min("ids").alias("ids")).toArrow()
    rows = sorted(zip(found.column("doc_id").to_pylist(), found.column("ids").to_pylist(), found.column("good").to_pylist(), strict=True))
    return fit([np.frombuffer(ids, np.int32) for _, ids, _ in rows], np.array([y for _, _, y in rows], dtype=bool))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if m.weights is None:
                scores = np.full(batch.num_rows, m.prior)
            else:
                margin = margins(list(feature_sets(batch.column("text"))), m.weights, m.intercept)
                scores = 1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those that the classifier rejects, all columns as they are."""
    model = train(documents, labels)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if m.weights is None:
                keep = np.full(batch.num_rows, m.prior >= 0.5)
            else:
                margin = margins(list(feature_sets(batch.column("text"))), m.weights, m.intercept)
                keep = m.slope * margin + m.shift >= 0
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
