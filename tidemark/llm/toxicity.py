"""Operator 1: toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 are predicted from sparse text features (words and word
beginnings present in the text). One weight vector serves all ordered thresholds:
P(grade >= k) = sigmoid(w.x - t_k), t_1 < t_2 < ...; the result is the expected
severity, the sum of these probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import LOWER, buffers, mix, slices, span_hashes, word_spans

MAX_FIT_DOCS = 20_000
MIN_DOCS = 5
MIN_Z = 3.0
RIDGE = 1.0
ROUNDS = 600
BEGINNINGS = (4, 5, 6)
FLAG = 0.5

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct feature of each text: its words and their first 4, 5 and 6 bytes."""
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets, _BREAK)
    found = [mix(span_hashes(low, starts, ends) ^ np.uint64(1))]
    rows = [row]
    for k in BEGINNINGS:
        longer = ends - starts > k
        found.append(mix(span_hashes(low, starts[longer], starts[longer] + k) ^ np.uint64(k)))
        rows.append(row[longer])
    return np.concatenate(rows), np.concatenate(found)


def _distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


@dataclass(frozen=True)
class Model:
    """Feature hashes (sorted), the shared weights, and the ordered thresholds."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, k): the probability of a grade of at least k + 1."""
        row, place = look_up(self.vocabulary, data, offsets)
        linear = np.bincount(row, self.weights[place], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -60, 60)))


def look_up(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the vocabulary) of each text's distinct known features."""
    row, value = features(data, offsets)
    if not len(vocabulary):
        return row[:0], row[:0]
    at = np.minimum(np.searchsorted(vocabulary, value), len(vocabulary) - 1)
    known = vocabulary[at] == value
    return _distinct(row[known], at[known])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feature", pa.int64()), ("grade", pa.int32()), ("docs", pa.int64())])
    for batch in batches:
        for part in slices(batch, "text"):
            row, value = _distinct(*features(*buffers(part.column("text"))))
            grades = np.asarray(part.column("grade"))
            for grade in np.unique(grades):
                feature, docs = np.unique(value[(grades == grade)[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(np.full(len(feature), grade, np.int32)), pa.array(docs)], schema=schema)


def _rows(vocabulary):
    schema = pa.schema([("grade", pa.int32()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, place = look_up(vocabulary.value, *buffers(part.column("text")))
                edge = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.ListArray.from_arrays(pa.array(edge), pa.array(place.astype(np.int32)))], schema=schema)

    return run


def solve(row: np.ndarray, place: np.ndarray, grade: np.ndarray, width: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that minimise the ridge-penalised log loss; gradient steps with adaptive moments."""
    n, steps = len(grade), int(grade.max()) if len(grade) else 1
    target = np.array([[g >= k + 1 for k in range(steps)] for g in grade.tolist()], bool).reshape(n, steps)
    prior = (target.sum(0) + 0.5) / (n + 1)
    start = np.log((1 - prior) / prior)
    # thresholds are the first one and the logarithms of their gaps
    theta = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w = theta[:width]
        gaps = np.exp(theta[width + 1 :])
        cut = theta[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        linear = np.bincount(row, w[place], minlength=n)
        above = 1 / (1 + np.exp(-np.clip(linear[:, None] - cut, -60, 60)))
        full = np.concatenate((np.ones((n, 1)), above, np.zeros((n, 1))), 1)
        slope = full * (1 - full)
        own = np.arange(n)
        p = np.maximum(full[own, grade] - full[own, grade + 1], 1e-12)
        d_linear = -(slope[own, grade] - slope[own, grade + 1]) / p
        d_cut = np.zeros((n, steps + 2))
        d_cut[own, grade] += slope[own, grade] / p
        d_cut[own, grade + 1] -= slope[own, grade + 1] / p
        d_cut = d_cut[:, 1:-1].sum(0)
        grad = np.concatenate((np.bincount(place, d_linear[row], minlength=width) + ridge * w, [d_cut.sum()], [d_cut[k + 1 :].sum() * gaps[k] for k in range(steps - 1)]))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:width], theta[width] + np.concatenate(([0.0], np.cumsum(np.exp(theta[width + 1 :]))))


def fit(docs: DataFrame, grades: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Model:
    """A model from about ``max_fit_docs`` labelled rows, taken by a hash of doc_id.

    ``grades(doc_id, grade)`` may repeat a doc_id (its highest grade counts) and hold
    nulls (left out). The label sample is what is broadcast; to the driver come the
    features that ``MIN_DOCS`` sampled documents share, then the places of those that
    tell the grades apart (``MIN_Z``) in each document: both bounded by the sample.
    """
    spark = docs.sparkSession
    usable = grades.where("doc_id is not null and grade is not null and grade >= 0")
    n = usable.count()
    share = min(1.0, max_fit_docs / n) if n else 0.0
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "grade")
    counts = labelled.mapInArrow(_count, "feature long, grade int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum(F.when(F.col("grade") > 0, F.col("docs")).otherwise(0)).alias("bad"))
    totals = labelled.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    found = counts.where(F.col("docs") >= MIN_DOCS).toArrow()
    feature, df, bad = (np.asarray(found[c]) for c in ("feature", "docs", "bad"))
    good_n, bad_n = max(totals[0] - totals[1], 1), max(totals[1], 1)
    p1, p0 = bad / bad_n, (df - bad) / good_n
    pooled = df / max(totals[0], 1)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / good_n + 1 / bad_n))
    vocabulary = np.sort(feature[z >= MIN_Z].view(np.uint64))
    table = labelled.mapInArrow(_rows(spark.sparkContext.broadcast(vocabulary)), "grade int, places array<int>").toArrow()
    places = table["places"].combine_chunks()
    row = np.repeat(np.arange(len(places)), np.diff(np.asarray(places.offsets))) if len(places) else np.zeros(0, np.int64)
    grade = np.asarray(table["grade"]).astype(np.int64)
    weights, thresholds = solve(row, np.asarray(places.flatten()).astype(np.int64), grade, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("p_toxic", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                above = model.value.exceed(*buffers(part.column("text")))
                grade = (above >= FLAG).sum(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade), pa.array(above[:, 0] >= FLAG)], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, toxic) of every row of ``docs(doc_id, text)``.

    A null or wordless text has the severity of a text without known features; a
    null doc_id is kept; repeated rows are scored each; whole texts are read; other
    columns are ignored; an empty table gives no rows. ``toxic`` is a probability of
    at least ``FLAG`` that the grade exceeds 0.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean")
