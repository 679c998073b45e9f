"""Quality classifier: regularised quadratic discriminant.

A document's statistics (shares of character classes, word lengths, repetition)
are transformed and modelled by one Gaussian per class. Class covariances are
shrunk towards the pooled covariance and towards a multiple of the identity. The
score is the logistic function of the difference of the two log densities, from
Mahalanobis distances by the cached Cholesky factors of the covariances, plus the
log ratio of the class sizes.

All labelled rows take part in the fit: tasks add up counts, sums and products,
and only these sums are collected.

Defined results: a null text is empty and is scored like any other; labels that
are null, or whose document is missing, are not used; repeated labels count as
often as they occur; if only one class is labelled every score is that class, and
without labels every score is 0.5. An empty table gives no rows. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import LOWER, text_bytes

NAMES = ("log_words", "log_word_length", "upper", "symbol", "bang", "pipe", "digit", "non_ascii", "full_stop",
         "comma", "line", "short_words", "distinct_words", "distinct_pairs", "same_as_last")
#: Weight of the pooled covariance and of the identity in a class covariance.
POOLED, IDENTITY = 0.1, 0.02
#: Scores are smoothed: log density differences are divided by this.
TEMPERATURE = 4.0
FEATURES = "doc_id long, held_out boolean, x array<double>"

_SYMBOL = b"#*$%&<>"


def _class_table() -> np.ndarray:
    """Byte to class: 0 other, 1 upper, 2 lower, 3 symbol, 4 !, 5 |, 6 digit, 7
    non-ASCII, 8 full stop, 9 comma, 10 line feed, 11 white space."""
    t = np.zeros(256, np.uint8)
    for name, chars in ((1, range(65, 91)), (2, range(97, 123)), (3, _SYMBOL), (4, b"!"), (5, b"|"), (6, range(48, 58)),
                        (7, range(128, 256)), (8, b"."), (9, b","), (11, b"\t\x0b\x0c\r "), (10, b"\n")):
        t[list(chars)] = name
    return t


_CLASS = _class_table()


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: logarithms of sizes, and arcsines of
    the square roots of shares."""
    n = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=12)
    words = text.translate(LOWER).split()
    k = len(words)
    letters, visible = max(1, n[1] + n[2]), max(1, int(n[:10].sum()))
    pairs = set(zip(words, words[1:]))
    shares = [n[1] / letters, n[3] / visible, n[4] / visible, n[5] / visible, n[6] / visible, n[7] / visible,
              n[8] / visible, n[9] / visible, min(1.0, n[10] / max(1, k)),
              sum(len(w) <= 3 for w in words) / max(1, k), len(set(words)) / max(1, k),
              len(pairs) / max(1, k - 1), sum(map(eq, words, words[1:])) / max(1, k - 1)]
    return [float(np.log1p(k)), float(np.log1p(visible / max(1, k))), *np.arcsin(np.sqrt(np.clip(shares, 0.0, 1.0))).tolist()]


def _statistics_rows(batches, schema: pa.Schema):
    for batch in batches:
        x = [statistics(text_bytes(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], schema=schema)


def featurise(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out and the statistics ``x`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        lambda batches: _statistics_rows(batches, schema), FEATURES)


@dataclass
class Gaussian:
    """Mean, inverse of the Cholesky factor, log determinant and log prior."""

    mean: np.ndarray
    inverse: np.ndarray
    log_det: float
    log_prior: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.inverse.T
        return self.log_prior - 0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det)


def _sums(batches, schema: pa.Schema):
    """For each class: count, sums and products, as (label, place, value)."""
    d = len(NAMES)
    total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
    for batch in batches:
        if batch.num_rows:
            label = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            for c in total:
                part = x[label == c]
                total[c] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    m = 1 + d + d * d
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], m).astype(np.int32)), pa.array(np.tile(np.arange(m), 2).astype(np.int32)),
                                      pa.array(np.concatenate([total[0], total[1]]))], schema=schema)


def fit(rows: DataFrame, pooled: float = POOLED, identity: float = IDENTITY) -> list[Gaussian | None]:
    """Class 0 and 1 of ``rows`` (label 0/1, x); None for a class without rows."""
    d = len(NAMES)
    schema = pa.schema([("label", pa.int32()), ("place", pa.int32()), ("value", pa.float64())])
    sums = rows.select(F.col("label").cast("int"), "x").mapInArrow(
        lambda batches: _sums(batches, schema), "label int, place int, value double").groupBy("label", "place").agg(
        F.sum("value").alias("value"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d * d) rows
        total[r["label"], r["place"]] = r["value"]
    return gaussians(total, pooled, identity)


def gaussians(total: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY) -> list[Gaussian | None]:
    d = len(NAMES)
    n = total[:, 0]
    if n.sum() == 0:
        return [None, None]
    means = [t[1:1 + d] / max(1.0, t[0]) for t in total]
    spread = [t[1 + d:].reshape(d, d) - t[0] * np.outer(m, m) for t, m in zip(total, means)]
    both = sum(spread) / max(1.0, n.sum() - 2)
    out: list[Gaussian | None] = []
    for k in (0, 1):
        if n[k] == 0:
            out.append(None)
            continue
        # a class of few rows leans on the pooled covariance
        w = min(1.0, pooled + d / (d + n[k]) * (1 - pooled))
        cov = (1 - w) * spread[k] / max(1.0, n[k] - 1) + w * both
        cov = (1 - identity) * cov + identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        chol = np.linalg.cholesky(cov)
        out.append(Gaussian(means[k], np.linalg.inv(chol), 2 * float(np.log(np.diag(chol)).sum()), float(np.log(n[k] / n.sum()))))
    return out


def score_of(x: np.ndarray, model: list[Gaussian | None]) -> np.ndarray:
    bad, good = model
    if bad is None or good is None:
        return np.full(len(x), 0.5 if bad is good else float(good is not None))
    gap = (good.log_density(x) - bad.log_density(x)) / TEMPERATURE
    return 1.0 / (1.0 + np.exp(-np.clip(gap, -30, 30)))


def score(features: DataFrame, model: list[Gaussian | None]) -> DataFrame:
    """``features`` with ``score`` and ``predicted`` in place of ``x``."""
    def run(x: pa.Array) -> pa.Array:
        return pa.array(score_of(np.asarray(x.flatten()).reshape(-1, len(NAMES)), model))

    scored = features.withColumn("score", F.arrow_udf(run, "double")(F.col("x"))).drop("x")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from the
    labels (doc_id, quality) of those that are not held out."""
    features = materialize(featurise(docs, held_out), "quality-features")
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("of"), F.col("quality").alias("label"))
    rows = features.filter("not held_out").join(known, F.col("doc_id") == F.col("of")).select("label", "x")
    return score(features, fit(rows))
