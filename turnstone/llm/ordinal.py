"""Text quality by ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, read, text_slices, word_hashes

#: Hash buckets of the text features, and rated rows that the model is fitted to, at most (smallest id hashes).
BUCKETS, SAMPLE_ROWS = 4096, 4000
RIDGE, STEPS, RATE = 1e-4, 400, 0.05

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def text_features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row of hashed features for each text: byte trigrams, words, and repeats of a word; square roots of shares.

    A text of any length gives a row of unit length; one without bytes gives zeros.
    """
    n = len(offsets) - 1
    out = np.zeros((n, buckets), np.float32)
    low = np.uint64(buckets - 1)
    x = data.astype(np.uint64)
    tri = mix(x[:-2] * _A + x[1:-1] * _B + x[2:] * _C) & low if len(x) > 2 else np.zeros(0, np.uint64)
    words, rows = word_hashes(data, offsets, lower=False)
    again = np.zeros(len(words), bool)
    if len(words):
        again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    token = np.where(again, mix(np.array([77], np.uint64))[0], words) & low
    at = np.searchsorted(rows, np.arange(n + 1))
    for k in range(n):
        a, b = int(offsets[k]), int(offsets[k + 1])
        count = np.zeros(buckets)
        if b - a > 2:
            count += np.bincount(tri[a : b - 2].astype(np.int64), minlength=buckets) / (b - a - 2)
        if at[k + 1] > at[k]:
            count += np.bincount(token[at[k] : at[k + 1]].astype(np.int64), minlength=buckets) / (at[k + 1] - at[k])
        total = count.sum()
        if total:
            out[k] = np.sqrt(count / total)
    return out


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= grades[k]) = sigmoid(thresholds[k] - weights . features), thresholds ascending, one fewer than grades."""

    weights: tuple[float, ...]
    thresholds: tuple[float, ...]
    grades: tuple[float, ...]

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        eta = x @ np.array(self.weights, dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - np.array(self.thresholds)[None, :], -30, 30)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam; the thresholds are the first and the logarithms of the steps to the next."""
    grades, y = np.unique(grade, return_inverse=True)
    k = len(grades)
    if k < 2 or not len(x):
        return OrdinalModel((0.0,) * x.shape[1], (), tuple(map(float, grades)))
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(x.shape[1]), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    d, n = x.shape[1], len(x)
    x = x.astype(np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[d + 1 :])
        b = np.concatenate([[-np.inf], theta[d] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        eta = (x @ theta[:d].astype(np.float32)).astype(np.float64)
        up, down = b[y + 1] - eta, b[y] - eta
        s_up, s_down = 1 / (1 + np.exp(-np.clip(up, -30, 30))), 1 / (1 + np.exp(-np.clip(down, -30, 30)))
        s_up[np.isposinf(up)], s_down[np.isneginf(down)] = 1, 0
        p = np.maximum(s_up - s_down, 1e-9)
        g_up, g_down = s_up * (1 - s_up) / p, s_down * (1 - s_down) / p
        g = np.zeros_like(theta)
        g[:d] = x.T @ ((g_up - g_down) / n).astype(np.float32) + ridge * theta[:d]
        g_b = np.zeros(k + 1)
        np.add.at(g_b, y + 1, -g_up / n)
        np.add.at(g_b, y, g_down / n)
        g_b = g_b[1:k]
        g[d] = g_b.sum()
        g[d + 1 :] = np.cumsum(g_b[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    thresholds = theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))])
    return OrdinalModel(tuple(map(float, theta[:d])), tuple(map(float, thresholds)), tuple(map(float, grades)))


def held_out(id_col: str | Column) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(1)):
            x = text_features(data, offsets)
            yield pa.record_batch([batch.column(0).slice(row, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], ["grade", "x"])


def fit_quality(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> OrdinalModel:
    """Fits the model to at most sample_rows rated rows outside the held-out fifth, in one task; the grades may be any numbers."""
    train = ratings.where(F.col(grade_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(F.col(grade_col).cast("double")).alias("grade"))
    train = train.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(train), id_col).select("grade", "text")
    sample = materialize(rows.mapInArrow(_featurize, "grade double, x binary"), "rated")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grade", "x"], ignore_index=True)
        x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), -1)
        model = fit_ordinal(x, pdf["grade"].to_numpy())
        return pd.DataFrame({"weights": [list(model.weights)], "thresholds": [list(model.thresholds)], "grades": [list(model.grades)]})

    found = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "weights array<double>, thresholds array<double>, grades array<double>").collect()
    if not found:
        return OrdinalModel((0.0,) * BUCKETS, (), ())
    return OrdinalModel(*(tuple(found[0][k]) for k in range(3)))


def _score(model: OrdinalModel, least: float | None):
    grades = np.array(model.grades)
    least = (grades[-1] if len(grades) else 0.0) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                if len(grades) < 2:
                    expected = np.full(n, grades[0] if len(grades) else 0.0)
                    tail = np.full(n, float(bool(len(grades)) and grades[0] >= least))
                else:
                    over = model.tails(text_features(data, offsets))
                    expected = grades[0] + over @ np.diff(grades)
                    k = int(np.searchsorted(grades, least))
                    tail = np.ones(n) if k == 0 else np.zeros(n) if k == len(grades) else over[:, k - 1]
                yield pa.record_batch([batch.column(0).slice(row, n), pa.array(expected), pa.array(tail)], ["id", "expected_grade", "tail_probability"])

    return run


def quality_scores(
    docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least_grade: float | None = None, least_tail: float = 0.5
) -> DataFrame:
    """(id_col, held_out, expected_grade, tail_probability, selected) for every row; whole texts.

    tail_probability is that of least_grade (the highest if None) or better, selected where it is least_tail or more.
    Null is scored as empty: the thresholds alone decide. Without ratings the grade is 0 and nothing is selected; with
    one grade only it is certain. Repeated rows are scored each; other columns are not read. An empty table gives an
    empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(id_col, text_col).mapInArrow(_score(model, least_grade), f"id {kind}, expected_grade double, tail_probability double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= least_tail).alias("selected"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, read(spark, sf_dir, "labels")))
