"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its lower-cased characters (white space is one space),
hashed to ``2 ** BITS`` buckets. Over all labelled training rows, Spark counts for each bucket the
documents of either class; a feature is worth the log of the ratio of the smoothed shares. Buckets
in fewer than ``MIN_DOCS`` documents or with a ratio near one carry no information and get no
weight. A logistic regression on the scaled features is fitted on the driver over at most
``SAMPLE`` rows of each class, taken by hash of their id; that is the one bounded sample. Weights
and ratios fold into one vector of fixed size, which is broadcast to score every text.

Rows whose crc32(id as text) mod 3 is 1 are held out: their labels are never read.

Defined cases: a null text is empty; an empty text has the score of the intercept; a label other
than 0 or 1 and a null id in labels are ignored; repeated rows count each; without training rows of
both classes every score is the smoothed share of toxic rows; an empty table gives no rows; other
columns, labels, language and source are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import arrow, bounded, by_position, id_text, limit_batches, own_columns, table

BITS, SIZES = 20, (4, 5)
MIN_DOCS, MIN_RATIO = 5, 1.0
#: Training rows of either class at most.
SAMPLE = 3000
#: Labels up to which the training ids are broadcast; beyond, texts are shuffled to their labels.
BROADCAST_LABELS = 2_000_000
STEPS, RATE, DECAY = 150, 0.05, 1e-5
THRESHOLD = 0.7

_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1000003)


def features(text: str | None) -> np.ndarray:
    """Distinct buckets of a text's n-grams."""
    x = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out, h = [], x
    for n in range(2, max(SIZES) + 1):
        if len(x) < n:
            break
        h = h[:-1] * _BASE + x[n - 1 :]
        if n in SIZES:
            out.append((((h + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """weights: of each bucket, ratio included; bias: the intercept."""

    weights: np.ndarray
    bias: float

    def score(self, found: np.ndarray) -> float:
        z = float(self.weights[found].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each class, documents with each bucket by class) of (text, toxic)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, (1 << BITS) + 1), np.int64)  # the last: all documents
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n[y, features(text)] += 1
                    n[y, -1] += 1
        at = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            ids = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, n[0, ids], n[1, ids])], ["bucket", "n0", "n1"])

    found = (
        bounded(rows.select("text", "toxic"), each, "bucket long, n0 long, n1 long")
        .groupBy("bucket")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where((F.col("n0") + F.col("n1") >= MIN_DOCS) | (F.col("bucket") == 1 << BITS))
        .toArrow()  # at most a row a bucket
    )
    n = np.zeros((2, (1 << BITS) + 1))
    at = found["bucket"].to_numpy()
    n[0, at], n[1, at] = found["n0"].to_numpy(), found["n1"].to_numpy()
    return n[:, -1], n[:, :-1]


def _fit(ids: np.ndarray, row: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> Model:
    """Class-balanced logistic regression by Adam over the ratio-scaled features (row, ids)."""
    cols, at = np.unique(ids, return_inverse=True)
    v = ratio[cols][at]
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w = np.zeros(len(cols) + 1)  # the last: intercept
    m, s = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, STEPS + 1):
        z = np.bincount(row, v * w[at], len(y)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share / len(y)
        grad = np.append(np.bincount(at, g[row] * v, len(cols)) + DECAY * w[:-1], g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros(len(ratio))
    weights[cols] = w[:-1] * ratio[cols]
    return Model(weights.astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled rows of ``docs`` that aren't held out; labels carry the same id column."""
    spark = docs.sparkSession
    marks, i, y = by_position(labels, id_col, label_col)
    known = marks.where(F.col(y).isin(0, 1) & F.col(i).isNotNull() & ~held_out(i)).select(
        F.col(i).cast("long").alias("_id"), F.col(y).cast("int").alias("toxic")
    )
    texts = id_text(docs, id_col, text_col).select(F.col("id").alias("_d"), "text")
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = texts.join(F.broadcast(known) if small else known, F.col("_d") == F.col("_id"))
    total, n = _counts(rows)
    empty = np.zeros(1 << BITS, np.float32)
    if not total.all():
        return Model(empty, float(np.log((total[1] + 1) / (total[0] + 1))))
    ratio = np.log((n[1] + 1) / (total[1] + 2)) - np.log((n[0] + 1) / (total[0] + 2))
    ratio[(n.sum(axis=0) < MIN_DOCS) | (np.abs(ratio) < MIN_RATIO)] = 0
    useful = spark.sparkContext.broadcast(ratio != 0)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [(f := features(t))[useful.value[f]].astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.binary())], ["toxic", "ids"])

    by_hash = F.xxhash64("_id")
    picked = [known.where(F.col("toxic") == y).distinct().orderBy(by_hash, "_id").limit(SAMPLE) for y in (0, 1)]
    chosen = picked[0].unionAll(picked[1])
    sample = texts.join(F.broadcast(chosen), F.col("_d") == F.col("_id")).select("text", "toxic", "_id")
    # an id may have several rows
    sample = sample.orderBy(by_hash, "_id", F.xxhash64("text")).limit(2 * SAMPLE)
    found = arrow(sample.select("text", "toxic"), each, "toxic int, ids binary").toArrow().to_pydict()
    y = np.array(found["toxic"])
    if not 0 < y.sum() < len(y):
        return Model(empty, float(np.log((total[1] + 1) / (total[0] + 1))))
    lists = [np.frombuffer(b, "<i4") for b in found["ids"]]
    return _fit(np.concatenate(lists), np.repeat(np.arange(len(y)), [len(x) for x in lists]), y, ratio)


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the model's score of every text."""
    limit_batches(docs.sparkSession)
    weights, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    @F.pandas_udf("double")
    def scores(texts):
        own = Model(weights.value, bias)
        return texts.map(lambda t: own.score(features(t)), na_action=None).astype("float64")

    return docs.withColumn(out_col, scores(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    model = train(docs, labels, id_col, text_col)
    out = score(id_text(docs, id_col, text_col), model)
    return out.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject."""
    model = train(docs, labels, id_col, text_col)
    rows, text = by_position(docs, text_col)
    return own_columns(score(rows, model, text, "_toxicity").where(F.col("_toxicity") < THRESHOLD), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")
