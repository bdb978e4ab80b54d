"""Quality classifier: ordinal cumulative-link regression on graded ratings.

    P(grade <= k | x) = sigmoid(threshold_k - w . x),   threshold_0 < threshold_1 < ...

One weight vector over hashed text features is shared by all thresholds.  The
expected grade ranks documents; the tail probability P(grade >= k) selects them.
Features are yes/no: words, and how often a word's first two or last three bytes
have a given shape (letters, digits and marks apart), a word repeats the one
before it, or a word is new in its text - each at several levels of frequency, so
a stray mark weighs less than a text full of them.

The fit uses a bounded sample of ``FIT_ROWS`` rated documents (a fixed hash order)
and the ``FEATURES`` most telling features; scoring reads every whole text.

Grades of the ``labels`` table: 0 low quality, 1 good but toxic, 2 good.  A document
is rejected when P(grade >= 1) < 0.5.

Defined results: null and empty texts are scored by their (few) features; without
ratings, or with one grade only, every document gets that grade's certainty and is
kept when the grade is 1 or more or unknown; repeated doc_ids in ``labels`` count
once with the lowest grade; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import hashed_features as hf
from quire.llm import shared_keys, wordhash

FIT_ROWS = 40_000
FEATURES = 2048
SEED = 5
GRADES = 3
KEEP_GRADE = 1
KEEP_TAIL = 0.5
RIDGE = 3.0
_LEVELS = (0.01, 0.05, 0.2, 0.5)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[48:58] = ord("0")
_SHAPE[128:] = ord("a")


class Model(NamedTuple):
    table: np.ndarray         # sorted feature hashes
    weights: np.ndarray
    thresholds: np.ndarray    # ascending, grades - 1 of them


def _levelled(rows: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One feature for each level of frequency that an id reaches in its row of ``n`` words."""
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])))[:len(rows)]
    share = np.diff(np.append(at, len(rows))) / n[rows[at]]
    found = [(rows[at][share >= level], wordhash.mix(ids[at][share >= level] + np.uint64(i + 1))) for i, level in enumerate(_LEVELS)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def extract(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a batch of texts."""
    w = wordhash.words(texts, lower=True)
    n = np.diff(w.first)
    if not len(w.row):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    shapes = [(w.row, wordhash.spans(texts, np.maximum(w.start, w.end - 3), w.end, _SHAPE) ^ np.uint64(1 << 40)),
              (w.row, wordhash.spans(texts, w.start, np.minimum(w.start + 2, w.end), _SHAPE) ^ np.uint64(2 << 40))]
    again = np.zeros(len(w.row), dtype=bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    keyed = wordhash.mix(w.hash + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    new = np.zeros(len(w.row), dtype=bool)
    new[np.unique(keyed, return_index=True)[1]] = True
    for mark, which in ((3, again), (4, new), (5, w.end - w.start > 25)):
        shapes.append((w.row[which], np.full(int(which.sum()), np.uint64(mark << 40))))
    rows, ids = _levelled(np.concatenate([s[0] for s in shapes]), np.concatenate([s[1] for s in shapes]), n)
    return np.concatenate([w.row, rows]), np.concatenate([w.hash, ids])


def fit(labelled: DataFrame, grades: int = GRADES, features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """A model of ``labelled`` (doc_id, text, y: grade), at most a sample's worth of rows."""
    totals = [0] * grades
    for r in labelled.groupBy("y").count().collect():
        totals[r["y"]] = r["count"]
    share = np.cumsum(np.array(totals, dtype=float) + 0.5)[:-1] / (sum(totals) + 0.5 * grades)
    thresholds = np.log(share / (1 - share))
    if sum(t > 0 for t in totals) < 2:
        sure = np.full(grades - 1, -40.0)
        if sum(totals):
            sure[int(np.argmax(totals)):] = 40.0
        return Model(np.zeros(0, np.uint64), np.zeros(0), sure)
    table = hf.choose(labelled, extract, totals, features)
    y, edges, at = hf.gather(labelled, extract, table)
    rows = np.repeat(np.arange(len(y)), np.diff(edges))
    w, theta = np.zeros(len(table)), thresholds
    curve = 0.25 * np.bincount(at, minlength=len(table)) + ridge
    vw, vt = np.zeros(len(w)), np.zeros(len(theta))
    for _ in range(400):
        x = np.bincount(rows, weights=w[at], minlength=len(y))
        upper = hf.sigmoid(np.append(theta, 40.0)[y] - x)                  # P(grade <= y)
        lower = np.where(y > 0, hf.sigmoid(np.append(-40.0, theta)[y] - x), 0.0)
        upper = np.where(y < grades - 1, upper, 1.0)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gx = du - dl                                                       # of the loss, by x
        gt = np.bincount(y, weights=-du, minlength=grades)[:-1] + np.bincount(y, weights=dl, minlength=grades)[1:]
        vw = 0.9 * vw - 0.1 * (np.bincount(at, weights=gx[rows], minlength=len(w)) + ridge * w) / curve
        vt = 0.9 * vt - 0.1 * gt / (0.25 * len(y))
        w = w + vw
        theta = np.maximum.accumulate(theta + vt + np.arange(grades - 1) * 1e-9)
    return Model(table, w, theta)


def score(docs: DataFrame, model: Model, keep_grade: int = KEEP_GRADE) -> DataFrame:
    """``docs`` with expected_grade and tail_probability = P(grade >= keep_grade) (doubles)."""
    docs = docs.drop("expected_grade", "tail_probability")

    def run(batches):
        lookup = hf.Lookup(model.table)
        for part in shared_keys.slices(batches):
            x = hf.linear(part.column("text"), extract, lookup, model.weights)
            tails = hf.sigmoid(x[:, None] - model.thresholds[None, :])      # P(grade >= 1), P(grade >= 2), ...
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, keep_grade - 1])],
                                             names=[*part.schema.names, "expected_grade", "tail_probability"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, columns + ", expected_grade double, tail_probability double")


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of the sampled rated documents: of rows that share an id, the first text."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = (labels.where("quality is not null and doc_id is not null")
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).cast("int").alias("y")))
    sample = hf.sample_labelled(known, limit, SEED)
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")     # at most ``limit`` rows of 12 bytes
    return rated.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def rate(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with expected_grade, tail_probability and kept, by a model fitted on the rated rows of ``train_docs``."""
    model = fit(training_rows(train_docs, labels))
    return score(docs, model).withColumn("kept", F.col("tail_probability") >= KEEP_TAIL)


def op1_quality_ordinal(spark, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return rate(docs, docs, labels).select("doc_id", "expected_grade", "tail_probability", "kept")
