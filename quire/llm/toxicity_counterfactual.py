"""Toxicity: a counterfactual-regularised classifier.

Logistic regression on hashed words (lower-cased, without punctuation) and word
beginnings; each is a yes/no feature of the whole text.  To keep neutral
mentions of groups from raising scores, every sentence of the labelled texts that
holds an identity term is written again with each other term of its group in
that term's place, and the fit penalises the squared change of the
score: ``penalty * mean (w.x - w.x')**2`` over these pairs of sentences, x and x' being
the features that the two sentences really have.  Pairs are built and compared in
Spark tasks; those with the same difference x - x' are counted together, so the
driver gets a few rows for each pair of terms.

The fit uses a bounded sample of ``FIT_ROWS`` labelled documents (a fixed hash
order); features are counted and gathered by Spark, restricted to the
``FEATURES`` most telling ones, so what the driver fits on is bounded.  Scoring
reads every whole text.

Defined results: null and empty texts score as the intercept says; without
positive or negative labels the score is the labelled share of positives (0.0
without labels); rows that share a ``doc_id`` are scored each; labels that repeat
a ``doc_id`` count once, as toxic if any says so; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import hashed_features as hf
from quire.llm import shared_keys, wordhash

FIT_ROWS = 60_000
FEATURES = 4096
SEED = 11
THRESHOLD = 0.3
PENALTY = 0.5
RIDGE = 2.0
#: Identity terms whose swap must not change a score, by group.
IDENTITY_TERMS = (
    ("men", "women", "people"),
    ("man", "woman", "person"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
)


_SENTENCE = re.compile(r"[^.!?\n]+")
#: A word, as ``extract`` takes it: without the ASCII blanks and punctuation.
_WORD = re.compile(r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")


class Model(NamedTuple):
    table: np.ndarray      # sorted feature hashes
    weights: np.ndarray
    intercept: float
    swapped: int = 0       # pairs of sentences whose change of score was penalised


def extract(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words and of the first 4 and 5 bytes of words of 6 bytes or more."""
    w = wordhash.words(texts, lower=True, strip=hf.PUNCTUATION)
    rows, ids = [w.row], [w.hash]
    for k in (4, 5):
        long = np.flatnonzero(w.end - w.start >= 6)
        start = w.start[long]
        rows.append(w.row[long])
        ids.append(wordhash.mix(wordhash.spans(texts, start, start + k, wordhash.LOWER) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(ids)


def swaps_of(text: str | None, groups=IDENTITY_TERMS) -> Iterator[tuple[str, str, str, str]]:
    """(term, other term, sentence, the sentence with the other term in its place) for all sentences that hold terms."""
    group_of = {t: g for g in groups for t in g}
    for sentence in _SENTENCE.findall(text or ""):
        found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(sentence)]
        for term in sorted({w for _, _, w in found if w in group_of}):
            places = [(a, b) for a, b, w in found if w == term]
            for other in group_of[term]:
                if other != term:
                    ends = [0, *[b for _, b in places]]
                    yield term, other, sentence, "".join(sentence[e:a] + other for e, (a, _) in zip(ends, places)) + sentence[ends[-1]:]


def _differences(batches, table: np.ndarray, groups) -> Iterator[pa.RecordBatch]:
    """Labelled texts -> features (positions in the table) that a sentence gains and loses by a swap, one row for each swap."""
    lookup = hf.Lookup(table)
    any_term = re.compile("|".join(re.escape(t) for g in groups for t in g) or r"(?!)", re.IGNORECASE)
    for part in shared_keys.slices(batches):
        pairs = [(s, t) for text in part.column("text").to_pylist() if text and any_term.search(text) for _, _, s, t in swaps_of(text, groups)]
        for a in range(0, len(pairs), 4096):
            some = pairs[a:a + 4096]
            sets = []
            for side in (0, 1):
                rows, at = lookup.find(*extract(pa.array([p[side] for p in some], pa.string())))
                sets.append(np.unique(rows * len(table) + at))
            out = []
            for mine, theirs in ((0, 1), (1, 0)):
                only = np.setdiff1d(sets[mine], sets[theirs], assume_unique=True)
                edges = np.searchsorted(only, np.arange(len(some) + 1) * len(table))
                out.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array((only % max(1, len(table))).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names=["lost", "gained"])


def score_changes(labelled: DataFrame, table: np.ndarray, groups=IDENTITY_TERMS) -> list[tuple[list[int], list[int], int]]:
    """(features that only the sentence has, that only its swap has, pairs): one row for each different difference, of which a
    pair of terms has a few (which of their features the rest of the sentence has as well)."""
    pairs = labelled.select("text").mapInArrow(lambda it: _differences(it, table, groups), "lost array<int>, gained array<int>")
    return [(r["lost"], r["gained"], r["count"]) for r in pairs.groupBy("lost", "gained").count().orderBy("lost", "gained").collect()]


def fit(labelled: DataFrame, features: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE,
        groups=IDENTITY_TERMS) -> Model:
    """A model of ``labelled`` (doc_id, text, y 0/1), at most a sample's worth of rows."""
    totals = [0, 0]
    for r in labelled.groupBy("y").count().collect():
        totals[r["y"]] = r["count"]
    empty = np.zeros(0, np.uint64)
    if not all(totals):
        share = totals[1] / max(1, sum(totals))
        return Model(empty, np.zeros(0), float(np.log(share + 1e-9) - np.log(1 - share + 1e-9)))
    _, term_ids = extract(pa.array([t for g in groups for t in g], pa.string()))
    table = np.union1d(hf.choose(labelled, extract, totals, features), term_ids)
    y, edges, at = hf.gather(labelled, extract, table)
    rows = np.repeat(np.arange(len(y)), np.diff(edges))
    # a swap's change of the score: the weights it loses less those it gains
    changes = score_changes(labelled, table, groups)
    sides = [(k, place, s) for k, (lost, gained, _) in enumerate(changes) for places, s in ((lost, 1.0), (gained, -1.0)) for place in places]
    swap, place = (np.array([x[i] for x in sides], dtype=np.int64) for i in (0, 1))
    sign = np.array([x[2] for x in sides], dtype=float)
    pairs = np.array([n for _, _, n in changes], dtype=float)
    force = 2 * penalty * len(y) * pairs / max(1.0, pairs.sum())          # of a difference, by its share of the pairs

    def gradient(w: np.ndarray, c: float) -> tuple[np.ndarray, float]:
        p = hf.sigmoid(c + np.bincount(rows, weights=w[at], minlength=len(y)))
        g = np.bincount(at, weights=(p - y)[rows], minlength=len(w)) + ridge * w
        if len(force):
            change = np.bincount(swap, weights=sign * w[place], minlength=len(force))
            g = g + np.bincount(place, weights=sign * (force * change)[swap], minlength=len(w))
        return g, float((p - y).sum())

    # diagonal preconditioning with momentum: the same steps on every run
    curve = np.bincount(at, minlength=len(table)) * 0.1 + ridge
    if len(force):
        curve = curve + np.bincount(place, weights=(force * np.bincount(swap, minlength=len(force)))[swap], minlength=len(table))
    w, c = np.zeros(len(table)), float(np.log(totals[1] / totals[0]))
    vw, vc = np.zeros(len(table)), 0.0
    for _ in range(400):
        g, gc = gradient(w, c)
        vw = 0.9 * vw - 0.1 * g / curve
        vc = 0.9 * vc - 0.1 * gc / (0.1 * len(y))
        w, c = w + vw, c + vc
    return Model(table, w, c, int(pairs.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score double) for each row of ``docs`` (doc_id, text)."""
    def run(batches):
        lookup = hf.Lookup(model.table)
        for part in shared_keys.slices(batches):
            x = hf.linear(part.column("text"), extract, lookup, model.weights)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(hf.sigmoid(x + model.intercept))],
                                             names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of the sampled labelled documents that aren't held out: of rows that share an id, the first text."""
    known = (labels.where("toxic is not null and doc_id is not null").where(~held_out())
             .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("y")))
    sample = hf.sample_labelled(known, limit, SEED)
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")     # at most ``limit`` rows of 12 bytes
    return rated.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def op2_toxicity_counterfactual(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(training_rows(docs, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
