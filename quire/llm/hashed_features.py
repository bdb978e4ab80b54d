"""Hashed binary text features: choosing, gathering and scoring them on Spark.

A feature is a 64-bit hash; a document has it or not.  Classifiers of this
package keep ``n`` features that tell labelled documents apart (a likelihood-
ratio test, counted by Spark), gather the labelled documents restricted to
these few features for the fit, and score every document with a sparse weight
table of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash

#: ASCII punctuation, taken as separators where a word's marks don't matter.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True

Extract = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def distinct(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, id) pairs, sorted by row."""
    order = np.lexsort((ids, rows))
    rows, ids = rows[order], ids[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    return rows[keep], ids[keep]


def sample_labelled(labels: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` rows (doc_id, y) by the order of a hash of doc_id: a fixed
    sample whatever the partitions.  Repeated doc_ids must be merged before."""
    return labels.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)


def _counts(batches, extract: Extract, levels: int):
    for batch in batches:
        found = []
        y = batch.column("y").to_numpy()
        for part in shared_keys.slices(iter([batch])):
            rows, ids = distinct(*extract(part.column("text")))
            found.append((ids, part.column("y").to_numpy()[rows]))
        ids = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
        grade = np.concatenate([f[1] for f in found]) if found else y[:0]
        unique, at = np.unique(ids, return_inverse=True)
        table = np.bincount(at * levels + grade, minlength=len(unique) * levels).reshape(-1, levels)
        yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), *[pa.array(table[:, k]) for k in range(levels)]],
                                         names=["id", *[f"n{k}" for k in range(levels)]])


def choose(labelled: DataFrame, extract: Extract, totals: list[int], n: int, least: int = 3) -> np.ndarray:
    """The ``n`` features (sorted uint64) of ``labelled`` (text, y: 0 ...) whose
    document counts by label differ most (likelihood ratio), each in ``least``
    documents or more.  ``totals``: documents by label."""
    levels, grand = len(totals), sum(totals)
    counted = labelled.select("text", "y").mapInArrow(
        lambda it: _counts(it, extract, levels), "id bigint, " + ", ".join(f"n{k} bigint" for k in range(levels)))
    each = counted.groupBy("id").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(levels)])
    seen = sum(F.col(f"n{k}") for k in range(levels))
    gain = F.lit(0.0)
    for k, total in enumerate(totals):
        if total:
            for have, base in ((F.col(f"n{k}"), seen), (F.lit(total) - F.col(f"n{k}"), F.lit(grand) - seen)):
                gain = gain + F.when(have > 0, have * F.log(have * grand / (base * total))).otherwise(0.0)
    best = (each.where(seen >= least).select("id", gain.alias("g")).orderBy(F.col("g").desc(), "id").limit(n)
            .where("g > 5").select("id").toPandas())
    return np.sort(best["id"].to_numpy(dtype=np.int64).view(np.uint64))


class Lookup:
    """Positions of feature hashes in a sorted table; most misses stop at a bitmap."""

    def __init__(self, table: np.ndarray, bits: int = 18):
        self.table, self.shift = table, np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(table >> self.shift).astype(np.int64)] = True

    def find(self, rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, position) pairs of the ids that the table has."""
        if not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        may = np.flatnonzero(self.seen[(ids >> self.shift).astype(np.int64)])
        rows, ids = rows[may], ids[may]
        at = np.searchsorted(self.table, ids)
        at[at == len(self.table)] = 0
        ok = self.table[at] == ids
        both = np.unique(rows[ok] * len(self.table) + at[ok])
        return both // len(self.table), both % len(self.table)


def gather(labelled: DataFrame, extract: Extract, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, offsets, feature positions) of the labelled documents (a bounded sample), for a fit on the driver."""
    def run(batches):
        lookup = Lookup(table)
        for part in shared_keys.slices(batches):
            rows, at = lookup.find(*extract(part.column("text")))
            edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), lists], names=["doc_id", "y", "at"])

    got = labelled.select("doc_id", "text", "y").mapInArrow(run, "doc_id bigint, y int, at array<int>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    lists = got.column("at").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    return (got.column("y").to_numpy().astype(np.int64), np.append(0, np.cumsum(sizes)).astype(np.int64),
            lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def linear(texts: pa.Array, extract: Extract, lookup: Lookup, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's features."""
    rows, at = lookup.find(*extract(texts))
    return np.bincount(rows, weights=weights[at], minlength=len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
