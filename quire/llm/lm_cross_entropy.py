"""LM scoring by cross-entropy difference.

Two n-gram models of the same form are compared token by token: one of target
texts (by default the documents rated good and not toxic), one of the background
(all documents).  They are matched: one vocabulary, one order (bigrams), one
smoothing, and the background's counts are scaled to the target's token count, so
that neither model is sharper only because it saw more.  A token's loss is
-log p(word | word before); a document's score is the mean over its tokens of
(target loss - background loss), lower for texts like the target.

Words are lower-cased ``[^\\x20\\x09-\\x0D]+`` without ASCII punctuation; a document
starts from an empty context.  Every occurrence in every document is counted, by
64-bit hashes of words and of (word before, word): no n-gram shares a count with
another, however many there are.

    p(w)     = (c(w) + 1) / (N + V)        V: distinct words
    p(w | h) = (c(h, w) + MASS * p(w)) / (c(h) + MASS)

*Steps.*  Map tasks cut the documents into chunks of about ``CHUNK`` tokens.  A chunk
sends its distinct n-grams, sorted, with their counts in it, to ranges of the hash (one
packed row for each range) and its compressed texts beside them.  A range's task
sums the counts and answers each chunk in the order it asked; the chunk's texts and
answers meet in one more shuffle, where the documents are scored.  A frequent
n-gram is one entry a chunk; a range holds about ``RANGE`` tokens' n-grams, and their
number follows from the input, so no task holds more than a share of the models, and
neither the driver nor a broadcast holds any of them.

Defined results: null and empty texts have no tokens and null scores; without
target texts the models are equal and all scores 0; repeated rows are each counted
and scored; repeated labels count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import hashed_features as hf
from quire.llm import shared_keys, wordhash
from quire.llm.tables import broadcast_if_small

MASS = 50.0
#: Tokens of a chunk, about (a text is never cut).
CHUNK = 1 << 21
#: Tokens whose n-grams one range of the hash holds, about.
RANGE = 1 << 20
#: A map task sends its word counts on when so many are held.
_FOLD = 1 << 20
#: The empty context, as a word hash.
_START = np.uint64(1)
_CODEC = pa.Codec("zstd", 1)
_ROWS = "to bigint, chunk bigint, part bigint, size bigint, first binary, second binary"
_NAMES = ["to", "chunk", "part", "size", "first", "second"]


class Totals(NamedTuple):
    background: int      # tokens of all rows
    target: int          # tokens of target rows
    words: int           # distinct words


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, hash of the word before and the word) of every token."""
    w = wordhash.words(texts, lower=True, strip=hf.PUNCTUATION)
    before = np.full(len(w.hash), _START)
    before[1:] = w.hash[:-1]
    before[w.first[:-1][np.diff(w.first) > 0]] = _START
    return w.row, w.hash, wordhash.mix(before * np.uint64(0x9E3779B97F4A7C15) + w.hash)


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers, their bytes by place and compressed."""
    return _CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(_CODEC.decompress(data, decompressed_size=size * 8, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).reshape(-1).view(np.int64)


class _Chunk:
    """Documents and the n-grams they hold."""

    def __init__(self, parts: list[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]):
        """``parts``: batches (doc_id, text, target), each with its ``tokens``."""
        self.rows = sum(batch.num_rows for batch, _ in parts)
        at = np.cumsum([0, *[batch.num_rows for batch, _ in parts]])
        self.row = np.concatenate([row + a for a, (_, (row, _, _)) in zip(at, parts)])
        n = len(self.row)
        self.keys, place = np.unique(np.concatenate([[_START], *[f[1] for _, f in parts], *[f[2] for _, f in parts]]), return_inverse=True)
        start, self.word, self.pair = place[0], place[1:n + 1], place[n + 1:]
        self.begins = np.ones(n, dtype=bool)
        self.begins[1:] = self.row[1:] != self.row[:-1]
        self.before = np.where(self.begins, start, np.append(start, self.word[:-1])[:n])

    def counts(self, target: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of ``keys``, in all rows or in those where ``target``."""
        of = np.ones(len(self.row), dtype=bool) if target is None else target[self.row]
        count = np.bincount(self.word[of], minlength=len(self.keys)) + np.bincount(self.pair[of], minlength=len(self.keys))
        return (count + np.bincount(self.before[of & self.begins], minlength=len(self.keys))).astype(np.int64)

    def losses(self, count: np.ndarray, n: float, words: int) -> np.ndarray:
        """Sum of the rows' losses, by a model of ``n`` tokens with ``count`` of ``keys``."""
        p = (count[self.word] + 1) / (n + words)
        loss = np.log(count[self.before] + MASS) - np.log(count[self.pair] + MASS * p)
        return np.bincount(self.row, weights=loss, minlength=self.rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_NAMES)


def _ask(batches, ranges: int, size: int):
    """Batches (doc_id, text, target) -> for each chunk its texts (part < 0), and its n-grams with counts by range (part >= 0)."""
    task, number = TaskContext.get().partitionId(), 0

    def sent(parts):
        nonlocal number
        texts = []
        for batch, _ in parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            texts.append(sink.getvalue().to_pybytes())
        digest = hashlib.blake2b(f"{task} {number}".encode(), digest_size=8)       # the same if the task runs again on the same rows
        for text in texts:
            digest.update(text)
        chunk, number = int.from_bytes(digest.digest(), "little", signed=True), number + 1
        for k, text in enumerate(texts):
            yield _rows([(chunk % ranges, chunk, k - len(texts), 0, text, None)])
        held = _Chunk(parts)
        target = np.concatenate([batch.column("target").to_numpy(zero_copy_only=False) for batch, _ in parts])
        back, goal = held.counts(), held.counts(target)
        edges = np.searchsorted(held.keys, np.array([(r << 64) // ranges for r in range(ranges)], np.uint64))
        spans = zip(range(ranges), edges, np.append(edges[1:], len(held.keys)))
        asked = [(r, chunk, r, b - a, _packed(np.diff(held.keys[a:b], prepend=np.uint64(0))),
                  _packed(np.concatenate([back[a:b], goal[a:b]]))) for r, a, b in spans if b > a]
        for a in range(0, len(asked), 256):
            yield _rows(asked[a:a + 256])

    parts, n = [], 0
    for batch in shared_keys.slices(batches):
        found = tokens(batch.column("text"))
        parts.append((batch, found))
        n += len(found[0])
        if n >= size:
            yield from sent(parts)
            parts, n = [], 0
    if parts:
        yield from sent(parts)


def _answer(batches):
    """Rows sorted by range -> the counts over all chunks, to each chunk in the order it asked; texts pass."""
    def answers(held):
        keys = np.concatenate([np.cumsum(_unpacked(first, n).view(np.uint64), dtype=np.uint64) for _, _, n, first, _ in held])
        _, place = np.unique(keys, return_inverse=True)
        counts = [_unpacked(second, 2 * n).reshape(2, n) for _, _, n, _, second in held]
        total = [np.zeros(int(place.max()) + 1, np.int64) for _ in range(2)]
        for k in range(2):
            np.add.at(total[k], place, np.concatenate([c[k] for c in counts]))
        at = 0
        for a in range(0, len(held), 256):
            out = []
            for chunk, part, n, _, _ in held[a:a + 256]:
                here = place[at:at + n]
                out.append((0, chunk, part, n, _packed(total[0][here]), _packed(total[1][here])))
                at += n
            yield _rows(out)

    at, held = None, []
    for batch in batches:
        passing = batch.filter(pc.less(batch.column("part"), 0))
        if passing.num_rows:
            yield passing
        asks = batch.filter(pc.greater_equal(batch.column("part"), 0))
        for chunk, part, n, first, second in zip(*[asks.column(c).to_pylist() for c in _NAMES[1:]]):
            if part != at and held:
                yield from answers(held)
                held = []
            at = part
            held.append((chunk, part, n, first, second))
    if held:
        yield from answers(held)


def _score(batches, totals: Totals):
    """Rows sorted by (chunk, part) -> its documents' scores."""
    words = max(1, totals.words)
    scale = totals.target / totals.background if totals.target else 1.0

    def scored(texts, answers):
        parts = [batch for text in texts for batch in pa.ipc.open_stream(text)]
        held = _Chunk([(batch, tokens(batch.column("text"))) for batch in parts])
        back, goal = (np.concatenate([_unpacked(a[k], a[0]) for a in answers]) for k in (1, 2))
        if len(back) != len(held.keys):
            raise RuntimeError(f"a chunk has {len(held.keys)} n-grams, and counts of {len(back)}")
        n = np.bincount(held.row, minlength=held.rows)
        background = held.losses(back * scale, totals.background * scale, words)
        target = held.losses(goal.astype(np.float64), totals.target, words) if totals.target else background
        means = [s / np.maximum(n, 1) for s in (target, background)]
        ids = pa.concat_arrays([batch.column("doc_id") for batch in parts])
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n.astype(np.int64)), *[pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1])]],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    at, texts, answers = None, [], []
    for batch in batches:
        for chunk, part, n, first, second in zip(*[batch.column(c).to_pylist() for c in _NAMES[1:]]):
            if chunk != at and texts:
                yield from scored(texts, answers)
                texts, answers = [], []
            at = chunk
            if part < 0:
                texts.append(first)
            else:
                answers.append((n, first, second))
    if texts:
        yield from scored(texts, answers)


def _count_words(batches):
    """Batches (text, target) -> folded rows (word, background count, target count)."""
    def rows(held):
        word, back, goal = (np.concatenate([h[i] for h in held]) for i in range(3))
        unique, at = np.unique(word, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(wordhash.signed(unique)), *[pa.array(np.bincount(at, weights=c).astype(np.int64)) for c in (back, goal)]],
            names=["word", "background", "target"])

    held, n = [], 0
    for part in shared_keys.slices(batches):
        row, word, _ = tokens(part.column("text"))
        if not len(word):
            continue
        target = part.column("target").to_numpy(zero_copy_only=False)[row]
        unique, at = np.unique(word, return_inverse=True)
        held.append((unique, np.bincount(at), np.bincount(at, weights=target)))
        n += len(unique)
        if n > _FOLD:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def count(docs: DataFrame) -> Totals:
    """Tokens and distinct words of ``docs`` (text, target: boolean)."""
    words = (docs.select("text", "target").mapInArrow(_count_words, "word bigint, background bigint, target bigint")
             .groupBy("word").agg(F.sum("background").alias("background"), F.sum("target").alias("target")))
    row = words.agg(F.sum("background"), F.sum("target"), F.count(F.lit(1))).first()
    return Totals(*[v or 0 for v in row])


def cross_entropy_difference(docs: DataFrame, is_target: Column, chunk: int = CHUNK, range_tokens: int = RANGE) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for each row of ``docs`` (doc_id, text, ...),
    by models of its rows where ``is_target`` and of all its rows."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(is_target, F.lit(False)).alias("target"))
    totals = count(docs)
    ranges = max(1, -(-totals.background // range_tokens))
    return (docs.mapInArrow(lambda it: _ask(it, ranges, chunk), _ROWS)
            .repartition("to").sortWithinPartitions("to", "part", "chunk").mapInArrow(_answer, _ROWS)
            .repartition("chunk").sortWithinPartitions("chunk", "part")
            .mapInArrow(lambda it: _score(it, totals),
                        "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, difference double"))


def op3_lm_cross_entropy(spark, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference; target: documents rated good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
            .select("doc_id", F.lit(True).alias("good")))
    return cross_entropy_difference(docs.join(broadcast_if_small(good), "doc_id", "left"), F.col("good"))
