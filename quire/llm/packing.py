"""Packing documents into sequences by cutting-stock column generation.

A document's ids are its text's byte-level BPE ids, then id 0.  It is cut into full
sequences and one rest; the lengths' histogram goes to the driver (at most ``CAPACITY``
rows), where ``cutting_stock`` finds patterns of lengths that fill sequences.  On
the cluster the pieces of each length are ranked, and rank and length give each
piece its place in a pattern's sequence: no task sees more than a share of them.
Pieces that no well-filled pattern holds are laid end to end and cut where a
sequence is full; only the documents that this cuts are tokenised again.

Ranks are made in two steps: pieces are numbered within (length, hash bucket), and
the buckets' counts are summed, so that a length which a third of all pieces have is
not sorted in one task.

Tokenising: the vocabulary file's merges run in ``tiktoken`` (about five times as
fast as ``tokenizers`` on the same file, with the same ids); texts with one of the
file's special strings or a very long word go to ``tokenizers`` itself.

Defined results: null and empty texts are one piece of one id (0); repeated rows are
packed each; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import cutting_stock, shared_keys
from quire.llm.tables import broadcast_if_small
from quire.session import ensure_checkpoint_dir

CAPACITY = 1024
END = 0
#: Pieces numbered in one task, about.
BUCKET_ROWS = 50_000
#: How the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG = re.compile(r"\S{2000}")
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: With the hash of the row that a piece is of: doc_ids may be null or repeat.
_KEYED = _PIECES + ", row_key bigint"
_PLACED = _KEYED + ", sequence_id bigint, slot bigint, at bigint, cuts boolean"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def _reference(path: str):
    """The vocabulary file's own tokenizer; loaded only where a text needs it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _fast(path: str):
    """(fast encoder, special strings) of a vocabulary file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of, special = _byte_of(), [t["content"] for t in spec["added_tokens"]]
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast, special


def encode(text: str | None, path: str) -> np.ndarray:
    """The ids of a document, with the closing id, as little-endian unsigned 32-bit numbers."""
    fast, special = _fast(path)
    text = text or ""
    if any(s in text for s in special) or (len(text) >= 2000 and _LONG.search(text)):
        ids = _reference(path).encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    return np.array([*ids, END], dtype="<u4")


def _cut(batches, path: str, capacity: int):
    for part in shared_keys.slices(batches):
        out = []
        for doc, text, key in zip(*[part.column(c).to_pylist() for c in ("doc_id", "text", "row_key")]):
            ids = encode(text, path)
            n = len(ids)
            out += [(doc, a, min(capacity, n - a), zlib.crc32(ids[a:a + capacity].tobytes()), n, key) for a in range(0, n, capacity)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                         names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"])


class _Places:
    """Where the piece of a length and rank goes: built from ``cutting_stock.plan``."""

    def __init__(self, histogram: dict[int, int], capacity: int, unit: int = cutting_stock.UNIT):
        class_patterns, patterns, loose = cutting_stock.plan(histogram, capacity, unit)
        self.capacity, self.unit, sequence = capacity, unit, 0
        by_class: dict[int, list] = {}
        for pieces, times in class_patterns:
            sequence = self._add(by_class, pieces, times, sequence)
        exact: dict[int, list] = {}
        for pieces, times in patterns:
            sequence = self._add(exact, pieces, times, sequence)
        # ranks of a length: first those that its class uses (longest lengths first), then patterns, then the stream
        self.class_start, self.class_use = {}, {}
        for k, slots in by_class.items():
            used = start = 0
            total = sum(n for _, n, _, _ in slots)
            for length in range(min(k * unit, capacity - 1), (k - 1) * unit, -1):
                self.class_start[length] = start
                used = min(total - start, histogram.get(length, 0))
                self.class_use[length] = used
                start += used
        self.by_class = {k: self._table(v) for k, v in by_class.items()}
        self.exact = {k: self._table(v) for k, v in exact.items()}
        self.exact_use = {k: sum(n for _, n, _, _ in v) for k, v in exact.items()}
        self.stream_sequence, self.stream_at, at = sequence, {}, 0
        for length in sorted(loose, reverse=True):
            self.stream_at[length] = at
            at += length * loose[length]

    @staticmethod
    def _add(table: dict[int, list], pieces: dict[int, int], times: int, sequence: int) -> int:
        slot = 0
        for k in sorted(pieces, reverse=True):
            table.setdefault(k, []).append((sequence, pieces[k] * times, pieces[k], slot))
            slot += pieces[k]
        return sequence + times

    @staticmethod
    def _table(slots: list) -> tuple[np.ndarray, ...]:
        sequence, ranks, copies, slot = (np.array(x, dtype=np.int64) for x in zip(*slots))
        return np.append(0, np.cumsum(ranks)), sequence, copies, slot

    @staticmethod
    def _find(table, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto, sequence, copies, slot = table
        k = np.searchsorted(upto, rank, "right") - 1
        inside = rank - upto[k]
        return sequence[k] + inside // copies[k], slot[k] + inside % copies[k]

    def of(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, slot in it, -1 or the position in the stream) of the pieces of one length with these ranks."""
        sequence, slot = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        at = np.full(len(rank), -1, dtype=np.int64)
        a = self.class_use.get(length, 0)
        b = a + self.exact_use.get(length, 0)
        first, second, third = rank < a, (rank >= a) & (rank < b), rank >= b
        if first.any():
            sequence[first], slot[first] = self._find(self.by_class[-(-length // self.unit)], self.class_start[length] + rank[first])
        if second.any():
            sequence[second], slot[second] = self._find(self.exact[length], rank[second] - a)
        if third.any():
            at[third] = self.stream_at[length] + (rank[third] - b) * length
            sequence[third], slot[third] = self.stream_sequence + at[third] // self.capacity, at[third] % self.capacity
        return sequence, slot, at


def _place(batches, places: _Places):
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, slot, at = (np.zeros(len(length), np.int64) for _ in range(3))
        order = np.argsort(length, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            sequence[group], slot[group], at[group] = places.of(int(length[group[0]]), rank[group])
        cuts = (at >= 0) & (at // places.capacity != (at + length - 1) // places.capacity)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key")],
             pa.array(sequence), pa.array(slot), pa.array(at), pa.array(cuts)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key", "sequence_id", "slot", "at", "cuts"])


def _cut_again(batches, path: str, capacity: int):
    """Pieces that a sequence's end cuts, with their text -> both parts."""
    for part in shared_keys.slices(batches):
        out = []
        rows = zip(*[part.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "at", "text")])
        for doc, start, length, crc, n, sequence, at, text in rows:
            ids = encode(text, path)
            if len(ids) != n or zlib.crc32(ids[start:start + length].tobytes()) != crc:
                continue                                      # another row of the same hash
            head = capacity - at % capacity
            for s, size, q, slot in ((start, head, sequence, at % capacity), (start + head, length - head, sequence + 1, 0)):
                out.append((doc, s, size, zlib.crc32(ids[s:s + size].tobytes()), n, q, slot))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = path or vocabulary_path()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    pieces = docs.mapInArrow(lambda it: _cut(it, path, capacity), _KEYED).checkpoint()            # numbers only
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}   # <= capacity rows
    places = _Places(histogram, capacity)
    buckets = max(1, -(-max(histogram.values(), default=0) // bucket_rows))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .select(F.col("length").alias("l"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before.partitionBy("length")), F.lit(0)).alias("skip")))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (dealt.withColumn("n", F.row_number().over(within) - 1)
              .join(broadcast_if_small(offsets), (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key", (F.col("n") + F.col("skip")).cast("bigint").alias("rank")))
    held = spark.sparkContext.broadcast(places)
    placed = ranked.mapInArrow(lambda it: _place(it, held.value), _PLACED).checkpoint()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
    cut = broadcast_if_small(placed.where("cuts"))
    texts = docs.join(cut.select("row_key"), "row_key", "left_semi").select("row_key", "text").distinct()      # equal rows once
    again = (texts.join(cut.drop("slot", "cuts"), "row_key").mapInArrow(
        lambda it: _cut_again(it, path, capacity), _PIECES + ", sequence_id bigint, slot bigint").dropDuplicates())
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.where("not cuts").select(*columns).unionByName(again.select(*columns))
            .withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("bigint")).drop("slot"))


def token_sequences(pieces: DataFrame, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences, without padding.  A
    sequence has ``CAPACITY`` ids at most, so it fits one task."""
    path = path or vocabulary_path()

    def run(batches):
        for part in shared_keys.slices(batches):
            rows = list(zip(*[part.column(c).to_pylist() for c in ("sequence_id", "offset", "start", "length", "text")]))
            ids = [encode(t, path)[s:s + n].astype(np.int32) for _, _, s, n, t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "offset", "ids"])

    parts = (docs.select("doc_id", "text").join(pieces.select("doc_id", "sequence_id", "offset", "start", "length"), "doc_id")
             .mapInArrow(run, "sequence_id bigint, offset bigint, ids array<int>"))
    return (parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.col("p.ids")).alias("ids")))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
