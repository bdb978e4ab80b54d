"""Which documents share a key, without a join and without hot reducers.

Several operators emit many (key, document) rows and need, for each key that
two or more documents have, the smallest of these documents:

1. ``combine`` runs in the map tasks.  It folds the documents of a batch that
   share a key into one row (key, smallest document, the other documents
   packed), so a key that a third of all documents have leaves a map task as a
   few rows.
2. ``recurring`` shuffles these rows by key, sorts them within partitions
   (Spark's external sort) and reads each run once, in constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COMBINED = "key bigint, first bigint, others binary"
SHARED = "doc bigint, key bigint, first bigint, salt int"
_COMBINED = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("others", pa.binary())])
_SHARED = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("salt", pa.int32())])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about ``max_bytes`` of text (one row at least)."""
    for batch in batches:
        column = batch.column(text)
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
            if len(column) else np.zeros(1, np.int64)
        at, n = 0, len(column)
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), at + max_rows, n)
            yield batch.slice(at, to - at)
            at = to


def combine(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """One row for each key: its smallest document, and the others packed as int64."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    if len(k):
        fresh = np.empty(len(k), dtype=bool)
        fresh[0] = True
        np.not_equal(k[1:], k[:-1], out=fresh[1:])
        keep = fresh.copy()
        keep[1:] |= d[1:] != d[:-1]
        k, d, fresh = k[keep], d[keep], fresh[keep]
    else:
        fresh = np.zeros(0, dtype=bool)
    at = np.flatnonzero(fresh)
    sizes = np.diff(np.append(at, len(k))) - 1
    offsets = np.zeros(len(at) + 1, np.int32)
    np.cumsum(sizes * 8, out=offsets[1:])
    data = d[~fresh].astype("<i8")
    valid = np.packbits(sizes > 0, bitorder="little")
    others = pa.Array.from_buffers(pa.binary(), len(at),
                                   [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(k[at].view(np.int64)), pa.array(d[at]), others], schema=_COMBINED)


def combined(df: DataFrame, emit: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]],
             text: str | None = "text") -> DataFrame:
    """``emit`` gives (keys, documents) of a batch of ``df``; the result has ``COMBINED``."""
    def run(batches):
        for batch in batches:
            found = [emit(part) for part in (slices(iter([batch]), text) if text else [batch])]
            if found:
                yield combine(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))

    return df.mapInArrow(run, COMBINED)


def _unpack(others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents of each row, all documents) of a packed column."""
    others = others.cast(pa.large_binary())
    offs = np.frombuffer(others.buffers()[1], np.int64)[others.offset:others.offset + len(others) + 1] if len(others) else np.zeros(1, np.int64)
    data = others.buffers()[2] if len(others) else None
    counts = np.diff(offs) // 8
    if data is None or not counts.sum():
        return counts, np.zeros(0, np.int64)
    return counts, np.frombuffer(data, np.uint8)[offs[0]:offs[-1]].view("<i8")


def _runs(batches: Iterator[pa.RecordBatch], salt_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, first) -> ``SHARED`` rows of the keys with two documents or more.

    A document behind the first gets the number of ``salt_rows`` that came
    before it as its salt; the first document's row comes when the run ends
    and has the number of salts.
    """
    key = first = None
    seen = 0                                    # documents of the open run, behind its first
    for batch in batches:
        k = batch.column(0).to_numpy()
        f = batch.column(1).to_numpy()
        counts, others = _unpack(batch.column(2))
        if not len(k):
            continue
        fresh = np.empty(len(k), dtype=bool)
        fresh[0] = key is None or k[0] != key
        np.not_equal(k[1:], k[:-1], out=fresh[1:])
        # every row lists its smallest document, then the others
        sizes = counts + 1
        ends = np.cumsum(sizes)
        docs = np.empty(int(ends[-1]), np.int64)
        lead = ends - sizes
        is_lead = np.zeros(len(docs), dtype=bool)
        is_lead[lead] = True
        docs[lead] = f
        docs[~is_lead] = others
        row = np.repeat(np.arange(len(k)), sizes)
        at = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - (1 if fresh[0] else 0)      # 0 is the open run, unless the first row starts one
        starts = at if fresh[0] else np.append(0, at)
        firsts = f[starts].copy()
        if not fresh[0]:
            firsts[0] = first
        doc_run = run[row]
        behind = docs != firsts[doc_run]
        index = np.cumsum(behind)
        begin = lead[starts]
        base = np.where(begin > 0, index[begin - 1], 0)
        rank = index - 1 - base[doc_run]
        had = seen if not fresh[0] else 0
        rank = rank + np.where(doc_run == 0, had, 0)
        per_run = np.bincount(doc_run[behind], minlength=len(starts))
        per_run[0] += had
        out_doc, out_run = docs[behind], doc_run[behind]
        out_salt = (rank[behind] // salt_rows).astype(np.int32)
        out_key, out_first = k[starts][out_run], firsts[out_run]
        done = np.flatnonzero(per_run[:-1] > 0)              # the last run stays open
        tails = [(firsts[done], k[starts][done], firsts[done], -(-per_run[done] // salt_rows))]
        if fresh[0] and key is not None and seen:            # the run of an earlier batch has ended
            tails.append((np.array([first]), np.array([key]), np.array([first]), np.array([-(-seen // salt_rows)])))
        parts = [(out_doc, out_key, out_first, out_salt), *tails]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([p[i] for p in parts]).astype(np.int32 if i == 3 else np.int64)) for i in range(4)],
            schema=_SHARED)
        key, first, seen = int(k[-1]), int(firsts[-1]), int(per_run[-1])
    if key is not None and seen:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([key], pa.int64()),
                                          pa.array([first], pa.int64()), pa.array([-(-seen // salt_rows)], pa.int32())], schema=_SHARED)


def recurring(rows: DataFrame, salt_rows: int = 1 << 30) -> DataFrame:
    """``SHARED`` rows (doc, key, first, salt) for each key of two documents or more.

    ``rows`` has ``COMBINED``.  The row of a key's first document (doc =
    first) has the number of salts of that key, the rows of the others the
    salt they belong to (0 to that number - 1), ``salt_rows`` documents each.
    """
    return (rows.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(lambda it: _runs(it, salt_rows), SHARED))
