"""Substring dedup with repeated-phrase automata.

A word is ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` consecutive words of a
document.  Every word is removed that lies in a window whose words also start
in a document with a smaller ``doc_id``.  The steps, one lazy Spark plan:

1. *Candidates.*  A window's anchor is the least hash of the ``ANCHOR``-word
   phrases in it, so equal windows have equal anchors, and neighbouring windows
   mostly share theirs (about a quarter as many anchors as words).
   ``shared_keys`` finds the anchors that two or more documents have, and the
   smallest of these documents.
2. *Automata.*  Shards are keyed by an anchor's first document: it sends the
   passages that hold its shared anchors, the later documents send theirs.  A
   shard compiles the first document's windows into an Aho-Corasick automaton
   (pyahocorasick, over word numbers) and streams the later passages through it;
   every occurrence is confirmed word by word.  The shards of an anchor that
   very many documents share are salted (``SALT_ROWS`` documents each).
3. *The rest.*  A window whose anchor is shared, but which the anchor's first
   document does not have, may still repeat between later documents.  These
   windows meet by a 128-bit hash (again ``shared_keys``' way).
4. *Cut.*  The confirmed windows meet their document's text; covered words go.

Each document's text is scanned whole.  Nothing is collected to the driver, and
no task holds more than one shard's passages: at most the passages of one
document as patterns, with the others streamed by.

Defined results: null or empty text has no words and loses none; a text with
fewer than ``WINDOW`` words loses none; rows that share a ``doc_id`` count as one
document (neither removes the other's words); a row without ``doc_id`` neither
loses words nor makes others lose them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash

WINDOW = 13
ANCHOR = 6
SALT_ROWS = 200

_PASSAGE = "first bigint, salt int, role int, doc bigint, start bigint, passage string"
_PASSAGE_ARROW = pa.schema([("first", pa.int64()), ("salt", pa.int32()), ("role", pa.int32()), ("doc", pa.int64()),
                            ("start", pa.int64()), ("passage", pa.string())])
_FOUND = "key bigint, key2 bigint, doc bigint, at binary"
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("at", pa.binary())])
_REMOVED_ARROW = pa.schema([("doc", pa.int64()), ("at", pa.binary())])


def _anchors(w: wordhash.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, anchor) of every window."""
    n = len(w.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    phrase = np.full(len(w.hash) - anchor + 1, np.uint64(anchor), dtype=np.uint64)
    for k in range(anchor):
        phrase = phrase * np.uint64(0xD6E8FEB86659FD93) + w.hash[k:k + len(phrase)]
    phrase = wordhash.mix(phrase)
    span, least = 1, phrase                     # least over 1, 2, 4, ... phrases, then over all of a window
    width = window - anchor + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    at = np.flatnonzero(w.row[:n] == w.row[window - 1:])
    return at, least[:n][at]


def _emit_anchors(batch: pa.RecordBatch, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    w = wordhash.words(batch.column("text"))
    at, least = _anchors(w, window, anchor)
    row = w.row[at]
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    return least[keep].view(np.int64), batch.column("doc_id").to_numpy()[row[keep]]


def _passages(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Documents with their shared anchors -> the passages that hold these."""
    for batch in shared_keys.slices(batches):
        listed = batch.column("_anchors")
        batch = batch.filter(listed.is_valid())
        if not batch.num_rows:
            continue
        w = wordhash.words(batch.column("text"))
        at, least = _anchors(w, window, anchor)
        least = least.view(np.int64)
        buf, _ = wordhash.utf8(batch.column("text"))
        edges = np.searchsorted(w.row[at], np.arange(batch.num_rows + 1))
        docs, listed = batch.column("doc_id").to_numpy(), batch.column("_anchors")
        out: list[tuple] = []
        for r in range(batch.num_rows):
            lo, hi = edges[r], edges[r + 1]
            if lo == hi:
                continue
            doc, begin = int(docs[r]), int(w.first[r])
            key, first, salt = (listed[r].values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(key, kind="stable")
            key, first, salt = key[order], first[order], salt[order]
            hit = np.searchsorted(key, least[lo:hi])
            hit[hit == len(key)] = 0
            ok = key[hit] == least[lo:hi]
            home, part = first[hit], salt[hit]
            turn = np.flatnonzero(np.append(True, (ok[1:] != ok[:-1]) | (home[1:] != home[:-1]) | (part[1:] != part[:-1])))
            for a, b in zip(turn, np.append(turn[1:], hi - lo)):
                if not ok[a]:
                    continue
                s, e = int(at[lo + a]), int(at[lo + b - 1]) + window
                passage = b" ".join(bytes(buf[w.start[s]:w.end[e - 1]]).split()).decode()
                if home[a] == doc:              # the first document serves every salt of the anchor
                    out += [(doc, p, 0, doc, s - begin, passage) for p in range(int(part[a]))]
                else:
                    out.append((int(home[a]), int(part[a]), 1, doc, s - begin, passage))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PASSAGE_ARROW)],
                                             schema=_PASSAGE_ARROW)


class _Shard:
    """The automaton of one first document's windows, over word numbers."""

    def __init__(self, window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.compiled = False

    def add(self, passage: str) -> None:
        numbers = self.numbers
        seq = [numbers.setdefault(x, len(numbers) + 1) for x in passage.encode().split(b" ")]
        for i in range(len(seq) - self.window + 1):
            self.automaton.add_word(tuple(seq[i:i + self.window]), 1)

    def occurrences(self, passage: str) -> list[int]:
        """First words of the windows of the passage that the first document has."""
        if not len(self.automaton):
            return []
        if not self.compiled:
            self.automaton.make_automaton()
            self.compiled = True
        get = self.numbers.get
        back = self.window - 1
        return [end - back for end, _ in self.automaton.iter(tuple([get(x, 0) for x in passage.encode().split(b" ")]))]


def _pairs(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows (key, key2, smallest doc, packed (doc, at) pairs), one for each key."""
    order = np.lexsort((at, doc, keys[1], keys[0]))
    k1, k2, doc, at = keys[0][order], keys[1][order], doc[order], at[order]
    fresh = np.ones(len(k1), dtype=bool)
    fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    begin = np.flatnonzero(fresh)
    packed = np.column_stack([doc, at]).astype("<i8")
    offsets = (np.append(begin, len(k1)) * 16).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(k1[begin]), pa.array(k2[begin]), pa.array(doc[begin]), blob], schema=_FOUND_ARROW)


def _locate(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Passages sorted by (first, salt, role) -> occurrences (key2 null) and the windows left over."""
    shard, shard_key = _Shard(window), None
    for batch in shared_keys.slices(batches, "passage"):
        w = wordhash.words(batch.column("passage"))
        at, h1 = wordhash.windows(w, window)
        _, h2 = wordhash.windows(w, window, salt=1)
        edges = np.searchsorted(w.row[at], np.arange(batch.num_rows + 1))
        first, salt, role, doc, start = (batch.column(i).to_numpy() for i in range(5))
        found = np.zeros(len(at), dtype=bool)
        later = np.repeat(role == 1, np.diff(edges))
        for r, passage in enumerate(batch.column("passage").to_pylist()):
            if shard_key != (first[r], salt[r]):
                shard, shard_key = _Shard(window), (first[r], salt[r])
            if role[r] == 0:
                shard.add(passage)
            else:
                hits = shard.occurrences(passage)
                if hits:
                    found[edges[r] + np.array(hits)] = True
        row = w.row[at]
        position = start[row] + at - w.first[row]
        hit, rest = np.flatnonzero(found), np.flatnonzero(later & ~found)
        if len(hit):
            docs = doc[row[hit]]
            done = _pairs([wordhash.mix(docs.astype(np.uint64)).view(np.int64), docs], docs, position[hit])
            yield done.set_column(1, _FOUND_ARROW.field(1), pa.nulls(done.num_rows, pa.int64()))
        if len(rest):
            yield _pairs([h1[rest].view(np.int64), h2[rest].view(np.int64)], doc[row[rest]], position[rest])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, key2, doc) -> windows to remove, packed by document."""
    last, first = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        passed = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        k1, k2 = batch.column(0).to_numpy(), batch.column(1).fill_null(0).to_numpy()
        lead = batch.column(2).to_numpy()
        fresh = np.ones(len(k1), dtype=bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (passed[1:] != passed[:-1])
        fresh[0] = last != (k1[0], k2[0], passed[0])
        group = np.cumsum(fresh) - fresh[0]
        leads = lead[np.flatnonzero(fresh)] if fresh[0] else np.append(first, lead[np.flatnonzero(fresh)])
        blob = batch.column(3).cast(pa.large_binary())
        offs = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset:blob.offset + len(blob) + 1]
        pairs = np.frombuffer(blob.buffers()[2], np.uint8)[offs[0]:offs[-1]].view("<i8").reshape(-1, 2)
        row = np.repeat(np.arange(len(k1)), np.diff(offs) // 16)
        go = passed[row] | (pairs[:, 0] > leads[group[row]])
        last, first = (k1[-1], k2[-1], passed[-1]), leads[-1]
        doc, at = pairs[go, 0], pairs[go, 1]
        if len(doc):
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order].astype("<i8")
            begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            offsets = (np.append(begin, len(doc)) * 8).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[begin]), pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(at.tobytes())])],
                schema=_REMOVED_ARROW)


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Documents with their windows to remove -> text without them, and counts."""
    for batch in shared_keys.slices(batches):
        w = wordhash.words(batch.column("text"), hashed=False)
        buf, _ = wordhash.utf8(batch.column("text"))
        removed, sums, texts = [], [], []
        for r, blobs in enumerate(batch.column("_at")):
            lo, hi = int(w.first[r]), int(w.first[r + 1])
            gone = np.zeros(hi - lo + 1, dtype=np.int64)
            for blob in blobs.as_py() or ():
                starts = np.frombuffer(blob, "<i8")
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
            kept = np.cumsum(gone[:-1]) == 0
            removed.append(int(len(kept) - kept.sum()))
            if not removed[-1]:
                raw = bytes(buf[w.start[lo]:w.end[hi - 1]]) if hi > lo else b""
                texts.append(batch.column("text")[r].as_py())
                sums.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
            runs = [bytes(buf[w.start[lo + a]:w.end[lo + b - 1]]) for a, b in turn.reshape(-1, 2)]
            texts.append(b" ".join(runs).decode())
            sums.append(hashlib.sha256(b" ".join(x for run in runs for x in run.split())).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(sums, pa.string()),
             pa.array(texts, pa.string()), *[batch.column(c) for c in batch.schema.names if c not in ("doc_id", "text", "_at", "_id")]],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", *[c for c in batch.schema.names if c not in ("doc_id", "text", "_at", "_id")]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``docs`` (doc_id bigint, text string, any others) without repeated windows.

    Adds n_words, n_removed (words) and kept_sha256 (of the kept words joined by
    one space); ``text`` holds the kept stretches of the text, joined by one
    space, and is unchanged where nothing goes.  Columns of ``docs`` with these
    names are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "_at", "_id", "_anchors")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = shared_keys.combined(docs.select("doc_id", "text").where("doc_id is not null and text is not null"),
                                lambda batch: _emit_anchors(batch, window, anchor))
    shared = shared_keys.recurring(rows, salt_rows)
    lists = (shared.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("key", "first", "salt")).alias("_anchors")))
    passages = (docs.join(lists, docs["doc_id"] == lists["_id"], "left")
                .mapInArrow(lambda it: _passages(it, window, anchor), _PASSAGE))
    found = (passages.repartition("first", "salt").sortWithinPartitions("first", "salt", "role")
             .mapInArrow(lambda it: _locate(it, window), _FOUND))
    removed = (found.repartition("key").sortWithinPartitions("key", "key2", "doc")
               .mapInArrow(_confirmed, "doc bigint, at binary")
               .groupBy(F.col("doc").alias("_id")).agg(F.collect_list("at").alias("_at")))
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    out = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string"
    out += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    cut = docs.join(removed, docs["doc_id"] == removed["_id"], "left").mapInArrow(lambda it: _cut(it, window), out)
    return cut.select(*[f.name for f in docs.schema.fields], "n_words", "n_removed", "kept_sha256")


def op5_repeated_phrases(spark, sf_dir: str) -> DataFrame:
    """Every document: its words, those removed, and the digest of the kept ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
starts as (
  select doc_id, unnest(range(1, len(w) - 11)) as p, w from words where len(w) >= 13),
grams as (select doc_id, p, array_to_string(w[p:p + 12], ' ') as g from starts),
least_doc as (select g, min(doc_id) as m from grams group by g),
gone as (select distinct doc_id, p + o.o as q from grams join least_doc using (g), range(0, 13) o(o) where doc_id > m),
each as (
  select doc_id, len(w) as n_words, list_transform(range(1, len(w) + 1), lambda i: i) as idx, w from words),
cut as (select doc_id, list(q) as qs, count(*) as n from gone group by doc_id)
select doc_id, n_words, coalesce(n, 0) as n_removed,
       sha256(array_to_string(case when qs is null then w
              else list_transform(list_filter(idx, lambda i: not list_contains(qs, i)), lambda i: w[i]) end, ' ')) as kept_sha256
from each left join cut using (doc_id)
"""
