"""Substring dedup over suffix arrays, built blockwise with difference covers.

A text is its UTF-8 bytes.  Every byte goes that lies in a ``LENGTH``-byte string which also
starts earlier: in a document with a smaller ``doc_id``, or further left in the same document.
The steps, one lazy Spark plan:

1. *Candidates.*  A string's anchor is the least hash of the ``ANCHOR``-byte pieces in it, so equal
   strings have equal anchors and neighbours mostly share theirs (about 3 anchors per 100 bytes).
   ``shared_keys`` finds the anchors of two or more documents; anchors that come again within one
   document are found where its text is read.  Maximal stretches of such strings are passages.
2. *Shards.*  Passages are dealt by the first document of their anchors, so equal strings meet: the
   first document sends its passage, later documents theirs.  Anchors of very many documents
   are salted (``SALT_ROWS`` documents each); Spark copies the first passage to every salt.
3. *Suffix arrays.*  A task takes shards as blocks of ``BLOCK`` bytes of distinct passages (equal
   passages are settled at once).  Over a block it ranks the cover sample (the positions whose
   remainder by ``PERIOD`` lies in ``COVER``, a fifth of them) by prefix doubling, then sorts one
   bucket of suffixes at a time: by their first bytes, and those that tie there by the ranks of the
   sample positions which both reach after an equal step (a difference cover has one for any
   two suffixes).  Neighbours of the sorted bucket with ``LENGTH`` equal bytes are the repeats.
   Only a bucket's suffixes and the sample's ranks are held beside the text.
4. *The rest.*  In a salted or divided shard a string that the first document lacks may also
   start in another block; those strings alone meet by a 128-bit digest, one row per string and block.
5. *Cut.*  Repeats, as runs of starting places, meet their texts; a difference array marks the bytes.

Texts are scanned whole; no cap on copies or partners; nothing is collected to the driver.  A task
holds at most one document's passages and ``BLOCK`` bytes of others.

Defined results: a null or empty text, and one of fewer than ``LENGTH`` bytes, loses nothing; rows
that share a ``doc_id`` lose what smaller ids have and what stands further left in themselves, but
nothing for each other's sake (equal rows get equal results); a row without ``doc_id``
neither loses bytes nor makes others lose them; ``kept`` is binary, since a cut may part a
character; an empty table gives an empty table; extra columns pass through, except that those named
like the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash

LENGTH = 100
ANCHOR = 40
SALT_ROWS = 4096
BLOCK = 12 << 20
BUCKET = 1 << 19
# A difference cover of the remainders by 31 (every remainder is a difference of two of these).
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)

_PIECE = 1 << 20
_WORD = 8                     # bytes compared at once
_PASSAGE = "first bigint, low int, high int, role int, doc bigint, row bigint, start bigint, passage binary"
_PASSAGE_ARROW = pa.schema([("first", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("role", pa.int32()),
                            ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("passage", pa.binary())])
_FOUND = "key bigint, key2 bigint, doc bigint, row bigint, start bigint, count bigint"
_ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


# Candidates.

def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours."""
    span, out = 1, values
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = pick(out[:len(out) - (width - span)], out[width - span:])
    return out


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: (first start, start behind the last, anchor), and the (place, anchor)
    of every chosen piece.  Strings lie within a row of ``offsets``."""
    width = length - gram + 1
    opens = offsets[:-1]
    closes = np.maximum(offsets[1:] - length + 1, opens)
    runs, chosen = [], []
    for a in range(0, len(buf), _PIECE):
        part = buf[a:a + _PIECE + length - 1]
        if len(part) < length:
            break
        up, down = wordhash._power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(wordhash._VALUES[part] * up[:len(part)], out=total[1:])
        piece = wordhash.mix((total[gram:] - total[:-gram]) * down[:len(part) - gram + 1])
        least = _sliding(piece, width, np.minimum)
        edge = np.zeros(len(least) + 1, dtype=np.int32)         # valid starts lie between opens and closes
        np.add.at(edge, np.clip(opens - a, 0, len(least)), 1)
        np.add.at(edge, np.clip(closes - a, 0, len(least)), -1)
        valid = np.cumsum(edge[:-1]) > 0
        if not valid.any():
            continue
        turn = np.ones(len(least) + 1, dtype=bool)
        turn[1:-1] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(turn)
        ok = valid[at[:-1]]
        runs.append((at[:-1][ok] + a, at[1:][ok] + a, least[at[:-1][ok]]))
        least[~valid] = 0
        reach = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
        reach[width - 1:width - 1 + len(least)] = least
        place = np.flatnonzero(_sliding(reach, width, np.maximum) == piece)
        chosen.append((place + a, piece[place]))
    if not runs:
        none, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, hashes, none, hashes
    return (*(np.concatenate(c) for c in zip(*runs)), *(np.concatenate(c) for c in zip(*chosen)))


def _emit(batch: pa.RecordBatch, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = wordhash.utf8(batch.column("text"))
    start, _, anchor, _, _ = _anchors(buf, offsets, length, gram)
    row = np.searchsorted(offsets, start, "right") - 1
    return anchor.view(np.int64), batch.column("doc_id").to_numpy()[row]


def _own_repeats(offsets: np.ndarray, row: np.ndarray, anchor: np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Which runs have an anchor that is chosen at two places or more of their row."""
    def tagged(values, rows):
        return wordhash.mix(values + wordhash.mix(rows.astype(np.uint64)))

    place, first = np.unique(place, return_index=True)
    tags = np.sort(tagged(piece[first], np.searchsorted(offsets, place, "right") - 1))
    return np.isin(tagged(anchor, row), tags[1:][tags[1:] == tags[:-1]])


def _passages(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Documents with the list of their shared anchors -> the passages that may repeat."""
    for batch in shared_keys.slices(batches):
        batch = batch.filter(batch.column("doc_id").is_valid())
        buf, offsets = wordhash.utf8(batch.column("text"))
        start, stop, anchor, place, piece = _anchors(buf, offsets, length, gram)
        if not len(start):
            continue
        docs, digests = batch.column("doc_id").to_numpy(), batch.column("_row").to_numpy()
        row = np.searchsorted(offsets, start, "right") - 1
        own = _own_repeats(offsets, row, anchor, place, piece)
        anchor = anchor.view(np.int64)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        listed = batch.column("_anchors")
        home, low, high, role = (np.full(len(start), k, dtype=np.int64) for k in (0, 0, 0, -1))
        home[own], role[own] = docs[row[own]], 0                # unless another document has the anchor
        for r in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)):
            lo, hi = edges[r], edges[r + 1]
            if lo == hi:
                continue
            key, first, salt = (listed[int(r)].values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.argsort(key, kind="stable")
            key, first, salt = key[order], first[order], salt[order]
            hit = np.searchsorted(key, anchor[lo:hi])
            hit[hit == len(key)] = 0
            at = np.flatnonzero(key[hit] == anchor[lo:hi])
            hit = hit[at]
            at += lo
            leads = first[hit] == docs[r]
            home[at], role[at] = first[hit], np.where(leads, 0, 1)
            low[at], high[at] = np.where(leads, 0, salt[hit]), np.where(leads, salt[hit] - 1, salt[hit])
        turn = np.ones(len(start), dtype=bool)
        turn[1:] = (start[1:] != stop[:-1]) | (row[1:] != row[:-1])
        for c in (home, low, high, role):
            turn[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(turn)
        last = np.append(at[1:], len(start)) - 1
        keep = role[at] >= 0
        at, last = at[keep], last[keep]
        if len(at):
            texts = [buf[a:b].tobytes() for a, b in zip(start[at], stop[last] + length - 1)]
            columns = [home[at], low[at], high[at], role[at], docs[row[at]], digests[row[at]], start[at] - offsets[row[at]], texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PASSAGE_ARROW)], schema=_PASSAGE_ARROW)


# Suffix arrays.

def _step_table() -> np.ndarray:
    """For two remainders by ``PERIOD``: the least step that takes both into the cover."""
    inside = np.zeros(PERIOD, dtype=bool)
    inside[list(COVER)] = True
    table = np.full((PERIOD, PERIOD), PERIOD, dtype=np.int64)
    for step in reversed(range(PERIOD)):
        there = np.roll(inside, -step)
        table[np.ix_(there, there)] = step
    return table


_STEP = _step_table()
_SLOT = np.zeros(PERIOD, dtype=np.int64)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _sample_index(position: np.ndarray) -> np.ndarray:
    return position // PERIOD * len(COVER) + _SLOT[position % PERIOD]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts like them."""
    out = np.empty(len(text) - _WORD + 1, dtype=np.uint64)
    for k in range(_WORD):
        part = text[k:k + (len(text) - k) // _WORD * _WORD].view(">u8")
        out[k::_WORD] = part[:len(out[k::_WORD])]
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys from 0 on, equal ones for equal keys."""
    order = np.argsort(keys)
    fresh = np.zeros(len(keys), dtype=np.int64)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _sample_ranks(words: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Ranks of the cover sample of ``size`` places by their first ``depth`` bytes or more."""
    rows = -(-size // PERIOD)
    places = (np.arange(rows)[:, None] * PERIOD + np.array(COVER)).ravel()
    rank, known = _dense(words[places]), _WORD
    while known < PERIOD:                                       # the first bytes, word by word
        rank, known = _dense(rank << 32 | _dense(words[places + known])), known + _WORD
    step = PERIOD
    while known < depth:                                        # then doubling: a sample place and the one `step` on
        ahead = np.zeros_like(rank)
        jump = step // PERIOD * len(COVER)
        ahead[:-jump] = rank[jump:] + 1 if jump < len(rank) else 0
        rank, known, step = _dense(rank << 32 | ahead), known + step, step * 2
    return rank


def _repeats(text: np.ndarray, starts: np.ndarray, length: int, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of two or more of the ascending ``starts`` with ``length`` equal bytes: (places, group of each),
    sorted by group and place.  ``text`` has 2 * ``PERIOD`` and 7 words of zeros behind its last string."""
    words = _words(text)
    ranks = _sample_ranks(words, len(text) - PERIOD - 7 * _WORD, length)
    head = words[starts]
    pieces = -(-len(starts) // bucket)
    cuts = np.unique(np.sort(head[::max(1, len(head) // (64 * pieces))])[::64]) if pieces > 1 else head[:0]
    home = np.searchsorted(cuts, head, "right").astype(np.int32) if pieces > 1 else np.zeros(len(starts), np.int8)
    del head
    for b in range(len(cuts) + 1):
        at = starts[home == b]
        tie = np.zeros(len(at), dtype=np.int64)                 # number of the run of equal suffixes so far
        for k in range(0, PERIOD, _WORD):
            if not len(at):
                break
            key = words[at + k]
            key = tie << 32 | _dense(key) if k else key
            order = np.argsort(key)
            at, key = at[order], key[order]
            fresh = np.ones(len(at) + 1, dtype=bool)
            fresh[1:-1] = key[1:] != key[:-1]
            many = ~(fresh[:-1] & fresh[1:])                    # a suffix like no other is sorted already
            at, tie = at[many], np.cumsum(fresh[:-1])[many]
        if not len(at):
            continue
        at, tie = _by_cover(at, tie, ranks)
        same = tie[1:] == tie[:-1]                              # neighbours with `length` equal bytes
        for k in [*range(_WORD * -(-PERIOD // _WORD), length - _WORD, _WORD), length - _WORD]:
            i = np.flatnonzero(same)
            same[i] = words[at[i] + k] == words[at[i + 1] + k]
        group = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(group)[group] > 1
        at, group = at[many], group[many]
        if len(at):
            order = np.lexsort((at, group))
            yield at[order], group[order]


def _by_cover(at: np.ndarray, tie: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort every run of suffixes that tie on ``PERIOD`` bytes by the cover ranks: all runs are split at once, each
    around a pivot of its own, into smaller, equal and larger suffixes, until none has two unequal ones."""
    live = np.arange(len(at))
    run = np.cumsum(np.concatenate([[0], tie[1:] != tie[:-1]]))
    while len(live):
        p = at[live]
        begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        size = np.diff(np.append(begin, len(run)))
        pivot = np.repeat(p[begin + size // 2], size)
        step = _STEP[p % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[_sample_index(p + step)] - ranks[_sample_index(pivot + step)])
        key = np.repeat(np.arange(len(size)), size) * 3 + side + 1
        order = np.argsort(key, kind="stable")
        at[live], key = p[order], key[order]
        go = (key % 3 != 1) & (np.bincount(key)[key] > 1)
        live, run = live[go], key[go]
    return at, tie


# Shards.

class _Block:
    """Passages of some shards: sorted, without equal ones, as one text."""

    def __init__(self, rows: list[tuple], length: int):
        # a row: (doc, row, start, role, open, passage)
        rows.sort(key=lambda r: r[:4])
        seen: dict[bytes, tuple] = {}
        self.whole: list[tuple] = []                            # runs (doc, row, start, count) of equal passages
        kept, last = [], None
        for r in rows:
            if r[:3] == last:
                continue                                        # the first document's passage, in another salt; an equal row
            last = r[:3]
            lead = seen.setdefault(r[5], r)
            if lead is r or lead[0] == r[0] and lead[1] != r[1]:
                kept.append(r)
            else:
                self.whole.append((*r[:3], len(r[5]) - length + 1))
        self.text = np.frombuffer(b"".join([r[5] for r in kept] + [bytes(2 * PERIOD + 7 * _WORD)]), np.uint8)
        self.sizes = np.array([len(r[5]) for r in kept], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc, self.row, self.start, self.role, self.open = (np.array([r[k] for r in kept], dtype=np.int64) for k in range(5))
        edge = np.zeros(int(self.begin[-1]) + 1, dtype=np.int8)
        np.add.at(edge, self.begin[:-1], 1)
        np.add.at(edge, self.begin[1:] - length + 1, -1)
        self.valid = np.cumsum(edge[:-1], dtype=np.int8) > 0

    def passage_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def found(self, length: int, bucket: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``_FOUND``: runs that repeat (key2 null), and strings that other blocks may have."""
        gone = np.zeros(len(self.valid), dtype=bool)
        starts = np.flatnonzero(self.valid)
        for at, group in _repeats(self.text, starts, length, bucket):
            p = self.passage_of(at)                             # places ascend by document, row and start
            doc, row = self.doc[p], self.row[p]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = group[1:] != group[:-1]
            least = doc[fresh][np.cumsum(fresh) - 1]
            again = np.zeros(len(at), dtype=bool)
            again[1:] = ~fresh[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1])
            gone[at[(doc != least) | again]] = True
        at = np.flatnonzero(gone)
        p = self.passage_of(at)
        turn = np.ones(len(at) + 1, dtype=bool)
        turn[1:-1] = (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1])
        begin = np.flatnonzero(turn)
        head, p = at[begin[:-1]], p[begin[:-1]]
        runs = [self.doc[p], self.row[p], self.start[p] + head - self.begin[p], np.diff(begin)]
        if self.whole:
            runs = [np.concatenate([a, np.array(b, dtype=np.int64)]) for a, b in zip(runs, zip(*self.whole))]
        if len(runs[0]):
            key = wordhash.mix((runs[0] ^ runs[1]).view(np.uint64) + runs[2].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.int64()), *map(pa.array, runs)],
                                             names=["key", "key2", "doc", "row", "start", "count"])
        unsure = np.repeat((self.open == 1) & (self.role == 1), self.sizes) & self.valid & ~gone
        at = np.flatnonzero(unsure)
        text = self.text.data
        for a in range(0, len(at), 1 << 16):
            part = at[a:a + (1 << 16)]
            p = self.passage_of(part)
            digests = np.frombuffer(b"".join(hashlib.blake2b(text[i:i + length], digest_size=16).digest() for i in part.tolist()), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (
                digests[:, 0], digests[:, 1], self.doc[p], self.row[p], self.start[p] + part - self.begin[p], np.ones(len(part), np.int64))],
                names=["key", "key2", "doc", "row", "start", "count"])


def _settled(batches: Iterator[pa.RecordBatch], length: int, block: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Passages sorted by (first, salt, role) -> rows of ``_FOUND``, block by block."""
    done: list[tuple] = []                    # rows of whole shards
    shard: list[tuple] = []                   # rows of the shard that is read, its first document's ahead
    key, held, size, divided, leads = None, 0, 0, False, 0

    def close() -> None:
        nonlocal held, size
        shared = divided or key[1] > 0 or any(r[4] for r in shard[:leads])
        done.extend((*r[:4], int(shared), r[5]) for r in shard)
        held, size = held + size, 0
        shard.clear()

    for batch in batches:
        for first, salt, high, role, doc, row, start, passage in zip(*(batch.column(c).to_pylist() for c in (
                "first", "salt", "high", "role", "doc", "row", "start", "passage"))):
            if key != (first, salt):
                if key is not None:
                    close()
                    if held >= block // 2:    # so that a shard of less than that is never divided
                        yield from _Block(done, length).found(length, bucket)
                        done, held = [], 0
                key, divided, leads = (first, salt), False, 0
            elif role == 1 and size + held >= block and len(shard) > leads:
                ahead = shard[:leads]
                divided = True
                close()
                yield from _Block(done, length).found(length, bucket)
                done, held = [], 0
                shard.extend(ahead)           # the first document's passages go on to the next block
                size = sum(len(r[5]) for r in ahead)
            shard.append((doc, row, start, role, int(role == 0 and high > 0), passage))
            size += len(passage)
            leads += role == 0
    if key is not None:
        close()
        yield from _Block(done, length).found(length, bucket)


# Cut.

def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents with the runs of their repeats -> kept bytes and counts."""
    for batch in shared_keys.slices(batches):
        buf, offsets = wordhash.utf8(batch.column("text"))
        edge = np.zeros(len(buf) + 1, dtype=np.int32)
        listed, digests = batch.column("_runs"), batch.column("_row")
        for r in np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False)):
            row, start, count = (listed[int(r)].values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            mine = row == digests[int(r)].as_py()
            np.add.at(edge, offsets[r] + start[mine], 1)
            np.add.at(edge, offsets[r] + start[mine] + count[mine] + length - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edges = offsets[:-1][offsets[:-1] < len(buf)]
        opens[edges] = gone[edges]
        spans = np.concatenate([[0], np.cumsum(opens)])
        kept, new = buf[~gone], offsets - lost[offsets]
        blob = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(new.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
        names = [c for c in batch.schema.names if c not in ("_row", "_runs", "_id")]
        added = [np.diff(offsets), np.diff(lost[offsets]), np.diff(spans[offsets])]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(c.astype(np.int64)) for c in added] + [blob],
                                         names=[*names, *_ADDED])


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, salt_rows: int = SALT_ROWS,
                          block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` (doc_id bigint, text string, any others) with n_bytes, n_removed (bytes), n_spans (maximal
    removed runs) and kept (binary, the other bytes).  ``length`` is at least 48 and over ``anchor``."""
    if length < 48 or anchor >= length:
        raise ValueError(f"strings of {length} bytes with anchors of {anchor} are not supported")
    docs = docs.drop(*_ADDED, "_row", "_runs", "_id", "_anchors")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    plain = docs.select("doc_id", "text")
    rows = shared_keys.combined(plain.where(f"doc_id is not null and octet_length(text) >= {length}"), lambda batch: _emit(batch, length, anchor))
    shared = shared_keys.recurring(rows, salt_rows)
    lists = shared.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("key", "first", "salt")).alias("_anchors"))
    named = docs.withColumn("_row", F.xxhash64("text"))
    passages = (named.select("doc_id", "text", "_row").join(lists, F.col("doc_id") == F.col("_id"), "left")
                .mapInArrow(lambda it: _passages(it, length, anchor), _PASSAGE)
                .withColumn("salt", F.explode(F.sequence("low", "high"))))
    found = (passages.repartition("first", "salt").sortWithinPartitions("first", "salt", "role", "doc")
             .mapInArrow(lambda it: _settled(it, length, block, bucket), _FOUND))
    by = Window.partitionBy("key", "key2").orderBy("doc", "row", "start")
    last = F.lag(F.struct("doc", "row")).over(by)
    repeats = (found.withColumn("_least", F.first("doc").over(by)).withColumn("_last", last)
               .where((F.col("key2").isNull()) | (F.col("doc") != F.col("_least")) | (F.col("_last") == F.struct("doc", "row")))
               .groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("row", "start", "count")).alias("_runs")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return (named.join(repeats, F.col("doc_id") == F.col("_id"), "left")
            .mapInArrow(lambda it: _cut(it, length), schema + ", n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document: its bytes, those removed, in how many runs, and the digest of the kept ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
with hexed as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n_bytes from documents),
strings_of as (
  select doc_id, p, md5_number(substr(h, 2 * p - 1, 200)) as s
  from (select doc_id, h, unnest(range(1, n_bytes - 98)) as p from hexed where n_bytes >= 100)),
later as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from strings_of) where k > 1),
edges as (select doc_id, p, p - lag(p) over (partition by doc_id order by p) as gap from later),
numbered as (select doc_id, p, sum(case when gap is null or gap > 100 then 1 else 0 end) over (partition by doc_id order by p) as span from edges),
spans as (select doc_id, span, min(p) as a, max(p) + 100 as b from numbered group by doc_id, span),
stretches as (
  select doc_id, span, lag(b, 1, 1) over (partition by doc_id order by span) as x, a as y from spans
  union all select doc_id, max(span) + 1, max(b), null from spans group by doc_id),
kept as (
  select doc_id, string_agg(substr(h, 2 * x - 1, 2 * (coalesce(y, n_bytes + 1) - x)), '' order by span) as k
  from stretches join hexed using (doc_id) group by doc_id),
counts as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from hexed left join counts using (doc_id) left join kept using (doc_id)
"""
