"""Ranked lexical search by the Best Position Algorithm over impact lists.

A document's score for an item is the sum, over the item's distinct terms, of the term's impact in the
document: ``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with ``w`` from the term's document
frequency and ``m`` from the document's length (BM25 in whole numbers, so sums have no order).
The steps:

1. *Items.*  The items' terms, as 64-bit hashes, make the vocabulary.  Items are taken in blocks of about
   ``BLOCK_TERMS`` terms, since a block's terms are broadcast; each block reads the documents once.
2. *Forward index.*  One pass over all documents counts their terms, and the occurrences of the
   vocabulary's; it is written to the shared folder.  Totals and document frequencies are sums over it.
3. *Shards.*  Each task takes its documents as shards of about ``SHARD_ENTRIES`` entries.  A shard
   has, for every term, the list of its documents by falling impact, and for every document its
   entries with their places in these lists.
4. *Best positions.*  For an item, the lists of its terms are read in parallel from the top.  Each new
   document is looked up directly in all of them: this gives its score, and marks its place in each
   list as seen.  A list's best position is the end of its stretch of seen places; documents not yet
   seen lie behind it in every list, so none scores more than the sum of the next impacts
   there.  (The places read so far would give a higher sum: direct accesses fill the stretch ahead
   of the reading.)  The search stops when that sum is strictly below the k-th best score, so that a
   tie with a smaller ``doc_id`` is not missed, or when no list has an unseen place.
5. *Merge.*  A task keeps the k best of its shards for each item, which also bound its later shards;
   Spark ranks those of all tasks.

No posting is shuffled, and no item meets all documents: only the forward index is written, and ``k`` rows
for each item and task are ranked.  A term that very many documents have is a long list in every shard.

Defined results: a null, empty or separator-only text has no terms; it is ranked nowhere and not counted
in N.  A null or empty item has no rows; rows that share an ``item_id`` are one item with the terms of
all; repeated documents are counted and ranked each; a row without ``doc_id`` counts in the
statistics but is not ranked.  Equal scores rank by ``doc_id``.  Texts are read whole.  Empty tables
give an empty result.  Extra columns are ignored.  Different terms meet in one hash with a probability
of 2**-63 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared_keys, tables, wordhash
from quire.session import drop_scratch, scratch_dir

K = 50
BLOCK_TERMS = 500_000         # item terms that are broadcast at once (about 16 bytes each)
SHARD_ENTRIES = 1 << 21
STEP = 32                     # places of each list that are read before the threshold is looked at again
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_SEPARATORS = ~_ALNUM
_FORWARD = "doc_id bigint, n bigint, terms binary, tfs binary"
_FORWARD_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])
_FREQUENCY = "term int, df bigint"
_RANKED = "item_id bigint, doc_id bigint, score bigint"
_RANKED_ARROW = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _terms(text: pa.Array) -> wordhash.Words:
    return wordhash.words(text, lower=True, strip=_SEPARATORS)


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """int32 values as one binary cell for each row."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(values.astype("<i4"))])


def _unpacked(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values of each row)."""
    cells = cells.cast(pa.large_binary())
    if not len(cells):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset:cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data.view("<i4").astype(np.int64), np.diff(offsets) // 4


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shared_keys.slices(batches):
        w = _terms(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(w.row)), pa.array(wordhash.signed(w.hash))], names=["item_id", "term"])


def _forward(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents -> length in terms, and the vocabulary's terms in them with their occurrences."""
    size = len(vocabulary)
    for batch in shared_keys.slices(batches):
        w = _terms(batch.column("text"))
        term = wordhash.signed(w.hash)
        at = np.searchsorted(vocabulary, term)
        at[at == size] = 0
        known = np.flatnonzero(vocabulary[at] == term)
        entry, tf = np.unique(w.row[known] * size + at[known], return_counts=True)
        first = np.searchsorted(entry, np.arange(batch.num_rows + 1) * size)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(w.first)), _packed(entry % size, first), _packed(tf, first)],
                                         schema=_FORWARD_ARROW)


def _frequencies(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, dtype=np.int64)
    for batch in batches:
        df += np.bincount(_unpacked(batch.column("terms"))[0], minlength=size)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["term", "df"])


class Shard:
    """Impact lists of some documents, with direct access.

    ``doc``, ``term`` and ``impact`` are the entries, sorted by document (0 to ``documents`` - 1)."""

    def __init__(self, documents: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, vocabulary: int):
        order = np.lexsort((-impact, term))
        self.first = np.searchsorted(term[order], np.arange(vocabulary + 1))        # of each term's list
        self.listed, self.falling = doc[order], impact[order]
        self.place = np.empty(len(order), dtype=np.int64)                           # of each entry, in its term's list
        self.place[order] = np.arange(len(order)) - self.first[term[order]]
        self.term, self.impact = term, impact
        self.of = np.searchsorted(doc, np.arange(documents + 1))                    # each document's entries
        self.slot = np.full(vocabulary, -1, dtype=np.int64)
        self.read = 0                                                               # places read in order, for tests

    def best(self, terms: np.ndarray, ids: np.ndarray, k: int, bound: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the ``k`` best by (score, smaller id), of those that score over 0 and at least ``bound``."""
        size = self.first[terms + 1] - self.first[terms]
        terms, size = terms[size > 0], size[size > 0]
        begin = self.first[terms]
        offset = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(int(offset[-1]), dtype=bool)
        position = np.zeros(len(terms), dtype=np.int64)                             # best position: places before it are seen
        met = np.zeros(len(ids), dtype=bool)
        self.slot[terms] = np.arange(len(terms))
        top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step, least = 0, STEP, max(bound, 1)
        while True:
            open_ = np.flatnonzero(position < size)
            if not len(open_) or int(self.falling[begin[open_] + position[open_]].sum()) < least:
                break
            reading = np.flatnonzero(size > depth)
            counts = np.minimum(size[reading] - depth, step)
            entry = np.repeat(begin[reading] + depth - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            self.read += len(entry)
            new = self.listed[entry]
            new = np.unique(new[~met[new]])
            met[new] = True
            # direct access: all entries of the new documents, of which the item's terms count
            counts = self.of[new + 1] - self.of[new]
            entry = np.repeat(self.of[new] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            list_ = self.slot[self.term[entry]]
            mine = list_ >= 0
            entry, list_, owner = entry[mine], list_[mine], np.repeat(np.arange(len(new)), counts)[mine]
            seen[offset[list_] + self.place[entry]] = True
            score = np.zeros(len(new), dtype=np.int64)
            np.add.at(score, owner, self.impact[entry])
            good = score >= least
            top, scores = np.concatenate([top, new[good]]), np.concatenate([scores, score[good]])
            if len(top) > k:
                order = np.lexsort((ids[top], -scores))[:k]
                top, scores = top[order], scores[order]
            if len(top) == k:
                least = max(least, int(scores.min()))
            for j in open_:
                ahead = seen[offset[j] + position[j]:offset[j + 1]]
                position[j] = size[j] if ahead.all() else position[j] + int(ahead.argmin())
            depth += step
            step += step // 2
        self.slot[terms] = -1
        return top, scores


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int,
            k: int, shard_entries: int) -> Iterator[pa.RecordBatch]:
    """The forward index's rows -> the ``k`` best of this task's documents for each item."""
    ids_of = [np.zeros(0, np.int64) for _ in items]
    scores_of = [np.zeros(0, np.int64) for _ in items]
    parts: list[tuple[np.ndarray, ...]] = []
    held = 0

    def search() -> None:
        ids, n, counts, term, tf = (np.concatenate(c) for c in zip(*parts))
        doc = np.repeat(np.arange(len(ids)), counts)
        m = 50 + 50 * n * n_docs // n_terms
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        shard = Shard(len(ids), doc[some], term[some], impact[some], len(weights))
        for i, (_, terms) in enumerate(items):
            bound = int(scores_of[i][-1]) if len(scores_of[i]) == k else 0
            top, scores = shard.best(terms, ids, k, bound)
            if len(top):
                all_ids, all_scores = np.concatenate([ids_of[i], ids[top]]), np.concatenate([scores_of[i], scores])
                order = np.lexsort((all_ids, -all_scores))[:k]
                ids_of[i], scores_of[i] = all_ids[order], all_scores[order]
        parts.clear()

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        term, counts = _unpacked(batch.column("terms"))
        tf, _ = _unpacked(batch.column("tfs"))
        parts.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), counts, term, tf))
        held += len(term)
        if held >= shard_entries:
            search()
            held = 0
    if parts:
        search()
    for i, (item, _) in enumerate(items):
        if len(ids_of[i]):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids_of[i]), pa.int64()), pa.array(ids_of[i]), pa.array(scores_of[i])], schema=_RANKED_ARROW)


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _ranked_block(docs: DataFrame, pairs: DataFrame, k: int, shard_entries: int) -> DataFrame:
    """Best documents for the items of one block: ``pairs`` (item_id, term), all of which are broadcast."""
    spark = docs.sparkSession
    found = pairs.toPandas()
    vocabulary, number = np.unique(found["term"].to_numpy(np.int64), return_inverse=True)
    if not len(vocabulary):
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    by_item = found.assign(term=number).groupby("item_id", dropna=False)["term"]
    items = [(None if item != item or item is None else int(item), np.sort(terms.to_numpy())) for item, terms in by_item]
    shared = spark.sparkContext.broadcast((vocabulary, items))
    folder = scratch_dir(spark, "forward-index")
    docs.mapInArrow(lambda it: _forward(it, shared.value[0]), _FORWARD).write.parquet(folder)
    forward = spark.read.schema(_FORWARD).parquet(folder)
    size = len(vocabulary)
    total = forward.where("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = forward.select("terms").mapInArrow(lambda it: _frequencies(it, size), _FREQUENCY).groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(size, dtype=np.int64)
    for r in counted.collect():                                  # at most one row for each term of the block
        weights[r["term"]] = _weight(total["docs"], r["df"])
    weighted = spark.sparkContext.broadcast(weights)
    n_docs, n_terms = int(total["docs"]), max(1, int(total["terms"]))
    best = forward.mapInArrow(lambda it: _search(it, shared.value[1], weighted.value, n_docs, n_terms, k, shard_entries), _RANKED)
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    ranked = tables.at_rest(ranked.select("item_id", "rank", "doc_id", "score"))
    drop_scratch(spark, folder)
    return ranked


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best rows of ``docs`` (doc_id bigint, text) for each item of
    ``items`` (item_id bigint, text): fewer where fewer score over 0."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    pairs = tables.at_rest(items.mapInArrow(_item_terms, "item_id bigint, term bigint").distinct())
    blocks = -(-pairs.count() // block_terms) or 1
    out = None
    for b in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        part = _ranked_block(docs, own, k, shard_entries)
        out = part if out is None else out.unionByName(part)
    return out


def op13_best_position(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked(docs, items)


OP13_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
totals as (select count(*) filter (len(terms) > 0) as nn, sum(len(terms))::bigint as ll from docs),
item_terms as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
entries as (
  select doc_id, term, count(*) as tf, any_value(n) as n from (select doc_id, len(terms) as n, unnest(terms) as term from docs)
  where term in (select term from item_terms) group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::bigint as w from entries, totals group by term),
impacts as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))) as impact from entries join weights using (term), totals),
scores as (select item_id, doc_id, sum(impact)::bigint as score from item_terms join impacts using (term) group by item_id, doc_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
