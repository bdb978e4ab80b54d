"""MinHash near-dedup with tensored banding.

A document's set: the distinct ``SHINGLE``-word shingles of its words
(``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); with fewer words, the whole sequence as
one; empty without words.  Documents are linked when the Jaccard similarity of
their sets is ``PERCENT`` % or more; a component keeps its smallest ``doc_id``.

*Tensored banding.*  A document gets ``HALVES`` half keys of ``ROWS`` minhashes
each, and every pair of half keys forms the key of one table: 17 half keys, that
is 51 minhashes, make 136 tables of six minhashes, for which separate bands would
need 816.  A pair of similarity J shares a table unless fewer than two half keys
agree, so at J = 0.8 it is missed with probability 1e-4, at 0.85 with 7e-7, and a
component is only lost if all of its links are.

*Steps.*  Documents with equal sets are one class (128-bit set hash); only its
smallest document goes on.  Keys are combined in the map tasks, shuffled and read
in runs (``shared_keys``): each document is paired with the smallest one of each
of its tables, so a table with n documents gives n - 1 pairs.  Pairs are confirmed on
full sets.  Where a pair of two components fails, its tables may still hold links
between other members: their members in different components meet by an exact
prefix filter (``across``), and what passes it is confirmed too.  No links, components
or sets are collected to the driver.

Defined results: null and empty texts have an empty set, link with nothing and are
kept; rows that share a ``doc_id`` count as one document; a row without ``doc_id``
links with nothing, has a null component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared_keys, wordhash
from quire.llm.components import components
from quire.llm.tables import at_rest

SHINGLE = 2
PERCENT = 80
ROWS = 3
HALVES = 17
#: Sets of so many documents at most (8 bytes an id) are fetched by broadcasting their ids.
BROADCAST_IDS = 1_000_000
#: Partners of one document that a task confirms.
SALT_ROWS = 1000

_SIGNED = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, halves binary"
_SETS = "doc_id bigint, set binary"
_CONSTANTS = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, (2, 4096), dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, offsets of the rows in them)."""
    w = wordhash.words(texts, lower=True)
    at, h = wordhash.windows(w, size)
    rows = w.row[at]
    n_words = np.diff(w.first)
    for k in range(1, size):                    # shorter texts: their whole sequence, per length
        short = np.flatnonzero(n_words == k)
        if len(short):
            pos, hk = wordhash.windows(w, k, salt=k)
            hk = hk[np.searchsorted(pos, w.first[short])]
            rows, h = np.concatenate([rows, short]), np.concatenate([h, hk])
    if len(rows) and (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, h = rows[order], h[order]
    edges = np.searchsorted(rows, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[keep], np.append(0, np.cumsum(keep))[edges]


def half_keys(sets: np.ndarray, edges: np.ndarray, rows: int, halves: int) -> np.ndarray:
    """(documents with a set, halves) half keys; ``edges`` without empty sets."""
    out = np.empty((len(edges) - 1, halves), dtype=np.uint64)
    for i in range(halves):
        key = np.full(len(edges) - 1, np.uint64(i + 1))
        for j in range(rows):
            k = i * rows + j
            least = np.minimum.reduceat((sets ^ _CONSTANTS[0, k]) * (_CONSTANTS[1, k] | np.uint64(1)), edges[:-1])
            key = wordhash.mix(key + least)
        out[:, i] = key
    return out


def _sign(batches, size: int, rows: int, halves: int):
    for batch in shared_keys.slices(batches):
        sets, edges = shingle_sets(batch.column("text"), size)
        n = np.diff(edges)
        some = np.flatnonzero(n)
        begin = edges[:-1][some]
        h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        blobs: list[bytes | None] = [None] * len(n)
        if len(some):
            mixed = wordhash.mix(sets ^ np.uint64(0x5851F42D4C957F2D))
            h1[some], h2[some] = np.add.reduceat(sets, begin), np.add.reduceat(mixed, begin)
            keys = half_keys(sets, np.append(begin, len(sets)), rows, halves)
            for r, key in zip(some, keys):
                blobs[r] = key.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(wordhash.signed(h1)),
                                          pa.array(wordhash.signed(h2)), pa.array(blobs, pa.binary())],
                                         names=["doc_id", "n_shingles", "h1", "h2", "halves"])


def table_keys(blob_column: pa.Array, halves: int) -> np.ndarray:
    """(documents, tables) keys: one for each pair of half keys."""
    u = np.frombuffer(b"".join(blob_column.to_pylist()), dtype=np.uint64).reshape(-1, halves)
    i, j = np.triu_indices(halves, 1)
    return wordhash.mix(u[:, i] * np.uint64(0x9E3779B97F4A7C15) + u[:, j])


def _emit(batch: pa.RecordBatch, halves: int) -> tuple[np.ndarray, np.ndarray]:
    keys = table_keys(batch.column("halves"), halves)
    return keys.ravel().view(np.int64), np.repeat(batch.column("doc_id").to_numpy(), keys.shape[1])


def _sets(batches, size: int):
    for batch in shared_keys.slices(batches):
        sets, edges = shingle_sets(batch.column("text"), size)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([sets[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())],
            names=["doc_id", "set"])


def _shingle_rows(batches, size: int):
    for batch in shared_keys.slices(batches):
        sets, edges = shingle_sets(batch.column("text"), size)
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(sets.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("component"), batch.column("n_shingles"), lists],
                                         names=["doc_id", "component", "n", "shingles"])


def _confirm(batches, percent: int):
    """Rows (a, salt, role, b, set) sorted so that a's set comes before its partners'."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, role, b = (batch.column(c).to_numpy() for c in ("a", "role", "b"))
        out = []
        for r, blob in enumerate(batch.column("set")):
            other = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
            if role[r] == 0:
                centre, own = a[r], other
            elif centre == a[r] and len(own):
                at = np.searchsorted(own, other)
                at[at == len(own)] = 0
                both = int((own[at] == other).sum())
                out.append((a[r], b[r], 100 * both >= percent * (len(own) + len(other) - both)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))],
                                             names=["a", "b", "linked"])


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int,
            salt_rows: int = SALT_ROWS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``pairs`` (a, b), a table at rest, with ``linked``: confirmed on full sets."""
    ids = at_rest(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, shingle), _SETS)
    salts = at_rest(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
                    .select(F.col("a").alias("c"), F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")))
    salted = (pairs.join(salts, pairs["a"] == salts["c"])
              .select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "b"))
    centres = salts.select(F.col("c").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                           F.lit(0).alias("role"), F.col("c").alias("b"))
    rows = (centres.unionAll(salted).join(sets.withColumnRenamed("doc_id", "id"), F.col("b") == F.col("id"))
            .select("a", "salt", "role", "b", "set"))
    return (rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
            .mapInArrow(lambda it: _confirm(it, percent), "a bigint, b bigint, linked boolean").distinct())


def across(members: DataFrame, docs: DataFrame, shingle: int, percent: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Pairs (a < b) of ``members`` (doc_id, n_shingles, component; a table at
    rest) in different components that may be linked; no linked pair is left out.

    Prefix filter: with all shingles in one order, linked documents share one of
    their first n - ceil(percent * n / 100) + 1 shingles.  Shingles of one component
    only come first in that order, then the rarer ones.  Copies of one text with
    many edits each thus drop out by their own edits, without being paired.
    """
    wanted = F.broadcast(members) if members.count() <= broadcast_ids // 3 else members      # 24 bytes a row
    sets = (docs.join(wanted, "doc_id").select("doc_id", "text", "component", "n_shingles").dropDuplicates(["doc_id"])
            .mapInArrow(lambda it: _shingle_rows(it, shingle), "doc_id bigint, component bigint, n bigint, shingles array<bigint>")
            .checkpoint())
    rows = sets.select("doc_id", "component", "n", F.explode("shingles").alias("s"))
    shared = at_rest(rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
              .where("lo < hi").select(F.col("s").alias("t"), "df"))
    prefix = at_rest(rows.join(shared, F.col("s") == F.col("t")).groupBy("doc_id", "component", "n")
              .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("l"))
              .withColumn("take", F.expr(f"int(n - (n * {percent} + 99) div 100 + 1 - (n - size(l)))")).where("take > 0")
              .select("doc_id", "component", "n", (F.col("n") - F.size("l")).alias("before"),
                      F.posexplode(F.expr("slice(l, 1, take)")).alias("i", "e"))
              .select("doc_id", "component", "n", (F.col("n") - F.col("before") - F.col("i")).alias("left"), F.col("e.s").alias("s")))
    other = prefix.select(F.col("doc_id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"), "s")
    # where a pair's first common shingle stands, what is left of either document bounds what they share
    return (prefix.join(other, "s").where(f"component < cb and 100 * least(n, nb) >= {percent} * greatest(n, nb)"
                                          f" and (100 + {percent}) * least(left, lb) >= {percent} * (n + nb)")
            .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct())


def _labelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, ...) with their component."""
    return (nodes.join(comps.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "_c"), "doc_id", "left")
            .withColumn("component", F.coalesce("_c", "doc_id")).drop("_c"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS,
                    halves: int = HALVES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id bigint, text string)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = at_rest(docs.mapInArrow(lambda it: _sign(it, shingle, rows, halves), _SIGNED), 20_000)
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = at_rest(linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")))
    reps = (linkable.join(classes.select("rep", F.col("h1").alias("c1"), F.col("h2").alias("c2")),
                          (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left_semi")
            .select("doc_id", "n_shingles", "halves").dropDuplicates(["doc_id"]))
    texts = docs.where("doc_id is not null and text is not null")

    shared = shared_keys.recurring(shared_keys.combined(reps, lambda batch: _emit(batch, halves), text=None))
    pairs = at_rest(shared.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct())
    tested = at_rest(confirm(pairs, texts, shingle, percent, broadcast_ids=broadcast_ids))
    comps = at_rest(components(tested.where("linked").select("a", "b")))

    # Tables in which a pair failed between two components: test what else they hold across components.
    ends = _labelled(_labelled(tested.where("not linked").withColumnRenamed("a", "doc_id"), comps)
                     .withColumnRenamed("doc_id", "a").withColumnRenamed("component", "ca").withColumnRenamed("b", "doc_id"), comps)
    open_centres = at_rest(ends.where("ca <> component").select("a").distinct())
    if open_centres.count():
        members = (tested.select("a", "b").join(open_centres, "a", "left_semi")
                   .select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        members = at_rest(_labelled(reps.select("doc_id", "n_shingles").join(members, "doc_id", "left_semi"), comps))
        more = at_rest(across(members, texts, shingle, percent, broadcast_ids).join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        again = confirm(more, texts, shingle, percent, broadcast_ids=broadcast_ids).where("linked").select("a", "b")
        comps = at_rest(components(tested.where("linked").select("a", "b").unionAll(again)))

    reached = _labelled(classes.withColumnRenamed("rep", "doc_id"), comps).select("h1", "h2", F.col("component").alias("c"))
    reached = at_rest(reached)
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(reached, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return (out.select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op10_minhash_tensor(spark, sf_dir: str) -> DataFrame:
    """Every document with its component of near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
         else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, least) as (
  select doc_id, doc_id from documents
  union
  select e.b, r.least from reach r join both_ways e on e.a = r.node where r.least < e.b)
select d.doc_id, coalesce(s.n, 0) as n_shingles, r.c as component_id, d.doc_id = r.c as kept
from documents d left join sizes s using (doc_id) join (select node, min(least) as c from reach group by node) r on r.node = d.doc_id
"""
