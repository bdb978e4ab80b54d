"""Embedding near-dedup by sorted projection passes.

Vectors are linked when their cosine (double precision) is ``THRESHOLD`` or more.  Each
pass draws random hyperplanes; a vector's key is the sequence of its sides of them.
Ordered by that key, vectors at a small angle mostly stand near each other, so each
is compared with a bounded window of neighbours.  Passes are independent, and links
found by any pass are joined.

A pair at the threshold's angle agrees in a hyperplane with probability a = 1 - angle / pi.
The number of passes follows from the rows as if hyperplanes halved them, so that such a pair is
missed by all passes with probability ``MISS``.  Where many vectors lie in a narrow cone they
hardly split it, so each pass also measures how well it has served each vector: with b - 1 the longer
of the key prefixes that the vector shares with the two ends of what it was compared with, all
vectors that share b bits with it are among these, and a threshold pair is with probability
a ** b.  A vector whose pairs would be missed by all passes with a probability over ``LACK`` (in
cones, and where partitions end) is *dense*.  A link that is missed with more than that
probability has two dense ends, so dense vectors are compared with each other exactly, in tiles
of ``DENSE_TILE`` rows that tasks hold two of at a time.  The work of that grows with the square
of the dense vectors, the price of losing no link; on vectors that hyperplanes do split
there are next to none.

Dense groups do not depend on the window: the passes only need to connect them (each
block of neighbours sends a spanning forest of its links, never all pairs).  Direct
links are then counted within each component, in tiles of ``TILE`` x ``TILE`` vectors, as
counts and not as rows.  Equal vectors are one node with a weight.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing (n_links 0, component their own id, kept); vectors of
different lengths are never compared; rows that share a vec_id count as one node; a
null vec_id links with nothing and is kept; labels and extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.session import ensure_checkpoint_dir

THRESHOLD = 0.95
WINDOW = 256
BLOCK = 1024
TILE = 1024
BITS = 48
MISS = 1e-4
LACK = 0.01
DENSE_TILE = 8192
_COMPARED = "a bigint, b bigint, lack double"
_LINKS = "a bigint, b bigint"
_TILES = "dim int, tile bigint, ids binary, vectors binary"


def passes_for(rows: int, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes needed for ``rows`` distinct vectors."""
    agree = 1 - math.acos(threshold) / math.pi
    found = agree ** max(0.0, math.log2(max(rows, 1) / (window / 2)))
    return 4 if found > 0.9 else math.ceil(math.log(miss) / math.log(1 - found)) + 2


def _planes(number: int, dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([19, number, dim])).standard_normal((dim, BITS))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.filter(pa.array(dims == dim))


def _keys(batches, passes: int):
    """(pass, dim, key, id, embedding): a row for each vector and pass."""
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    for batch in batches:
        for dim, part in _by_dim(batch):
            x = _unit(part.column("embedding"), dim)
            for number in range(passes):
                key = ((x @ _planes(number, dim)) > 0) @ weights
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), number, np.int32)), pa.array(np.full(len(x), dim, np.int32)), pa.array(key), part.column("id"),
                     part.column("embedding")], names=["pass", "dim", "key", "id", "embedding"])


def _forest(ids: np.ndarray, linked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the symmetric boolean matrix ``linked`` connects: at most one for each row."""
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return []
    sub = linked[np.ix_(some, some)]
    np.fill_diagonal(sub, True)
    label = np.arange(len(some))
    while True:
        least = np.where(sub, label[None, :], len(some)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    child = label != np.arange(len(some))
    return [(ids[some[label[child]]], ids[some[child]])]


def _links(ids: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning links among the rows of a block (unit vectors)."""
    rough = x.astype(np.float32)
    near = (rough @ rough.T) >= threshold - 1e-4
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    for a in range(0, len(i), 65536):                          # double precision decides
        s = slice(a, a + 65536)
        far = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) < threshold
        near[i[s][far], j[s][far]] = near[j[s][far], i[s][far]] = False
    return _forest(ids, near)


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of keys."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def _compare(batches, threshold: float, window: int, block: int):
    """Rows sorted by (pass, dim, key): blocks of neighbours, each with the last ``window`` rows before it.

    Gives links (a, b, null), and for each row (a, null, log of the probability that this pass misses a
    threshold pair of it)."""
    agree = 1 - math.acos(threshold) / math.pi
    group, ids, rows, keys, ends = None, [], [], [], []
    out: list[pa.RecordBatch] = []

    def flush(keep: int):
        nonlocal ids, rows, keys, ends
        all_ids, x, key = np.concatenate(ids), np.concatenate(rows), np.concatenate(keys)
        end = np.concatenate([*ends, np.full(len(key) - sum(map(len, ends)), key[0])])     # first of what each row has met
        if len(all_ids) > 1:
            for a, b in _links(all_ids, x, threshold):
                out.append(pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], names=["a", "b", "lack"]))
        n = len(key) - keep                                    # the others meet the next block as well
        bits = 1 + np.maximum(_shared_bits(key[:n], end[:n]), _shared_bits(key[:n], key[-1:]))
        out.append(pa.RecordBatch.from_arrays([pa.array(all_ids[:n]), pa.nulls(n, pa.int64()), pa.array(np.log1p(-agree ** bits))], names=["a", "b", "lack"]))
        ids, rows, keys, ends = ([c[n:]] if keep else [] for c in (all_ids, x, key, end))

    for batch in batches:
        number, dims = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
        edges = np.append(0, np.flatnonzero((number[1:] != number[:-1]) | (dims[1:] != dims[:-1])) + 1) if len(number) else ()
        for a, b in zip(edges, np.append(edges[1:], len(number))):
            if group != (number[a], dims[a]):
                if ids:
                    flush(0)
                group = (number[a], dims[a])
            part = batch.slice(a, b - a)
            x, these, key = _unit(part.column("embedding"), int(dims[a])), part.column("id").to_numpy(), part.column("key").to_numpy()
            at = 0
            while at < len(x):
                have = sum(map(len, ids))
                to = min(len(x), at + max(1, block + window - have))
                ids.append(these[at:to])
                rows.append(x[at:to])
                keys.append(key[at:to])
                at = to
                if sum(map(len, ids)) >= block + window:
                    flush(window)
        yield from out
        out.clear()
    if ids:
        flush(0)
        yield from out


def _tiles(batches, tile: int):
    """Sorted dense vectors -> rows of up to ``tile`` packed unit vectors."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict[int, list] = {}

    def packed(dim: int) -> pa.RecordBatch:
        nonlocal number
        ids, x = (np.concatenate(c) for c in zip(*held.pop(dim)))
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()),
                                           pa.array([x.tobytes()], pa.binary())], names=["dim", "tile", "ids", "vectors"])

    for batch in batches:
        for dim, part in _by_dim(batch):
            x, ids = _unit(part.column("embedding"), dim), part.column("id").to_numpy()
            for a in range(0, len(x), tile):
                held.setdefault(dim, []).append((ids[a:a + tile], x[a:a + tile]))
                if sum(len(i) for i, _ in held[dim]) >= tile:
                    yield packed(dim)
    for dim in list(held):
        yield packed(dim)


def _compare_tiles(batches, threshold: float, block: int):
    """Rows (dim, to, role, ids, vectors) sorted by (dim, to, role): the tile ``to`` itself (role 0), then tiles before it."""
    own = None
    for batch in batches:
        for i in range(batch.num_rows):
            dim, role = batch.column("dim")[i].as_py(), batch.column("role")[i].as_py()
            ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
            x = np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float64).reshape(-1, dim)
            if role == 0:
                own = ids.copy(), x.copy()
            out = []
            for a in range(0, len(x), block):
                for b in range(a if role == 0 else 0, len(own[0]), block):
                    if role == 0 and a == b:
                        out += _links(ids[a:a + block], x[a:a + block], threshold)
                    else:
                        out += _links(np.concatenate([ids[a:a + block], own[0][b:b + block]]), np.concatenate([x[a:a + block], own[1][b:b + block]]), threshold)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in (0, 1)], names=["a", "b"])


def _dense_links(dense: DataFrame, threshold: float, block: int, tile: int) -> DataFrame:
    """Links (connecting what is linked) among ``dense`` (id, embedding), exactly: every tile meets itself and those before it."""
    tiles = (dense.select("id", "embedding").mapInArrow(lambda it: _keys(it, 1), "pass int, dim int, key bigint, id bigint, embedding array<double>")
             .repartitionByRange("dim", "key", "id").sortWithinPartitions("dim", "key", "id")
             .mapInArrow(lambda it: _tiles(it, tile), _TILES).checkpoint())
    places = tiles.select(F.col("dim").alias("_dim"), F.col("tile").alias("to"))          # a number for each tile of rows
    own = tiles.select("dim", F.col("tile").alias("to"), F.lit(0).alias("role"), "ids", "vectors")
    earlier = tiles.join(places, (F.col("dim") == F.col("_dim")) & (F.col("tile") < F.col("to"))).select("dim", "to", F.lit(1).alias("role"), "ids", "vectors")
    return (own.unionAll(earlier).repartition("dim", "to").sortWithinPartitions("dim", "to", "role")
            .mapInArrow(lambda it: _compare_tiles(it, threshold, block), _LINKS))


def _count(batches, threshold: float):
    """Rows sorted by (component, i, j, role): role 0 the tile's targets, role 1 the vectors that count their links among them."""
    tile, ids, weights, rows = None, None, None, None
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in ("component", "i", "j", "role")]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        edges = np.append(0, np.flatnonzero(change))
        out = []
        for a, b in zip(edges, np.append(edges[1:], batch.num_rows)):
            here = tuple(int(k[a]) for k in keys[:3])
            part = batch.slice(a, b - a)
            dim = len(part.column("embedding")[0])
            x = _unit(part.column("embedding"), dim)
            these, weight = part.column("id").to_numpy(), part.column("weight").to_numpy()
            if here != tile:
                tile, held, ids = here, [], None
            if keys[3][a] == 0:
                held.append((these, weight, x))
                ids = None
                continue
            if ids is None and held:
                ids, weights, rows = (np.concatenate([h[k] for h in held]) for k in range(3))
            if ids is None:
                continue
            linked = (x @ rows.T >= threshold) & (these[:, None] != ids[None, :])
            out.append((these, linked @ weights))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]).astype(np.int64)) for k in (0, 1)], names=["id", "n"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, tile: int = TILE,
                    miss: float = MISS, lack: float = LACK, dense_tile: int = DENSE_TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding array<float or double>)."""
    ensure_checkpoint_dir(vectors.sparkSession)
    usable = ("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) "
              "and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    marked = rows.withColumn("ok", F.coalesce(F.expr(usable), F.lit(False)))
    keyed = (marked.withColumn("h1", F.when(F.col("ok"), F.xxhash64("embedding")))
             .withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), F.reverse("embedding")))))
    classes = (keyed.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight")).checkpoint())
    nodes = (keyed.where("ok").join(classes.select("id", "weight", F.col("h1").alias("c1"), F.col("h2").alias("c2")),
                                    (F.col("vec_id") == F.col("id")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")))
             .select("id", "weight", "embedding").dropDuplicates(["id"]).checkpoint())
    passes = passes_for(nodes.count(), threshold, window, miss)
    sorted_rows = (nodes.select("id", "embedding")
                   .mapInArrow(lambda it: _keys(it, passes), "pass int, dim int, key bigint, id bigint, embedding array<double>")
                   .repartitionByRange("pass", "dim", "key", "id").sortWithinPartitions("pass", "dim", "key", "id"))
    compared = sorted_rows.mapInArrow(lambda it: _compare(it, threshold, window, block), _COMPARED).checkpoint()
    lacking = compared.where("b is null").groupBy("a").agg(F.sum("lack").alias("lack")).where(F.col("lack") > math.log(lack)).select(F.col("a").alias("_a"))
    dense = nodes.join(lacking, F.col("id") == F.col("_a"), "left_semi")
    links = (compared.where("b is not null").select("a", "b").distinct()
             .unionAll(_dense_links(dense, threshold, block, dense_tile)).checkpoint())
    comps = components(links).checkpoint()

    # direct links: every component in tiles of its blocks, each vector against each block
    sizes = comps.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks")).checkpoint()
    members = (nodes.join(comps, F.col("id") == F.col("node")).join(sizes.withColumnRenamed("component", "c"), F.col("component") == F.col("c"))
               .select("component", "id", "weight", "embedding", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own")))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = members.select("component", F.col("own").alias("i"), others.alias("j"), F.lit(1).alias("role"), "id", "weight", "embedding")
    told = members.select("component", others.alias("i"), F.col("own").alias("j"), F.lit(0).alias("role"), "id", "weight", "embedding")
    counted = (asks.unionAll(told).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "role", "id")
               .mapInArrow(lambda it: _count(it, threshold), "id bigint, n bigint")
               .groupBy("id").agg(F.sum("n").alias("n")).checkpoint())

    found = (classes.join(counted.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").drop("i")
             .join(comps, F.col("id") == F.col("node"), "left")
             .select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
                     F.coalesce("component", "id").alias("comp")).checkpoint())
    out = (keyed.select("vec_id", "h1", "h2").checkpoint()
           .join(found, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
           .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_passes(spark, sf_dir: str) -> DataFrame:
    """Every vector with its direct links and component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
with recursive unit as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(node, least) as (
  select vec_id, vec_id from embeddings
  union
  select l.b, r.least from reach r join links l on l.a = r.node where r.least < l.b)
select v.vec_id, coalesce(n.n, 0) as n_links, r.c as component_id, v.vec_id = r.c as kept
from embeddings v left join (select a, count(*) as n from links group by a) n on n.a = v.vec_id
     join (select node, min(least) as c from reach group by node) r on r.node = v.vec_id
"""
