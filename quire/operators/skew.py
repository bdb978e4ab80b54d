"""Hot-key salting for fact ⋈ dimension joins.

AQE splits a skewed sort-merge join only in some plan shapes (a join whose
inputs come straight from the scans); a skewed join stacked on another join
is left alone, and one task then handles every row of a hot key.  For the
joins where a single key can hold a large share of the fact (a submission, a
field, an option id), quire salts explicitly:

1. ``hot_keys``: count rows per key on the fact's *scan* (a partial
   aggregate over the key columns only) and keep keys with at least
   ``min_rows`` rows.  When ``min_rows`` is large the count runs on a
   fixed-seed sample of rate ``SAMPLE_AT_THRESHOLD / min_rows`` (about 100
   sampled rows for a key right at the threshold; the chance to miss such a
   key is ~1e-8), so detection does not shuffle one row per distinct key of
   a huge fact.  The sample only decides *which* keys are salted: every row
   is still joined, and a key the sample misses takes the plain join, which
   is just as exact.  ``exact=True`` counts every row (the sinks' split
   decision needs exact sizes).  At most the ``MAX_HOT_KEYS`` heaviest of them are
   fetched (a distributed top-k), so what is broadcast has a checked size;
   keys beyond that take the plain join path, which is just as exact.  Each
   hot key gets ``ceil(rows / min_rows)`` salts.
2. ``salted_join``: fact rows of a hot key take salt ``xxhash64(row) mod n``,
   the dimension rows of that key are replicated ``n`` times (one per salt),
   all other rows have salt 0; the join runs on (keys, salt).  Every fact row
   still meets exactly the dimension rows it met before, so inner and left
   joins return the same rows.  Null keys are counted and salted like others.
   The salt comes from the row's content, so that a re-run task deals its rows
   as before; rows that are equal in every column share it.

The threshold is the session setting ``quire.skew.hotKeyRows`` (default one
million rows; ``0`` disables salting).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_KEY_ROWS_CONF = "quire.skew.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000        # bound on the broadcast hot-key list
SAMPLE_AT_THRESHOLD = 100    # expected sampled rows of a key with exactly min_rows rows
SAMPLE_SEED = 17


def _counted(df: DataFrame, min_rows: int, exact: bool) -> tuple[DataFrame, float, float]:
    """(rows to count, scale from counted to estimated rows, count cut-off)."""
    f = 1.0 if exact else min(1.0, SAMPLE_AT_THRESHOLD / min_rows)
    if f >= 1.0:
        return df, 1.0, float(min_rows)
    return df.sample(fraction=f, seed=SAMPLE_SEED), 1.0 / f, SAMPLE_AT_THRESHOLD / 2


def hot_key_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_KEY_ROWS_CONF, str(DEFAULT_HOT_KEY_ROWS)))


def hot_keys(df: DataFrame, keys: list[str], min_rows: int | None = None,
             exact: bool = False) -> DataFrame | None:
    """The (at most ``MAX_HOT_KEYS`` heaviest) keys of ``df`` with at least
    ``min_rows`` rows and their salt count, or None when there are none or
    salting is off."""
    min_rows = hot_key_rows(df) if min_rows is None else min_rows
    if min_rows <= 0:
        return None
    src, scale, cut = _counted(df, min_rows, exact)
    counts = (src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") >= cut))
    rows = counts.orderBy(F.col("_n").desc()).limit(MAX_HOT_KEYS).collect()   # bounded top-k
    if not rows:
        return None
    data = [tuple(r[k] for k in keys) + (math.ceil(r["_n"] * scale / min_rows),)
            for r in rows]
    schema = counts.select(*keys).schema.add("_salts", T.IntegerType(), False)
    return df.sparkSession.createDataFrame(data, schema)


def hot_keys_many(df: DataFrame, key_sets: list[list[str]],
                  min_rows: int | None = None) -> dict[tuple[str, ...], DataFrame | None]:
    """``hot_keys`` for several key sets in one job (``groupingSets``: one
    scan, one partially aggregated shuffle)."""
    min_rows = hot_key_rows(df) if min_rows is None else min_rows
    sets = [tuple(ks) for ks in dict.fromkeys(tuple(k) for k in key_sets)]
    if min_rows <= 0 or not sets:
        return {ks: None for ks in sets}
    cols = sorted({c for ks in sets for c in ks})

    def gid(ks):   # grouping_id bit i is set when cols[i] is *not* grouped
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in ks)

    src, scale, cut = _counted(df, min_rows, False)
    counts = (src.groupingSets([[F.col(c) for c in ks] for ks in sets], *cols)
              .agg(F.count(F.lit(1)).alias("_n"), F.grouping_id().alias("_g"))
              .where(F.col("_n") >= cut))
    heaviest = Window.partitionBy("_g").orderBy(F.col("_n").desc())
    rows = (counts.withColumn("_r", F.row_number().over(heaviest)).where(F.col("_r") <= MAX_HOT_KEYS)
            .orderBy("_g", "_r").collect())          # bounded top-k of each key set
    out: dict[tuple[str, ...], DataFrame | None] = {}
    types = {f.name: f.dataType for f in df.schema.fields}
    for ks in sets:
        mine = [r for r in rows if r["_g"] == gid(ks)]     # heaviest first
        if not mine:
            out[ks] = None
            continue
        data = [tuple(r[k] for k in ks) + (math.ceil(r["_n"] * scale / min_rows),)
                for r in mine]
        schema = T.StructType([T.StructField(k, types[k]) for k in ks]).add("_salts", T.IntegerType(), False)
        out[ks] = df.sparkSession.createDataFrame(data, schema)
    return out


def salted_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str,
                hot: DataFrame | None) -> DataFrame:
    """``left`` ⋈ ``right`` on ``left[a] == right[b]`` for (a, b) in ``pairs``;
    ``hot`` (from ``hot_keys`` over the left key columns) salts the hot keys.
    Column names of the two sides must be distinct."""
    cond = _on(left, right, pairs)
    if hot is None:
        return left.join(right, cond, how)
    lkeys = [a for a, _ in pairs]
    h = F.broadcast(hot)                                   # size checked in hot_keys
    # null-safe: rows without a key match nothing, but they are rows of one partition too
    lh = left.join(h.select(*[F.col(k).alias(f"_hot_{k}") for k in lkeys], "_salts"),
                   [left[k].eqNullSafe(F.col(f"_hot_{k}")) for k in lkeys], "left").drop(*[f"_hot_{k}" for k in lkeys])
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_salts")).cast("int"))
    lsalted = lh.withColumn("_salt_l", salt).drop("_salts")
    hr = hot.select(*[F.col(a).alias(b) for a, b in pairs], "_salts")
    rh = right.join(F.broadcast(hr), [b for _, b in pairs], "left")
    copies = F.when(F.col("_salts").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("_salts") - 1))
    rsalted = rh.withColumn("_salt_r", F.explode(copies)).drop("_salts")
    cond = _on(lsalted, rsalted, pairs) & (lsalted["_salt_l"] == rsalted["_salt_r"])
    return lsalted.join(rsalted, cond, how).drop("_salt_l", "_salt_r")


def _on(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    cond = None
    for a, b in pairs:
        c = left[a] == right[b]
        cond = c if cond is None else cond & c
    return cond
