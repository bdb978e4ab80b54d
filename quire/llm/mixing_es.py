"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

*Targets.*  Sources in code-point order (null last) weigh ``WEIGHTS``, repeating, and
share all words of the input by weight.  A source's target stops at ``MAX_EPOCHS``
times its size; what it can't take goes to the others by weight, until none is
above.  That is a common level: target = min(MAX_EPOCHS * size, level * weight), and the
level follows from the sources in order of size / weight and two running sums.

*Taking.*  A source first gives floor(target / size) complete epochs.  The rest is
selected: each document has the exponential key -ln(u) / quality weight, u from a hash of
its doc_id, so smaller keys are drawn first with probability in proportion to the
weights; documents are taken in key order while their running size fits, and the
one at the border gives its first words only.  So a source's words meet its target
exactly (but for rounding), and reruns agree.

The running sums are made in two steps, so that no source is sorted in one task:
sizes are summed by (source, ``BUCKETS`` key ranges), running sums over the ranges find
the one that holds the border, and only its documents are sorted.

Quality weights: a document rated good counts ``GOOD``, one rated poor ``POOR``, else 1.

Defined results: null and empty texts have size 0 and take 0; a source of size 0 has
target 0; null is a source of its own; repeated rows, and rows without doc_id, are
documents of their own with equal keys, taken in the order of a hash of their texts (rows
with equal texts are alike); an empty table gives an empty mix; texts of any length are
counted whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.tables import broadcast_if_small
from quire.session import ensure_checkpoint_dir

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKETS = 4096
SEED = "mix-1"
#: Tables with a row for each source are broadcast up to so many sources.
SOURCES = 50_000
GOOD = 2.0
POOR = 0.5


def sizes(docs: DataFrame, quality: DataFrame | None = None, seed: str = SEED, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, key, tie) for each row of ``docs`` (doc_id, text, source), if
    ``whole`` with the row itself as ``row``; ``quality``: (doc_id, weight double > 0), distinct doc_ids."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source",
                       F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("size"),
                       F.xxhash64("text").alias("tie"), *row)
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(quality.select("doc_id", "weight"), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return rows.select("doc_id", "source", "size", (-F.log(u) / F.col("weight")).alias("key"), "tie", *(["row"] if whole else []))


def targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target double): one row for each source."""
    summed = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over all sources: one row each
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_need = Window.orderBy(F.col("source_size") / F.col("w"), "n")
    ranked = (summed.withColumn("n", F.row_number().over(order))
              .withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int")).cast("double"))
              .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
              .withColumn("w_all", F.sum("w").over(Window.partitionBy())))
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    # the level that the sources from here on would share, were all before at their limit
    levelled = (ranked.withColumn("level", (F.col("all") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                                  / (F.col("w_all") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
                .withColumn("limit", (max_epochs * F.col("source_size")).cast("double"))
                .withColumn("at", F.row_number().over(by_need)))
    # the level is that of the first source that stays below its limit
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.struct("at", "level"))).over(Window.partitionBy())
    return levelled.withColumn("first", first).withColumn("level", F.col("first.level")).select(
        "source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
        buckets: int = BUCKETS, seed: str = SEED, whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, epochs, extra, taken) for each row of ``docs``.

    ``epochs``: whole copies that the mix takes; ``extra``: first words of one more;
    taken = epochs * size + extra.  If ``whole``, ``row`` is the row of ``docs`` (doc_ids may be null or repeat).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sized = sizes(docs, quality, seed).checkpoint()                       # a few numbers a row
    aims = broadcast_if_small(targets(sized, weights, max_epochs).select(F.col("source").alias("s"), "source_size", "target"), SOURCES)

    def aimed(sized: DataFrame) -> DataFrame:
        return (sized.join(aims, sized["source"].eqNullSafe(aims["s"])).drop("s")
                .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
                .withColumn("rest", F.round(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size"))
                .withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-F.col("key"))) * buckets)).cast("int")))

    rows = aimed(sized)
    running = Window.partitionBy("source").orderBy("bucket")
    ranges = (rows.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
              .withColumn("upto", F.sum("words").over(running)).withColumn("before", F.col("upto") - F.col("words"))
              .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before",
                      F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), -1).otherwise(0).alias("part"))
              .checkpoint())
    # the one range of each source that holds its border; all in front of it go, all behind stay
    border = ranges.where("part = 0").select("s", F.col("b").alias("border"), "before")
    last = ranges.where("part = 1").groupBy(F.col("s").alias("s1")).agg(F.max("b").alias("full"))
    edge = last.join(border, F.col("s1").eqNullSafe(F.col("s")), "full").select(
        F.coalesce("s", "s1").alias("s"), F.coalesce("full", F.lit(-1)).alias("full"), "border", "before")
    if whole:                                                            # sized anew, so that texts are not checkpointed
        rows = aimed(sizes(docs, quality, seed, whole))
    placed = rows.join(broadcast_if_small(edge, SOURCES), rows["source"].eqNullSafe(edge["s"]), "left").drop("s")
    inside = F.col("border").isNotNull() & (F.col("bucket") == F.col("border"))
    sorted_ = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    cut = (placed.where(inside).withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(sorted_), F.lit(0)))
           .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).drop("ahead"))
    others = placed.where(~inside).withColumn("extra", F.when(F.col("bucket") <= F.col("full"), F.col("size")).otherwise(F.lit(0)))
    return (cut.unionByName(others)
            .select("doc_id", "size", "source_size", "target", "epochs", F.col("extra").cast("bigint").alias("extra"), *(["row"] if whole else []))
            .withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra")))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of the rated documents."""
    return (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
            .agg(F.when(F.min("quality") == 0, POOR).otherwise(GOOD).alias("weight")))


def op6_mixing_es(spark, sf_dir: str) -> DataFrame:
    """Every document's part in the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mix(docs, broadcast_if_small(quality_weights(labels))).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
with rated as (
  select doc_id, case when min(quality) = 0 then 0.5 else 2.0 end as weight from labels where quality is not null group by doc_id),
sized as (
  select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) as size,
         -ln((('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::bigint + 1)::double / 4503599627370496.0) / coalesce(r.weight, 1.0)::double as key
  from documents d left join rated r using (doc_id)),
sources as (select source, sum(size)::double as s, row_number() over (order by source is null, encode(source)) as n from sized group by source),
weighed as (select *, [5.0, 2.0, 1.0][(n - 1) % 3 + 1]::double as w from sources),
levels as (
  select *, (sum(s) over () - 3 * coalesce(sum(s) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as lv,
         row_number() over (order by s / w, n) as rk
  from weighed window before as (order by s / w, n rows between unbounded preceding and 1 preceding)),
aims as (
  select source, s, least(3 * s, coalesce((select min_by(lv, rk) from levels where lv * w <= 3 * s), 0) * w) as target from levels),
placed as (
  select z.doc_id, z.size, a.s as source_size, a.target, case when a.s > 0 then floor(a.target / a.s) else 0 end as epochs, round(a.target) as goal,
         coalesce(sum(z.size) over (partition by z.source order by z.key, z.doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from sized z join aims a on z.source is not distinct from a.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
       (epochs * size + greatest(0, least(size, goal - epochs * source_size - ahead)))::bigint as taken
from placed
"""
