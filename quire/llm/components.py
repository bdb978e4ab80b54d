"""Connected components of a link table, on the cluster.

Alternating large-star and small-star rounds (each a grouped minimum and a
join) turn the links into stars whose centre is the smallest node of its
component.  Nothing is collected; each step is cut with ``checkpoint()``.  A
node with a large share of all links is folded map-side by the grouped
minimum, and the joins read two plain tables, so that Spark's adaptive
execution can split such a node's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import at_rest


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = at_rest(least)
    return (both.where("b > a").join(least, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # here every link points from the larger node a to the smaller node b
    least = at_rest(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"))
    return (edges.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: bigint, not null);
    a component's name is its smallest node.  A link of a node with itself is
    ignored; no links give no rows."""
    edges = at_rest(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = at_rest(_small_star(at_rest(_large_star(edges))))
        after = _state(edges)
        if after == state:
            break
        state = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
