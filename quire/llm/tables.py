"""Small helpers on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ensure_checkpoint_dir

#: Rows of a few numbers that one task reads well.
TASK_ROWS = 200_000
#: Rows of a few numbers each that may be broadcast: some 32 MB.
BROADCAST_ROWS = 1_000_000


def at_rest(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` checkpointed, and read in as many tasks as its rows need: a small table
    that came out of many partitions doesn't make many tasks and files again."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return df.coalesce(max(2, -(-df.count() // task_rows)))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` at rest, marked for broadcasting if it has at most ``rows`` rows;
    beyond that it is joined by a shuffle.  For tables of a few numeric columns."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= rows else df
