"""Streaming status fold: restart from the checkpoint after new log files
arrive and end with the same items as the batch fold of the whole log."""

import os

from quire.operators import status
from quire.streaming import status_stream

from .test_status_progress import log_of


def _items(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_incremental_fold_matches_batch(spark, scratch):
    first = log_of(spark, [("a", 1, "create", None, None, "A"), ("a", 2, "progress", 1.0), ("b", 3, "create", None, None, "B")])
    second = log_of(spark, [("a", 4, "complete", None, "completed"), ("a", 4, "file", None, "a.zip"), ("b", 5, "delete"), ("c", 6, "progress", 2.0)])
    third = log_of(spark, [("a", 7, "create", None, None, "A2"), ("d", 8, "percent", 3.0)])
    log_dir, ckpt = (os.path.join(scratch, x) for x in ("log", "ckpt"))
    whole, seen = None, []
    for part in (first, second, third):
        part.repartition(2).write.mode("append").parquet(log_dir)
        q = status_stream.start_status_fold(spark, log_dir, ckpt, files_per_batch=1)
        q.awaitTermination()
        assert q.exception() is None
        whole = part if whole is None else whole.unionByName(part)
        seen.append(_items(status_stream.read_items(spark, ckpt)))
        assert seen[-1] == _items(status.latest_status(whole))
    assert {r[1] for r in seen[1]} == {"a", "c"} and {r[1] for r in seen[2]} == {"a", "c", "d"}
    assert _items(status_stream.read_items(spark, ckpt, batch=q.lastProgress["batchId"])) == seen[2]
    assert sorted(os.listdir(scratch)) == ["ckpt", "log"]        # the state store is the only table
