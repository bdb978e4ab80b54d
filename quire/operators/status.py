"""Report status: an append-only event log folded to the latest item per key.

A key-value status item is put when a report begins and updated in place while it runs.  On
Spark these writes are an event log — ``(organization_id, report_id, ts, seq, op, num, text,
item)`` — and the current item is a fold over it:

* ``create``   puts ``item`` (creator, creation stamp, name, number of ids asked for, archive
               name): it *replaces* whatever the key had, with status ``processing``,
               processed 0, not deleted, no percentage and no link
* ``progress`` sets processed_submissions (``num`` truncated)
* ``percent``  sets percent_complete (``num``)
* ``complete`` sets status (``text``: ``completed`` or ``incomplete``)
* ``file``     sets s3_filename (``text``; empty where nothing was delivered)
* ``link``     sets link (``text``)
* ``delete``   removes the item; later events rebuild it (an update of a
               missing item creates it, as a key-value store does)

Events are ordered by ``(ts, seq)``.  An attribute's value is the last one set
behind the key's last create or delete, else the put item's.  Both are ``max`` of
a struct that begins with (ts, seq): the last create or delete with its item, and for each
attribute its last update.  So the fold is one grouped aggregation, associative, a
map-side partial aggregate in which a hot key costs one row per partition, and
the state of a streaming aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["organization_id", "report_id"]

# Status texts of the report item.
PROCESSING = "processing"
COMPLETED = "completed"
INCOMPLETE = "incomplete"
IN_PROGRESS = "In-Progress"

ITEM = "struct<created_at: string, created_by: string, report_name: string, total_submissions: bigint, s3_filename: string>"
LOG_SCHEMA = f"organization_id string, report_id string, ts timestamp_ntz, seq bigint, op string, num double, text string, item {ITEM}"
LOG_COLUMNS = [*KEY, "ts", "seq", "op", "num", "text", "item"]
#: Attribute -> the event that updates it, and its value there.
UPDATES = {
    "processed_submissions": ("progress", F.floor, "num", "bigint"),
    "percent_complete": ("percent", None, "num", "double"),
    "status": ("complete", None, "text", "string"),
    "s3_filename": ("file", None, "text", "string"),
    "link": ("link", None, "text", "string"),
}


def fold_aggregates() -> list[Column]:
    """The per-key aggregates of the fold (associative; also usable as the
    state of a streaming aggregation)."""
    op, at = F.col("op"), [F.col("ts"), F.col("seq")]
    out = [F.max(F.struct(*at)).alias("_last"),
           F.max(F.when(op.isin("create", "delete"), F.struct(*at, op.alias("op"), F.col("item").alias("item")))).alias("_base")]
    for name, (event, change, column, kind) in UPDATES.items():
        value = (change(column) if change else F.col(column)).cast(kind)
        out.append(F.max(F.when(op == event, F.struct(*at, value.alias("v")))).alias(f"_{name}"))
    return out


def fold(log: DataFrame) -> DataFrame:
    """Per-key fold state (one row per key, deleted keys included)."""
    return log.groupBy(*KEY).agg(*fold_aggregates())


def finalize(state: DataFrame) -> DataFrame:
    """Status items from fold state: keys whose last event is a delete are absent."""
    base = F.col("_base")
    put = base.op == "create"
    begun = {"processed_submissions": F.lit(0).cast("bigint"), "status": F.lit(PROCESSING), "s3_filename": base.item.s3_filename}

    def updated(name: str) -> Column:
        s = F.col(f"_{name}")
        later = s.isNotNull() & (base.isNull() | (F.struct(s.ts, s.seq) > F.struct(base.ts, base.seq)))
        return F.when(later, s.v).when(put, begun.get(name, F.lit(None))).cast(UPDATES[name][3]).alias(name)

    def of_item(name: str) -> Column:
        return F.when(put, base.item[name]).alias(name)

    gone = (base.op == "delete") & (F.struct("_last.ts", "_last.seq") == F.struct(base.ts, base.seq))
    return state.where(~F.coalesce(gone, F.lit(False))).select(
        *KEY, of_item("created_at"), of_item("created_by"), F.when(put, F.lit(False)).alias("is_deleted"), of_item("report_name"),
        of_item("total_submissions"), *[updated(n) for n in UPDATES], F.col("_last.ts").alias("updated_at"))


def latest_status(log: DataFrame) -> DataFrame:
    """Current status item per (organization_id, report_id); deleted keys absent."""
    return finalize(fold(log))


def status_lookup(latest: DataFrame, organization_id: str | None = None,
                  report_id: str | None = None) -> DataFrame:
    """Items of one organization (optionally one report), whole, with the response a
    caller gets: ``completed`` plus the stored archive key, else ``In-Progress``."""
    df = latest
    if organization_id is not None:
        df = df.where(F.col("organization_id") == organization_id)
    if report_id is not None:
        df = df.where(F.col("report_id") == report_id)
    done = F.coalesce(F.col("status") == COMPLETED, F.lit(False))
    return df.select("*", F.when(done, F.lit(COMPLETED)).otherwise(F.lit(IN_PROGRESS)).alias("response_status"),
                     F.when(done, F.col("s3_filename")).alias("download_key"))


def event(df: DataFrame, organization_id: Column, report_id: Column, ts: Column, seq: Column, op: str, num: Column | None = None,
          text: Column | None = None, item: Column | None = None) -> DataFrame:
    """One log row for each row of ``df``."""
    none = F.lit(None)
    return df.select(organization_id.cast("string").alias("organization_id"), report_id.cast("string").alias("report_id"),
                     ts.cast("timestamp_ntz").alias("ts"), seq.cast("bigint").alias("seq"), F.lit(op).alias("op"),
                     (none if num is None else num).cast("double").alias("num"), (none if text is None else text).cast("string").alias("text"),
                     (none if item is None else item).cast(ITEM).alias("item"))


def tombstone(spark, organization_id: str, report_id: str) -> DataFrame:
    """A one-row ``delete`` event for appending to the status log."""
    return event(spark.range(1), F.lit(organization_id), F.lit(report_id),
                 F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp()),
                 F.unix_micros(F.current_timestamp()) * 1000, "delete")
