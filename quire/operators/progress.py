"""Batch progress, coverage and the report summary of an audit run.

The original run walks the requested ids in batches of two, updating a
processed count and a percentage after each id.  Here the same figures are
columns of a DataFrame computed in one pass: the ordinal of each id comes from
a distributed row index (range-partitioned sort + per-partition offsets), not
from a global window that would pull every id into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import REPORT_STAMP_FORMAT
from ..session import ensure_checkpoint_dir
from .status import COMPLETED, INCOMPLETE

COUNT_PER_BATCH = 2   # fixed value: submissions per batch in the original run


def with_row_index(df: DataFrame, order_cols: list[str], name: str = "row_index",
                   total: str | None = None) -> DataFrame:
    """Add a 1-based ordinal by ``order_cols`` (and the row total if asked).

    Plan: ``orderBy`` range-partitions the rows; each row takes its position
    inside its partition from ``monotonically_increasing_id`` (partition index
    in the high bits, position in the low 33).  The sorted frame is written
    with ``checkpoint()`` to the shared checkpoint folder so both uses below
    see the same partitioning.  The per-partition counts — one row per
    partition, a size bounded by the partition count — get running offsets and
    are broadcast back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    s = (df.orderBy(*order_cols)
         .select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m"))
         .checkpoint(eager=True))
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    out = s.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_off") + local + 1)
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_p", "_m", "_off", "_total")


def _pct(num, den) -> F.Column:
    """round(num / den * 100, 2) in exact decimal arithmetic, as a double."""
    return F.round(num.cast("decimal(20,0)") * 100 / den.cast("decimal(20,0)"), 2).cast("double")


REPORT = ["organization_id", "report_name"]
#: Reports whose totals are broadcast (a few values each); beyond that they are joined by a shuffle.
BROADCAST_REPORTS = 100_000


def batch_progress(ids: DataFrame, per_batch: int = COUNT_PER_BATCH, order_by: tuple[str, ...] = ("position",)) -> DataFrame:
    """Per requested id, in the order of the request (``order_by``) and with its
    repeats: batch, position, running count, percent.  With ``REPORT`` columns, for each report by itself:
    one index over all requests, less what precedes the report."""
    tags = REPORT if "report_name" in ids.columns else []
    idx = with_row_index(ids.select(*tags, "submission_id", *order_by), [*tags, *order_by], "processed_total",
                         total="total_submissions")
    if tags:
        sizes = idx.groupBy(*[F.col(c).alias(f"_{c}") for c in tags]).agg(F.min("processed_total").alias("_first"), F.count(F.lit(1)).alias("_n"))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_REPORTS else sizes
        idx = idx.join(sizes, [idx[c].eqNullSafe(sizes[f"_{c}"]) for c in tags]).withColumns(
            {"processed_total": F.col("processed_total") - F.col("_first") + 1, "total_submissions": F.col("_n")})
    n, tot = F.col("processed_total"), F.col("total_submissions")
    batch = F.floor((n - 1) / per_batch).cast("long") + 1
    size = F.least(F.lit(per_batch).cast("long"), tot - (batch - 1) * per_batch)
    pos = (n - 1) % per_batch + 1
    pct = _pct(n, tot)
    return idx.select(
        *tags, "submission_id",
        batch.alias("batch_index"),
        pos.alias("position_in_batch"),
        size.alias("batch_size"),
        "processed_total",
        "total_submissions",
        pct.alias("percent_processed"),
        F.floor(pct).cast("int").alias("percent_processed_int"),
        _pct(pos, size).alias("percent_of_batch"),
    )


def submission_coverage(ids: DataFrame, forms: DataFrame, files: DataFrame) -> DataFrame:
    """Each requested id (of each report, with ``REPORT`` columns) with flags: has form rows, has files."""
    key = [*(REPORT if "report_name" in ids.columns else []), "submission_id"]
    req = ids.select(*key).distinct()
    f = forms.select(*key).distinct().withColumn("has_form_rows", F.lit(True))
    a = files.select(*key).distinct().withColumn("has_files", F.lit(True))
    return (req.join(f, key, "left").join(a, key, "left")
            .select(*key,
                    F.coalesce("has_form_rows", F.lit(False)).alias("has_form_rows"),
                    F.coalesce("has_files", F.lit(False)).alias("has_files")))


def report_summary(asked: DataFrame, visited: DataFrame, coverage: DataFrame, run_ts: str | None = None,
                   report_id: str | None = None, created_by: str | None = None) -> DataFrame:
    """The status item of each report after a run.

    ``asked`` (organization_id, report_name, position, submission_id) is the request, in its order and with its
    repeats; ``visited`` has the (organization_id, report_name, position) that the run came to; ``coverage`` has one
    row per submission id, or per report and submission id.  The total is the length of the request; an id asked for twice is visited twice.  A
    report is ``completed`` when as many places were visited as were asked for, else ``incomplete``, with an
    empty archive name.  Ids without form rows are visited as well; ``submissions_with_forms`` and
    ``submissions_with_files`` count the different ids that had any.  ``report_id`` is for a single report; otherwise it is
    a digest of organization, name and ``run_ts`` (default: now).
    """
    ts = F.to_timestamp(F.lit(run_ts)) if run_ts else F.current_timestamp()
    stamp = F.date_format(ts, REPORT_STAMP_FORMAT)
    came = visited.select(*[F.col(c).alias(f"_{c}") for c in (*REPORT, "position")]).distinct().withColumn("_came", F.lit(True))
    here = [asked[c].eqNullSafe(came[f"_{c}"]) for c in (*REPORT, "position")]
    seen = asked.join(came, here, "left").select(*REPORT, "submission_id", F.coalesce("_came", F.lit(False)).alias("_came"))
    ids = (seen.groupBy(*REPORT, "submission_id").agg(F.count(F.lit(1)).alias("_asked"), F.count_if("_came").alias("_visited"))
           .join(coverage, [c for c in (*REPORT, "submission_id") if c in coverage.columns], "left"))
    agg = ids.groupBy(*REPORT).agg(
        F.sum("_asked").alias("total_submissions"), F.sum("_visited").alias("processed_submissions"),
        F.count_if((F.col("_visited") > 0) & F.coalesce("has_form_rows", F.lit(False))).alias("submissions_with_forms"),
        F.count_if((F.col("_visited") > 0) & F.coalesce("has_files", F.lit(False))).alias("submissions_with_files"))
    whole = F.col("processed_submissions") == F.col("total_submissions")
    rid = F.lit(report_id) if report_id else F.md5(F.concat_ws("/", *REPORT, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    archive = F.concat(F.lit("AuditGrp"), "report_name", stamp, F.lit(".zip"))
    return agg.select(
        "organization_id", rid.alias("report_id"), "report_name", stamp.alias("created_at"),
        F.lit(created_by).cast("string").alias("created_by"), F.lit(False).alias("is_deleted"),
        "total_submissions", "processed_submissions", "submissions_with_forms", "submissions_with_files",
        F.when(whole, F.lit(COMPLETED)).otherwise(F.lit(INCOMPLETE)).alias("status"),
        F.when(whole, archive).otherwise(F.lit("")).alias("s3_filename"))
