"""End-to-end audit report: request -> sections -> files -> status.

``run_audit_report`` is the whole job of one report request, ``run_audit_reports`` that of
any number of them, as a handful of Spark jobs (no loop over submissions or
reports, no in-memory archive):

1. the six sections are planned once (``exports.sections``);
2. the folder tree is written: one headed CSV per destination path;
3. one archive per submission is written with that submission's CSVs, the
   readme, and its attachments (rows of contents, or streamed from an object store);
4. coverage, batch progress and the report summary are written as parquet;
5. the report's status events (create, progress, complete) are appended to the
   status log, whose fold (batch or streaming) gives the report's status item.

Outputs live under ``<out_root>/<report_id>/``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports, progress, sink, status
from ..session import scratch_dir
from ..sources import objects
from ..sources.requests import at_rest
from ..sources.views import AuditTables


@dataclass
class AuditRun:
    report_id: str
    folder: DataFrame        # committed CSV manifest
    archives: DataFrame      # committed archive manifest
    summary: DataFrame       # the report's status item after the run
    attachments: DataFrame | None


def status_events(summary: DataFrame, run_ts: str, progress_df: DataFrame | None = None) -> DataFrame:
    """Status events of finished runs, ordered by ``seq``: the put of the item; with
    ``progress_df`` (from ``batch_progress``, with its reports' columns) a processed-count
    and a percent event per submission in processing order; the final count;
    status, archive name and, for a completed report, its link."""
    ts = F.to_timestamp_ntz(F.lit(run_ts))                   # UTC, as the tombstones' clock
    base = (F.unix_micros(F.current_timestamp()) * 1000).cast("bigint")
    end = F.lit(1 << 40)
    stamp_name = F.concat(F.lit("AuditGrp"), "report_name", "created_at", F.lit(".zip"))
    item = F.struct("created_at", "created_by", "report_name", "total_submissions", stamp_name.alias("s3_filename"))

    def ev(df, order, op, num=None, text=None, item=None):
        return status.event(df, F.col("organization_id"), F.col("report_id"), ts, base + order, op, num, text, item)

    parts = [ev(summary, F.lit(0), "create", item=item)]
    if progress_df is not None:
        n = F.col("processed_total")
        steps = progress_df.join(summary.select(*exports.REPORT, "report_id"), exports.REPORT)
        parts.append(ev(steps, n * 2 + 1, "progress", n))
        parts.append(ev(steps, n * 2 + 2, "percent", F.col("percent_processed")))
    parts.append(ev(summary, end, "progress", F.col("processed_submissions")))
    parts.append(ev(summary, end + 1, "complete", text=F.col("status")))
    parts.append(ev(summary, end + 2, "file", text=F.col("s3_filename")))
    parts.append(ev(summary.where(F.col("status") == status.COMPLETED), end + 3, "link", text=F.col("s3_filename")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _write(spark: SparkSession, a: AuditTables, organization_id: str | None, ids: DataFrame, root: str, objects_root: str | None,
           contents: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(folder manifest, archive manifest, attachments) of the report, or the reports, that ``ids`` ask for."""
    secs = exports.sections(spark, a, organization_id, ids, materialize_dir=scratch_dir(spark, "audit"))
    folder = sink.write_csv_files(spark, secs, f"{root}/folder")
    attachments = packed = None
    if contents is not None:
        packed = exports.attachments(secs["files"], contents)
    elif objects_root:
        tags = [c for c in exports.REPORT if c in secs["files"].columns]
        fm = secs["files"].select(*tags, "submission_id", "bucket_name", "storage_key", "folder_directory")
        attachments = objects.fetch_attachments(spark, fm, objects_root)
        attachments.write.mode("overwrite").parquet(f"{root}/attachments")
        attachments = spark.read.parquet(f"{root}/attachments")
        packed = attachments.where(F.col("status") == objects.OK)
    archives = sink.write_archives(spark, secs, f"{root}/by_submission", readme=("Audit_Folder/readme.csv", exports.README_TEXT),
                                   attachments=packed, objects_root=objects_root)
    return folder, archives, attachments


def _conclude(spark: SparkSession, a: AuditTables, organization_id: str | None, asked: DataFrame, covered: DataFrame, root: str,
              status_log_dir: str | None, run_ts: str, report_id: str | None) -> DataFrame:
    """Coverage (by existence: semi-joins on key columns), progress and status items of the reports; their events."""
    coverage = progress.submission_coverage(covered, *exports.submissions_with_rows(a, organization_id, covered))
    coverage.write.mode("overwrite").parquet(f"{root}/coverage")
    progress.batch_progress(asked).write.mode("overwrite").parquet(f"{root}/progress")
    progress_df = spark.read.parquet(f"{root}/progress")
    visited = progress_df.select(*exports.REPORT, F.col("processed_total").alias("position"), "submission_id")
    progress.report_summary(visited, visited, spark.read.parquet(f"{root}/coverage"), run_ts=run_ts,
                            report_id=report_id).write.mode("overwrite").parquet(f"{root}/summary")
    summary = spark.read.parquet(f"{root}/summary")
    if status_log_dir:
        status_events(summary, run_ts, progress_df).write.mode("append").parquet(status_log_dir)
    return summary


def run_audit_report(spark: SparkSession, a: AuditTables, organization_id: str, report_name: str,
                     ids: DataFrame, out_root: str, objects_root: str | None = None,
                     status_log_dir: str | None = None, run_ts: str | None = None,
                     report_id: str | None = None, contents: DataFrame | None = None) -> AuditRun:
    """One report of one organization, under ``<out_root>/<report_id>``."""
    report_id = report_id or str(uuid.uuid4())          # made once, on the driver
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    root = f"{out_root.rstrip('/')}/{report_id}"
    folder, archives, attachments = _write(spark, a, organization_id, ids, root, objects_root, contents)
    asked = ids if "position" in ids.columns else ids.withColumn("position", F.col("submission_id"))
    asked = asked.select(F.lit(organization_id).alias("organization_id"), F.lit(report_name).alias("report_name"), "position", "submission_id")
    summary = _conclude(spark, a, organization_id, asked, ids, root, status_log_dir, run_ts, report_id)
    return AuditRun(report_id, folder, archives, summary, attachments)


def run_audit_reports(spark: SparkSession, a: AuditTables, requests: DataFrame, out_root: str, objects_root: str | None = None,
                      status_log_dir: str | None = None, run_ts: str | None = None, contents: DataFrame | None = None) -> AuditRun:
    """All reports that ``requests`` (organization_id, report_name, position, submission_id) ask for, of any organizations,
    by the jobs of one: the tables are read and joined once, and each report's files lie under
    ``<organization>/<report>/`` in ``<out_root>/<run id>/folder`` and ``by_submission``."""
    run_id = str(uuid.uuid4())
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    root = f"{out_root.rstrip('/')}/{run_id}"
    asked = at_rest(requests.select(*exports.REPORT, "position", "submission_id"), f"{root}/requests")
    folder, archives, attachments = _write(spark, a, None, asked, root, objects_root, contents)
    summary = _conclude(spark, a, None, asked, asked, root, status_log_dir, run_ts, None)
    return AuditRun(run_id, folder, archives, summary, attachments)


__all__ = ["run_audit_report", "run_audit_reports", "status_events", "AuditRun"]
