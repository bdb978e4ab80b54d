"""Named queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the whole base tables of ``sf_dir`` (through the model views
of ``quire.sources.views``) and returns a DataFrame.  Most are lazy, but for one
job that finds hot keys (a bounded list); the two sinks (``csv_fanout``,
``submission_archives``) write their files and return the committed manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.scalars import csv_path, multi_replace, submission_id_from_path
from ..operators import commerce, exports, progress, sink, skew, status
from ..session import drop_scratch, scratch_dir
from ..sources import requests, tables, views
from ..streaming import status_stream

# Parameters of the registered audit report (over every submission of one
# organization).
ORG = "1"
RUN_TS = "2024-01-31 17:05:00"

# Literal substitution applied to document texts: overlapping keys (first
# listed wins at a position) and a replacement that contains another key
# (never rescanned).
SUBSTITUTIONS = [("the", "THE"), ("th", "TH"), ("he", "she"), ("and", "&"), (". ", ".|")]

Query = Callable[[SparkSession, str], DataFrame]


def _commerce(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(views.commerce_tables(tables.load(spark, sf_dir)))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _category_rank_top3(c):
    return commerce.category_rank(commerce.category_revenue(c), 3)


def _audit(fn):
    """Audit query over org ``ORG`` and a request covering every submission."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables.load(spark, sf_dir)
        return fn(spark, t, views.audit_tables(t), ORG, views.all_submission_ids(t))
    run.__name__ = fn.__name__
    return run


def _customer_requests(t):
    """Reports that customers ask for, one of each nation: (organization_id, report_name, position, submission_id)."""
    ids = requests.request_ids(requests.parse_requests(requests.requests_from_customers(t.customer)))
    return requests.at_rest(ids, scratch_dir(t.spark, "requests"))


@_audit
def scan_org_filter(spark, t, a, org, ids):
    return exports.scope(a.answers, org)


@_audit
def request_ids_semi(spark, t, a, org, ids):
    """Answers that some customer's request names: documents of one id or of several, some of which no submission has."""
    req = _customer_requests(t)
    keys = ["organization_id", "submission_id"]
    req = req.select(*[F.col(k).alias("req_" + k) for k in keys])
    return skew.salted_join(a.answers, req, [(k, "req_" + k) for k in keys], "left_semi",
                            skew.hot_keys(a.answers, keys))


@_audit
def value_resolve(spark, t, a, org, ids):
    return exports.value_resolution(a, org)


@_audit
def forms_base(spark, t, a, org, ids):
    return exports.forms_data(a, org, ids)


@_audit
def forms_path(spark, t, a, org, ids):
    return exports.with_form_path(exports.forms_data(a, org, ids))


@_audit
def forms_export(spark, t, a, org, ids):
    return exports.forms_export(a, org, ids)


@_audit
def form_rows_split(spark, t, a, org, ids):
    return exports.form_rows(exports.forms_export(a, org, ids))


@_audit
def table_question_rows(spark, t, a, org, ids):
    return exports.table_questions_from(exports.forms_data(a, org, ids))


@_audit
def table_question_explode(spark, t, a, org, ids):
    return exports.table_question_items(exports.table_questions_from(exports.forms_data(a, org, ids)))


@_audit
def review_stage_export(spark, t, a, org, ids):
    return exports.review_stage_export(a, org, ids)


@_audit
def chronology_export(spark, t, a, org, ids):
    return exports.chronology_export(a, org, ids)


@_audit
def files_manifest(spark, t, a, org, ids):
    return exports.files_manifest(a, org, ids)


@_audit
def csv_path_query(spark, t, a, org, ids):
    fm = exports.files_manifest(a, org, ids)
    return fm.select("submission_id", "file_id", "folder_directory",
                     csv_path("folder_directory").alias("csv_path"))


@_audit
def submission_id_from_path_query(spark, t, a, org, ids):
    fp = exports.export_paths(exports.forms_data(a, org, ids, with_options=False))
    return fp.select("folder_directory", submission_id_from_path("folder_directory").alias("submission_id"))


def dictionary_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.load(spark, sf_dir).documents
    return d.select("doc_id", multi_replace("text", SUBSTITUTIONS).alias("text"))


def _status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status_log(tables.load(spark, sf_dir))


def report_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.latest_status(_status_log(spark, sf_dir))


def report_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status fold run as a Structured Streaming job over the log files."""
    return status_stream.fold_log_stream(spark, _status_log(spark, sf_dir), scratch_dir(spark, "status"))


def report_status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.status_lookup(report_status_latest(spark, sf_dir), organization_id=ORG)


@_audit
def batch_progress(spark, t, a, org, ids):
    """A request in order of date (not of id) that asks for every tenth id again at its end."""
    asked = t.orders.select(F.col("o_orderkey").alias("submission_id"), F.col("o_orderdate").alias("asked"),
                            F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("turn"))
    return progress.batch_progress(asked, order_by=("turn", "asked", "submission_id"))


def _coverage(a, org, ids):
    with_forms, with_files = exports.submissions_with_rows(a, org, ids)
    return progress.submission_coverage(ids, with_forms, with_files)


@_audit
def submission_coverage(spark, t, a, org, ids):
    return _coverage(a, org, ids)


@_audit
def report_summary(spark, t, a, org, ids):
    """One report for each order priority, asking for every tenth id twice; the runs of the urgent ones came to all of their
    ids, the others stopped short of pending orders."""
    turns = F.when(F.col("o_orderkey") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    asked = t.orders.select(F.lit(org).alias("organization_id"), F.col("o_orderpriority").alias("report_name"), F.col("o_orderkey").alias("submission_id"),
                            F.explode(turns).alias("turn"), F.col("o_orderstatus").alias("state"))
    asked = asked.withColumn("position", F.col("submission_id") * 2 + F.col("turn"))
    visited = asked.where((F.col("state") != "P") | F.col("report_name").isin("1-URGENT", "2-HIGH"))
    return progress.report_summary(asked, visited, _coverage(a, org, ids), run_ts=RUN_TS)


def reports_forms_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of all reports that customers ask for, of three organizations, in one pass over the answers."""
    t = tables.load(spark, sf_dir)
    return exports.forms_export(views.audit_tables(t), None, _customer_requests(t))


def reports_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status items of these reports, when all their ids have been visited."""
    t = tables.load(spark, sf_dir)
    asked = _customer_requests(t)
    coverage = progress.submission_coverage(asked, *exports.submissions_with_rows(views.audit_tables(t), None, asked))
    visits = progress.batch_progress(asked, order_by=("submission_id", "position")).select(
        *exports.REPORT, F.col("processed_total").alias("position"), "submission_id")
    return progress.report_summary(visits, visits, coverage, run_ts=RUN_TS)


def _sections(spark, a, org, ids):
    """The report's sections, and the folder that they read: it is of no use once they are written."""
    folder = scratch_dir(spark, "sections")
    return exports.sections(spark, a, org, ids, materialize_dir=folder), folder


@_audit
def csv_fanout(spark, t, a, org, ids):
    """The committed manifest of a real write: one CSV per destination path."""
    sections, folder = _sections(spark, a, org, ids)
    m = sink.write_csv_files(spark, sections, scratch_dir(spark, "csv"))
    drop_scratch(spark, folder)
    return m.select("section", F.col("file").alias("csv_path"), "rows")


@_audit
def submission_archives(spark, t, a, org, ids):
    """The committed manifest of a real write: one archive per submission, with the readme and the files its answers name."""
    sections, folder = _sections(spark, a, org, ids)
    m = sink.write_archives(spark, sections, scratch_dir(spark, "zip"), readme=("Audit_Folder/readme.csv", exports.README_TEXT),
                            attachments=exports.attachments(sections["files"], views.file_contents(t), materialize_dir=folder))
    drop_scratch(spark, folder)
    return m.select(F.regexp_extract("file", r"Audit_(\d+)\.zip$", 1).cast("bigint").alias("submission_id"), "entries", "rows",
                    "attachments", "attached_bytes")


@_audit
def attachment_fetch(spark, t, a, org, ids):
    """Every answer's file: where it is and how long, or that there is none."""
    refs = exports.file_references(a, org, ids)
    sizes = views.file_contents(t).select(F.col("file_id").cast("string").alias("_id"), F.octet_length("content").cast("bigint").alias("length"))
    hot = exports.answer_hot_keys(a, org, [["sub_field_id"]])[("sub_field_id",)]
    j = skew.salted_join(refs, sizes, [("sub_field_id", "_id")], "left", hot)
    return j.select("submission_id", "sub_field_id", "file_id", "bucket_name", "storage_key", "destination_path", "status", "length")


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object's place and size, from the metadata of the files and their contents."""
    t = tables.load(spark, sf_dir)
    sizes = views.file_contents(t).select("file_id", F.octet_length("content").cast("bigint").alias("length"))
    return views.files(t).join(sizes, F.col("id") == F.col("file_id")).select("bucket_name", "storage_key", "length")


QUERIES: dict[str, Query] = {
    "scan_org_filter": scan_org_filter,
    "request_ids_semi": request_ids_semi,
    "value_resolve": value_resolve,
    "forms_base": forms_base,
    "forms_path": forms_path,
    "forms_export": forms_export,
    "form_rows_split": form_rows_split,
    "table_question_rows": table_question_rows,
    "table_question_explode": table_question_explode,
    "review_stage_export": review_stage_export,
    "chronology_export": chronology_export,
    "files_manifest": files_manifest,
    "csv_path": csv_path_query,
    "submission_id_from_path": submission_id_from_path_query,
    "daily_orders": _commerce(commerce.daily_orders),
    "category_revenue": _commerce(commerce.category_revenue),
    "category_rank_top3": _commerce(_category_rank_top3),
    "daily_category_report": _commerce(commerce.daily_category_report),
    "monthly_rolling": _commerce(commerce.monthly_rolling),
    "missing_items_by_month": _commerce(commerce.missing_items_by_month),
    "customer_region_profile": _commerce(commerce.customer_region_profile),
    "delivery_lag": _commerce(commerce.delivery_lag),
    "delivery_estimate": _commerce(commerce.delivery_estimate),
    "dictionary_substitute": dictionary_substitute,
    "report_status_latest": report_status_latest,
    "report_status_lookup": report_status_lookup,
    "report_status_stream": report_status_stream,
    "batch_progress": batch_progress,
    "submission_coverage": submission_coverage,
    "report_summary": report_summary,
    "reports_forms_export": reports_forms_export,
    "reports_summary": reports_summary,
    "csv_fanout": csv_fanout,
    "submission_archives": submission_archives,
    "attachment_fetch": attachment_fetch,
    "object_listing": object_listing,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
