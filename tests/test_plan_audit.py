"""End-to-end audit run on sf0.001: files written equal the plans, the status
log folds to a completed item."""

import os
import zipfile

from pyspark.sql import functions as F

from quire.operators import exports, progress, status
from quire.plans.audit import run_audit_report
from quire.sources import objects, tables, views

from .conftest import SF_SMALL


def test_run_audit_report(spark, scratch):
    t = tables.load(spark, SF_SMALL)
    store = os.path.join(scratch, "objects")
    objects.put_objects(spark, objects.documents_as_objects(t.documents, F.col("lang") != "de"), store)
    ids = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 6, 7, 99999)], "submission_id long")
    log = os.path.join(scratch, "status")
    run = run_audit_report(spark, views.audit_tables(t), "1", "R", ids, os.path.join(scratch, "out"),
                           objects_root=store, status_log_dir=log, run_ts="2024-05-06 07:08:09",
                           report_id="rid")
    s = run.summary.first()
    assert (s.total_submissions, s.processed_submissions, s.status) == (9, 9, "completed")
    assert s.s3_filename == "AuditGrpR_05-06-2024_07_08_AM.zip"
    events = spark.read.parquet(log)
    assert events.where("op = 'percent'").count() == 9
    item = status.status_lookup(status.latest_status(events), "1", "rid").first()
    assert (item.response_status, item.download_key) == ("completed", s.s3_filename)
    latest = status.latest_status(events).first()
    assert (latest.processed_submissions, latest.percent_complete) == (9, 100.0)
    status.tombstone(spark, "1", "rid").write.mode("append").parquet(log)
    assert status.latest_status(spark.read.parquet(log)).count() == 0
    base = os.path.join(scratch, "out", "rid")
    for r in run.folder.collect():
        assert os.path.exists(os.path.join(base, "folder", r.file))
    att = run.attachments.where("status = 'ok'").count()
    in_zips = 0
    for r in run.archives.collect():
        names = zipfile.ZipFile(os.path.join(base, "by_submission", r.file)).namelist()
        assert "Audit_Folder/readme.csv" in names
        in_zips += sum(1 for n in names if not n.endswith(".csv"))
    distinct_att = run.attachments.where("status = 'ok'").select(
        "submission_id", F.coalesce("destination_path", "object_path")).distinct().count()
    assert att > 0 and in_zips == distinct_att
    # coverage written by the run (existence semi-joins) = coverage of the sections
    a = views.audit_tables(t)
    secs = exports.sections(spark, a, "1", ids)
    want = sorted(tuple(r) for r in progress.submission_coverage(ids, secs["forms"], secs["files"]).collect())
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(base, "coverage")).collect())
    assert got == want and any(r[1] for r in got) and not all(r[1] for r in got)
