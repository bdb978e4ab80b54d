"""Several reports in one run: the same rows and files as report by report, one pass over the answers."""

import os
import zipfile

from pyspark.sql import functions as F

from quire.operators import exports, progress, status
from quire.plans import registry
from quire.plans.audit import run_audit_reports
from quire.sources import requests, tables, views

from .conftest import SF_SMALL

REQUESTS = [("1", "A", [3, 4, 5, 6, 7, 5, 9999999]), ("1", "B/b", [5, 6, 7, 8]), ("2", "A", list(range(0, 40))), ("0", "empty", [9999999])]


def _asked(spark):
    rows = [(o, r, n, i) for o, r, ids in REQUESTS for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, "organization_id string, report_name string, position int, submission_id long")


def _rows(df, columns):
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


def test_sections_of_several_reports_are_those_of_each(spark):
    a = views.audit_tables(tables.load(spark, SF_SMALL))
    asked = _asked(spark)
    got = exports.sections(spark, a, None, asked)
    want = {name: [] for name in got}
    columns = {}
    for org, report, ids in REQUESTS:
        one = exports.sections(spark, a, org, spark.createDataFrame([(i,) for i in set(ids)], "submission_id long"))
        for name, df in one.items():
            columns[name] = df.columns
            want[name] += [(org, report, *r) for r in _rows(df, df.columns)]
    for name, df in got.items():
        assert df.columns == [*exports.REPORT, *columns[name]], name
        assert _rows(df, df.columns) == sorted(want[name]), name
    assert len(want["forms"]) > 20 and len(want["chronology"]) > 0
    has_forms, has_files = exports.submissions_with_rows(a, None, asked)
    key = [*exports.REPORT, "submission_id"]
    assert _rows(has_forms.distinct(), key) == _rows(got["forms"].select(*key).distinct(), key)
    assert _rows(has_files.distinct(), key) == _rows(got["files"].select(*key).distinct(), key)


def test_request_ids_reach_the_scan_as_a_bloom_filter(spark):
    """One join for all reports; Spark filters the answers by a Bloom filter of the ids before it shuffles them."""
    conf = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        t = tables.load(spark, SF_SMALL)
        asked = registry._customer_requests(t)
        plan = exports.scope(views.answers(t), None, asked)._jdf.queryExecution().optimizedPlan().toString()
        semi = plan.splitlines()[2:]
        assert "LeftSemi" in semi[0] and "Project [l_orderkey" in semi[1]
        # the scan's own filter: below every shuffle, of the requests' ids
        assert "Filter" in semi[2] and "might_contain" in semi[2] and "l_orderkey" in semi[2] and "bloom_filter_agg(xxhash64(_req_id" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_progress_of_several_reports(spark):
    got = progress.batch_progress(_asked(spark).repartition(3)).collect()
    for org, report, ids in REQUESTS:
        mine = sorted((r for r in got if (r.organization_id, r.report_name) == (org, report)), key=lambda r: r.processed_total)
        assert [r.submission_id for r in mine] == ids and [r.processed_total for r in mine] == list(range(1, len(ids) + 1))
        assert {r.total_submissions for r in mine} == {len(ids)} and mine[-1].percent_processed == 100.0


def test_a_run_of_several_reports(spark, scratch):
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    docs = spark.createDataFrame([('{"organization_id": "%s", "report_name": "%s", "submission_ids": %s}' % (o, r, ids),) for o, r, ids in REQUESTS], "doc string")
    asked = requests.request_ids(requests.parse_requests(docs))
    log = f"{scratch}/log"
    run = run_audit_reports(spark, a, asked, f"{scratch}/out", status_log_dir=log, run_ts="2024-05-06 07:08:09", contents=views.file_contents(t))
    root = f"{scratch}/out/{run.report_id}"
    summary = {(r.organization_id, r.report_name): r for r in run.summary.collect()}
    assert {k: r.total_submissions for k, r in summary.items()} == {(o, r): len(ids) for o, r, ids in REQUESTS}
    assert summary["0", "empty"].submissions_with_forms == 0
    files = [r.file for r in run.folder.collect()]
    assert all(os.path.exists(f"{root}/folder/{f}") for f in files)
    assert {"/".join(f.split("/")[:2]) for f in files} == {"1/A", "1/B_b", "2/A", "0/empty"}
    with open(f"{root}/folder/{next(f for f in files if f.startswith('2/A') and 'form_data' in f)}") as f:
        assert f.readline().startswith("submission_id,form_type")          # the report is in the path, not in the lines
    archives = run.archives.collect()
    both = [r for r in archives if r.file.endswith("/Audit_5.zip") and r.file.startswith("1/")]
    assert {r.file for r in both} <= {"1/A/archives/Audit_5.zip", "1/B_b/archives/Audit_5.zip"}
    assert len({(r.rows, r.entries) for r in both}) <= 1                      # the same submission, asked for by two reports
    contents = {}
    for r in archives:
        z = zipfile.ZipFile(f"{root}/by_submission/{r.file}")
        assert z.testzip() is None and len(z.namelist()) == r.entries
        contents[r.file] = r.attachments
    sections = exports.sections(spark, a, None, asked)
    assert sum(contents.values()) == exports.attachments(sections["files"], views.file_contents(t)).count() > 0
    items = status.status_lookup(status.latest_status(spark.read.parquet(log))).collect()
    assert {(r.organization_id, r.report_name, r.status, r.processed_submissions, r.percent_complete) for r in items} == {
        (o, r, "completed", len(ids), 100.0) for o, r, ids in REQUESTS}
    assert all(r.link == r.s3_filename == r.download_key for r in items)


def test_registered_reports_cover_all_requests(spark):
    t = tables.load(spark, SF_SMALL)
    asked = registry._customer_requests(t)
    got = registry.queries()["reports_summary"](spark, SF_SMALL)
    assert got.agg(F.sum("total_submissions")).first()[0] == asked.count()
    assert got.count() == asked.select(*exports.REPORT).distinct().count() > 3
