"""Status fold, lookup, batch progress and the distributed row index."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators import progress, status


def log_of(spark, events):
    """Events (report, second, op, num, text, name of the put item); events of one second are in the order given."""
    rows = []
    for n, e in enumerate(events):
        report, second, op, num, text, name = (*e, None, None, None)[:6]
        item = ("_stamp", "who@example.com", name, 9, f"{name}.zip") if name else None
        rows.append(("o", report, dt.datetime(2024, 1, 1, 0, 0, second), n, op, num, text, item))
    return spark.createDataFrame(rows, status.LOG_SCHEMA)


def test_fold(spark):
    log = log_of(spark, [
        ("a", 1, "create", None, None, "A"), ("a", 2, "progress", 3.7), ("a", 3, "percent", 50.0),
        ("a", 4, "complete", None, "completed"), ("a", 4, "file", None, "a.zip"), ("a", 4, "link", None, "store/a.zip"),
        ("b", 1, "create", None, None, "B"), ("b", 2, "delete"),
        ("c", 1, "create", None, None, "C"), ("c", 2, "progress", 2.0), ("c", 3, "delete"), ("c", 4, "progress", 1.0),
        ("d", 1, "create", None, None, "D"), ("d", 2, "progress", 5.0), ("d", 3, "create", None, None, "D2"),
        ("e", 1, "create", None, None, "E"), ("e", 2, "complete", None, "incomplete"), ("e", 2, "file", None, ""),
    ])
    got = {r.report_id: r for r in status.latest_status(log).collect()}
    assert set(got) == {"a", "c", "d", "e"}
    a = got["a"]
    assert (a.report_name, a.status, a.processed_submissions, a.percent_complete, a.s3_filename, a.link) == \
        ("A", "completed", 3, 50.0, "a.zip", "store/a.zip")
    assert (a.created_at, a.created_by, a.is_deleted, a.total_submissions) == ("_stamp", "who@example.com", False, 9)
    c = got["c"]
    assert (c.report_name, c.status, c.processed_submissions, c.is_deleted, c.total_submissions) == (None, None, 1, None, None)
    d = got["d"]
    assert (d.report_name, d.status, d.processed_submissions, d.s3_filename) == ("D2", "processing", 0, "D2.zip")
    assert (got["e"].status, got["e"].s3_filename) == ("incomplete", "")
    look = {r.report_id: r for r in status.status_lookup(status.latest_status(log), "o").collect()}
    assert (look["a"].response_status, look["a"].download_key) == ("completed", "a.zip")
    for other in "cde":
        assert (look[other].response_status, look[other].download_key) == ("In-Progress", None)


def test_a_put_replaces_the_whole_item(spark):
    log = log_of(spark, [("a", 1, "create", None, None, "A"), ("a", 2, "progress", 7.0), ("a", 3, "percent", 100.0), ("a", 4, "complete", None, "completed"),
                         ("a", 4, "file", None, "A.zip"), ("a", 4, "link", None, "store/A.zip"), ("a", 5, "create", None, None, "A")])
    for parts in (1, 5):
        r = status.latest_status(log.repartition(parts)).first()
        assert (r.status, r.processed_submissions, r.percent_complete, r.link, r.s3_filename) == ("processing", 0, None, None, "A.zip")


def test_summary_counts_what_was_asked_and_what_was_visited(spark):
    asked = spark.createDataFrame([("o", "R", 0, 5), ("o", "R", 1, 5), ("o", "R", 2, 7), ("o", "S", 0, 5), ("o", "S", 1, 8), ("p", "R", 0, 1)],
                                  "organization_id string, report_name string, position long, submission_id long")
    coverage = spark.createDataFrame([(5, True, False), (7, False, False), (8, True, True)], "submission_id long, has_form_rows boolean, has_files boolean")
    visited = asked.where("not (report_name = 'S' and position = 1)")
    got = {(r.organization_id, r.report_name): r for r in progress.report_summary(asked, visited.unionAll(visited), coverage, run_ts="2024-01-31 17:05:00").collect()}
    whole, part = got["o", "R"], got["o", "S"]
    assert (whole.total_submissions, whole.processed_submissions, whole.status, whole.submissions_with_forms) == (3, 3, "completed", 1)
    assert whole.s3_filename == "AuditGrpR_01-31-2024_05_05_PM.zip"
    assert (part.total_submissions, part.processed_submissions, part.status, part.s3_filename, part.submissions_with_files) == (2, 1, "incomplete", "", 0)
    assert len({r.report_id for r in got.values()}) == 3


def test_batches_of_two(spark):
    ids = spark.createDataFrame(list(enumerate((50, 10, 40, 20, 50))), "position int, submission_id long")
    rows = progress.batch_progress(ids).orderBy("processed_total").collect()
    assert [r.submission_id for r in rows] == [50, 10, 40, 20, 50]        # the request's order, with its repeat
    assert [r.batch_index for r in rows] == [1, 1, 2, 2, 3]
    assert [r.batch_size for r in rows] == [2, 2, 2, 2, 1]
    assert [r.percent_processed for r in rows] == [20.0, 40.0, 60.0, 80.0, 100.0]
    assert [r.percent_of_batch for r in rows] == [50.0, 100.0, 50.0, 100.0, 100.0]


def test_row_index_matches_sort(spark):
    n = 5000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("k")).repartition(13)
    got = df.transform(lambda d: progress.with_row_index(d, ["k"], "i", total="t")).collect()
    assert sorted((r.k, r.i) for r in got) == [(k, k + 1) for k in range(n)]
    assert {r.t for r in got} == {n}


def test_delete_follows_a_run_in_any_time_zone(spark):
    from quire.plans.audit import status_events

    before = spark.conf.get("spark.sql.session.timeZone")
    now = dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    item = spark.createDataFrame([("o", "r", "R", "_stamp", None, 2, 2, "completed", "f.zip")],
                                 "organization_id string, report_id string, report_name string, created_at string, created_by string, "
                                 "total_submissions long, processed_submissions long, status string, s3_filename string")
    try:
        for zone in ("Asia/Tokyo", "America/Los_Angeles", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            log = status_events(item, now)
            assert status.latest_status(log).collect()[0].status == "completed"
            assert status.latest_status(log.unionByName(status.tombstone(spark, "o", "r"))).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
