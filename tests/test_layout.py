"""Stored model tables: partition filters, joins without exchanges, and the same rows as the views."""

import re

import pytest
from pyspark.sql import functions as F

from quire.operators import exports, skew
from quire.plans import registry
from quire.sources import layout, tables, views

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("model"))
    a = views.audit_tables(tables.load(spark, SF_SMALL))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    yield a, layout.write_model(spark, a, folder, buckets=4), folder
    layout.drop_model(spark, folder)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_hold_the_model(spark, stored):
    a, model, folder = stored
    for name in layout.LAYOUT:
        was, now = getattr(a, name), getattr(model, name)
        assert sorted(now.columns) == sorted(was.columns)
        rows = [sorted(map(str, df.select(*sorted(was.columns)).collect())) for df in (was, now)]
        assert rows[0] == rows[1], name
    layout.drop_model(spark, folder)                             # another session: the catalog knows nothing
    again = layout.read_model(spark, folder)
    assert again.answers.count() == a.answers.count() and again.answers.where("organization_id = '1'").count() > 0


def test_organization_is_a_partition_filter(stored):
    plan = _plan(exports.scope(stored[1].answers, "1"))
    assert re.search(r"PartitionFilters: \[isnotnull\(organization_id#\d+\), \(organization_id#\d+ = 1\)\]", plan), plan


def test_requests_and_contexts_meet_without_an_exchange(spark, stored):
    model = stored[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ids = model.contexts.select("submission_id").distinct()
    keys = ["request_id", "response_id", "submission_id"]
    ctx = model.contexts.select(*[F.col(k).alias("ctx_" + k) for k in keys], "completed_at")
    j = skew.salted_join(exports.scope(model.answers, "1", ids), ctx, [(k, "ctx_" + k) for k in keys], "left", None)
    plan = _plan(j)
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan, plan
    plain = exports.scope(stored[0].answers, "1", ids)
    assert "Exchange" in _plan(plain)


def test_requests_prune_partitions_at_run_time(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    asked = registry._customer_requests(tables.load(spark, SF_SMALL))
    plan = exports.scope(stored[1].answers, None, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan


def test_exports_of_stored_tables_equal_those_of_views(spark, stored):
    a, model, _ = stored
    ids = views.all_submission_ids(tables.load(spark, SF_SMALL))
    for make in (exports.forms_export, exports.review_stage_export, exports.files_manifest):
        was, now = make(a, "1", ids), make(model, "1", ids)
        assert sorted(map(str, was.collect())) == sorted(map(str, now.collect())), make.__name__
