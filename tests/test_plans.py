"""Physical-plan properties of the registered queries (what `.explain` shows)."""

import re

import pytest

from quire.plans.registry import queries

from .conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = _plan(queries()["scan_org_filter"](spark, SF_SMALL))
    scan = [l for l in p.splitlines() if "FileScan parquet" in l][0]
    read = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1)
    assert "l_quantity" not in read and "l_tax" not in read and "l_shipdate" not in read
    assert "PushedFilters: [IsNotNull(l_partkey)]" in scan


def test_top3_uses_window_group_limit(spark):
    df = queries()["category_rank_top3"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_daily_counts_without_expand(spark):
    p = _plan(queries()["daily_orders"](spark, SF_SMALL))
    assert "Expand" not in p


def test_forms_export_single_pass(spark):
    p = _plan(queries()["forms_export"](spark, SF_SMALL))
    assert "Union" not in p and "Generate" in p
    scans = len(re.findall(r"FileScan parquet \S*lineitem", p))
    assert scans <= 2   # answers + the option view, not once per UNION branch


def test_table_questions_filter_reaches_field_scan(spark):
    """Table-question rows come from the filtered join tree: no pointer-row
    generation, and the label filter is evaluated at the field (part) scan."""
    p = _plan(queries()["table_question_rows"](spark, SF_SMALL))
    assert "Generate" not in p
    part_scan = [l for l in p.splitlines() if "FileScan parquet" in l and "p_brand" in l][0]
    assert "DataFilters" in part_scan and "p_brand" in part_scan.split("DataFilters")[1]


def test_region_profile_aggregates_per_zip_before_geo_join(spark):
    """Customers are summed per zip (partial + final) before the geolocation
    join, so a hot zip collapses map-side."""
    lines = _plan(queries()["customer_region_profile"](spark, SF_SMALL)).splitlines()
    geo = [i for i, l in enumerate(lines) if "Join" in l and "geolocation_zip_code_prefix" in l][0]
    below = "\n".join(lines[geo:])
    assert re.search(r"HashAggregate\(keys=\[customer_zip_code_prefix#\d+\], functions=\[partial_count", below)


def test_coverage_by_semi_joins(spark):
    """Coverage flags come from semi-joins: no export joins, no distinct
    over the 11 form columns."""
    p = _plan(queries()["submission_coverage"](spark, SF_SMALL))
    assert "LeftSemi" in p
    assert "o_orderdate" not in p and "c_name" not in p   # contexts / users never read
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*folder_directory", p)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_udf_evaluation(spark, name):
    if name in ("attachment_fetch", "object_listing", "report_status_stream", "batch_progress"):
        pytest.skip("writes or checkpoints while being built; covered elsewhere")
    p = _plan(queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_or_nested_loop_join(spark, name):
    """Every join is an equi-join: no Cartesian product, no nested-loop join."""
    if name in ("attachment_fetch", "object_listing", "report_status_stream", "batch_progress"):
        pytest.skip("writes or checkpoints while being built; covered elsewhere")
    p = _plan(queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_request_reaches_every_fact_scan(spark):
    """A request of one id limits answers and contexts before they are joined."""
    from quire.operators import exports
    from quire.sources import tables, views

    a = views.audit_tables(tables.load(spark, SF_SMALL))
    ids = spark.createDataFrame([(3,)], "submission_id long")
    for export in (exports.forms_data, exports.review_stage_export):
        text = export(a, "1", ids)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("LeftSemi") == 2, text
