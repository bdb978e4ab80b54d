"""Hot-key salting: a submission holding a third of all answers is spread
over several join partitions, and the result equals the unsalted join."""

from pyspark.sql import functions as F

from quire.operators import exports, skew
from quire.sources import tables, views
from quire.sources.views import AuditTables

from .conftest import SF_SMALL


def _skewed(spark):
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    ans = a.answers
    hot = (ans.where(F.col("submission_id") % 3 == 0)
           .withColumn("submission_id", F.lit(7).cast("bigint"))
           .withColumn("request_id", F.lit(7).cast("bigint"))
           .withColumn("response_id", F.lit(0).cast("bigint")))
    a2 = AuditTables(ans.where(F.col("submission_id") % 3 != 0).unionByName(hot), a.fields, a.options,
                     a.contexts, a.users, a.history, a.history_mail, a.files)
    return a2, views.all_submission_ids(t)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hot_submission_is_salted(spark):
    a, ids = _skewed(spark)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = _rows(exports.forms_export(a, "1", ids))
        spark.conf.set(key, "200")
        hot = skew.hot_keys(exports.scope(a.answers, "1"), ["request_id", "response_id", "submission_id"])
        assert hot is not None
        h = {r.submission_id: r._salts for r in hot.collect()}
        assert h[7] > 1
        salted = exports.forms_export(a, "1", ids)
        assert _rows(salted) == plain
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        # partition ids taken before the filter (a non-deterministic column
        # keeps the filter above the join)
        parts = (exports.forms_data(a, "1", ids).withColumn("p", F.spark_partition_id())
                 .where("submission_id = 7").select("p").distinct().count())
        assert parts > 1
    finally:
        for k in (key, "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold",
                  "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)


def test_salted_join_left_semantics(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "rk long, w string")
    hot = skew.hot_keys(left, ["k"], min_rows=10)
    assert {r.k: r._salts for r in hot.collect()} == {1: 5}
    got = _rows(skew.salted_join(left, right, [("k", "rk")], "left", hot))
    want = _rows(left.join(right, left.k == right.rk, "left"))
    assert got == want and len(got) == 52


def test_hot_customer_daily_report(spark):
    from quire.operators import commerce
    from quire.sources.views import CommerceTables

    c = views.commerce_tables(tables.load(spark, SF_SMALL))
    orders = c.orders.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(5).cast("bigint"))
                                 .otherwise(F.col("customer_id")))
    c2 = CommerceTables(orders, c.payments, c.customers, c.items, c.products, c.translation, c.geolocation)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = _rows(commerce.daily_category_report(c2))
        spark.conf.set(key, "100")
        assert skew.hot_keys(c2.orders, ["customer_id"]) is not None
        assert _rows(commerce.daily_category_report(c2)) == plain
    finally:
        spark.conf.unset(key)


def test_hot_keys_many_matches_single(spark):
    df = spark.createDataFrame([(i % 2, i % 5, "x" if i % 7 else "y") for i in range(700)],
                               "a long, b long, c string")
    sets = [["a"], ["a", "b"], ["c"], ["b", "c"]]
    many = skew.hot_keys_many(df, sets, min_rows=60)
    for ks in sets:
        one = skew.hot_keys(df, ks, min_rows=60)
        got = many[tuple(ks)]
        assert (one is None) == (got is None)
        if one is not None:
            assert _rows(one) == _rows(got)


def test_salted_semi_join_keeps_each_row_once(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "rk long, w string")
    hot = skew.hot_keys(left, ["k"], min_rows=10)
    got = _rows(skew.salted_join(left, right, [("k", "rk")], "left_semi", hot))
    want = _rows(left.join(right, left.k == right.rk, "left_semi"))
    assert got == want and len(got) == 51


def test_coverage_by_existence_matches_exports(spark):
    """``submissions_with_rows`` (two semi-joins) finds exactly the
    submissions of the form rows and of the file manifest, hot keys salted."""
    from quire.operators import progress

    a, ids = _skewed(spark)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "200")
        forms = exports.form_rows(exports.forms_export(a, "1", ids))
        files = exports.files_manifest(a, "1", ids)
        want = _rows(progress.submission_coverage(ids, forms, files))
        with_forms, with_files = exports.submissions_with_rows(a, "1", ids)
        got = _rows(progress.submission_coverage(ids, with_forms, with_files))
        assert got == want
        assert any(r[2] for r in got) and not all(r[1] for r in got)
    finally:
        spark.conf.unset(key)


def test_hot_zip_region_profile_matches_join_first(spark):
    """A zip prefix holding a third of the customers: aggregating per zip
    before the geolocation join gives the join-then-aggregate result."""
    from quire.operators import commerce
    from quire.sources.views import CommerceTables

    c = views.commerce_tables(tables.load(spark, SF_SMALL))
    cust = c.customers.withColumn(
        "customer_zip_code_prefix",
        F.when(F.col("customer_id") % 3 == 0, F.lit(5).cast("bigint")).otherwise(F.col("customer_zip_code_prefix")))
    c2 = CommerceTables(c.orders, c.payments, cust, c.items, c.products, c.translation, c.geolocation)
    per_customer = (c2.orders.join(c2.payments.groupBy("order_id").agg(
                        F.sum(F.col("payment_value").cast("decimal(18,2)")).alias("p")), "order_id")
                    .groupBy("customer_id").agg(F.count("order_id").alias("n"), F.sum("p").alias("r")))
    g = c2.geolocation
    j = (cust.join(per_customer, "customer_id", "left")
         .join(g, F.col("customer_zip_code_prefix") == g.geolocation_zip_code_prefix, "left"))
    want = j.groupBy(F.col("geolocation_state").alias("customer_state"),
                     F.col("geolocation_city").alias("customer_city")).agg(
        F.count(F.lit(1)), F.count("n"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("decimal(28,2)"))
    assert _rows(commerce.customer_region_profile(c2)) == _rows(want)


def test_hot_field_is_salted(spark):
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    ans = a.answers.withColumn(
        "field_id", F.when(F.col("submission_id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("field_id"))
    ).withColumn(
        "organization_id", F.when(F.col("submission_id") % 3 == 0, F.lit("1")).otherwise(F.col("organization_id")))
    a2 = AuditTables(ans, a.fields, a.options, a.contexts, a.users, a.history, a.history_mail, a.files)
    ids = views.all_submission_ids(t)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = _rows(exports.forms_data(a2, "1", ids))
        spark.conf.set(key, "200")
        hot = skew.hot_keys(exports.scope(a2.answers, "1"), ["field_id"])
        assert hot is not None and {r.field_id for r in hot.collect()} == {1}
        assert _rows(exports.forms_data(a2, "1", ids)) == plain
    finally:
        spark.conf.unset(key)


def test_hot_option_and_product_salted_joins_match_plain(spark):
    from quire.operators import commerce
    from quire.sources.views import CommerceTables

    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    hot_row = F.col("submission_id") % 3 == 0
    ans = (a.answers.withColumn("field_id", F.when(hot_row, F.lit(1).cast("bigint")).otherwise(F.col("field_id")))
           .withColumn("sub_field_id", F.when(hot_row, F.lit("1")).otherwise(F.col("sub_field_id")))
           .withColumn("organization_id", F.when(hot_row, F.lit("1")).otherwise(F.col("organization_id"))))
    a2 = AuditTables(ans, a.fields, a.options, a.contexts, a.users, a.history, a.history_mail, a.files)
    c = views.commerce_tables(t)
    items = c.items.withColumn("product_id", F.when(F.col("order_id") % 3 == 0, F.lit(2).cast("bigint"))
                               .otherwise(F.col("product_id")))
    c2 = CommerceTables(c.orders, c.payments, c.customers, items, c.products, c.translation, c.geolocation)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = (_rows(exports.value_resolution(a2, "1")), _rows(commerce.missing_items_by_month(c2)))
        spark.conf.set(key, "100")
        assert skew.hot_keys(c2.items, ["product_id"]) is not None
        assert skew.hot_keys(exports.scope(a2.answers, "1"), ["field_id", "sub_field_id"]) is not None
        assert (_rows(exports.value_resolution(a2, "1")), _rows(commerce.missing_items_by_month(c2))) == plain
    finally:
        spark.conf.unset(key)


def test_hot_submission_request_semi_joins_salted(spark):
    """A submission holding a third of the history (and of the answers): the
    salted request-id semi-joins keep exactly the unsalted rows."""
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    hot_row = F.col("submission_history_id") % 3 == 0
    hist = (a.history.withColumn("submission_id", F.when(hot_row, F.lit(4).cast("bigint"))
                                 .otherwise(F.col("submission_id")))
            .withColumn("organization_id", F.when(hot_row, F.lit("1")).otherwise(F.col("organization_id"))))
    a2 = AuditTables(a.answers, a.fields, a.options, a.contexts, a.users, hist, a.history_mail, a.files)
    ids = views.all_submission_ids(t).union(spark.range(1).select(F.lit(4).cast("bigint").alias("submission_id")))
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = _rows(exports.chronology_export(a2, "1", ids))
        spark.conf.set(key, "50")
        assert skew.hot_keys(exports.scope(hist, "1"), ["submission_id"]) is not None
        got = _rows(exports.chronology_export(a2, "1", ids))
        assert got == plain and any(r[0] == 4 for r in got)
    finally:
        spark.conf.unset(key)


def test_hot_key_list_keeps_heaviest(spark, monkeypatch):
    """More hot keys than the list bound: the heaviest are kept (not none),
    and the salted join stays exact for all keys."""
    left = spark.createDataFrame([(1, i) for i in range(60)] + [(2, i) for i in range(30)] + [(3, 0)],
                                 "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "rk long, w string")
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 1)
    hot = skew.hot_keys(left, ["k"], min_rows=10)
    assert {r.k: r._salts for r in hot.collect()} == {1: 6}
    many = skew.hot_keys_many(left, [["k"]], min_rows=10)[("k",)]
    assert {r.k: r._salts for r in many.collect()} == {1: 6}
    got = _rows(skew.salted_join(left, right, [("k", "rk")], "inner", hot))
    assert got == _rows(left.join(right, left.k == right.rk)) and len(got) == 91


def test_hot_creator_contexts_salted(spark):
    """One user created a third of the response contexts: the salted
    contexts ⟕ users joins give the unsalted rows (forms and review stage)."""
    t = tables.load(spark, SF_SMALL)
    a = views.audit_tables(t)
    ctx = a.contexts.withColumn("created_by", F.when(F.col("submission_id") % 3 == 0, F.lit(1).cast("bigint"))
                                .otherwise(F.col("created_by")))
    a2 = AuditTables(a.answers, a.fields, a.options, ctx, a.users, a.history, a.history_mail, a.files)
    ids = views.all_submission_ids(t)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = (_rows(exports.forms_data(a2, "1", ids)), _rows(exports.review_stage_export(a2, "1", ids)))
        spark.conf.set(key, "30")
        assert skew.hot_keys(ctx, ["created_by"]) is not None
        got = (_rows(exports.forms_data(a2, "1", ids)), _rows(exports.review_stage_export(a2, "1", ids)))
        assert got == plain and len(got[1]) > 0
    finally:
        spark.conf.unset(key)


def test_hot_order_category_revenue_salted(spark):
    """One order holds a third of the items: the salted items ⋈ orders join
    gives the unsalted category revenue."""
    from quire.operators import commerce
    from quire.sources.views import CommerceTables

    c = views.commerce_tables(tables.load(spark, SF_SMALL))
    first = c.orders.agg(F.min("order_id")).first()[0]
    items = c.items.withColumn("order_id", F.when(F.col("product_id") % 3 == 0, F.lit(first).cast("bigint"))
                               .otherwise(F.col("order_id")))
    c2 = CommerceTables(c.orders, c.payments, c.customers, items, c.products, c.translation, c.geolocation)
    key = skew.HOT_KEY_ROWS_CONF
    try:
        spark.conf.set(key, "0")
        plain = _rows(commerce.category_revenue(c2))
        spark.conf.set(key, "100")
        assert skew.hot_keys(items, ["order_id"]) is not None
        assert _rows(commerce.category_revenue(c2)) == plain
    finally:
        spark.conf.unset(key)


def test_sampled_detection_finds_hot_key(spark):
    """Large threshold: detection counts a 1% sample; the 30,000-row key is
    found, a 1,000-row key is not, and the salted join stays exact."""
    df = spark.range(40_000).select(
        F.when(F.col("id") < 30_000, F.lit(1)).when(F.col("id") < 31_000, F.lit(2))
        .otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("v"))
    hot = skew.hot_keys(df, ["k"], min_rows=10_000)
    got = {r.k: r._salts for r in hot.collect()}
    assert set(got) == {1} and 2 <= got[1] <= 4
    many = skew.hot_keys_many(df, [["k"]], min_rows=10_000)[("k",)]
    assert {r.k for r in many.collect()} == {1}
    exact = skew.hot_keys(df, ["k"], min_rows=10_000, exact=True)
    assert {r.k: r._salts for r in exact.collect()} == {1: 3}
    right = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "rk long, w string")
    salted = skew.salted_join(df, right, [("k", "rk")], "inner", hot)
    assert salted.count() == df.join(right, df.k == right.rk).count() == 31_000


def test_null_keys_are_spread_over_salts(spark):
    left = spark.createDataFrame([(None, i) for i in range(200)] + [(7, i) for i in range(100)] + [(8, 0)], "k int, v int")
    right = spark.createDataFrame([(7, "a"), (8, "b")], "rk int, w string")
    hot = skew.hot_keys(left, ["k"], 20)
    assert {r.k: r._salts for r in hot.collect()} == {None: 10, 7: 5}
    got = skew.salted_join(left, right, [("k", "rk")], "left", hot)
    assert _rows(got) == _rows(left.join(right, left["k"] == right["rk"], "left"))
    assert "_salt" in got._jdf.queryExecution().analyzed().toString()


def test_each_key_set_has_its_own_limit(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5, 1) for i in range(200)], "a int, b int")
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 5)
    many = skew.hot_keys_many(df, [["a"], ["b"]], 10)
    assert many[("a",)].count() == 5 and many[("b",)].count() == 1
