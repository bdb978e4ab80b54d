"""Daily report semantics on literal tables: ties, untranslated categories,
order, money rounding."""

import datetime as dt
from decimal import Decimal

from quire.operators import commerce
from quire.sources.views import CommerceTables

D1, D2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 11)


def _c(spark):
    orders = spark.createDataFrame([(1, 10, D1), (2, 11, D1), (3, 10, D2), (4, 12, D2)],
                                   "order_id long, customer_id long, order_purchase_timestamp timestamp_ntz")
    payments = spark.createDataFrame([(1, 10.005), (2, 20.0), (3, 1.0), (3, 2.0)],
                                     "order_id long, payment_value double")
    customers = spark.createDataFrame([(10, 1), (11, 1)], "customer_id long, customer_zip_code_prefix long")
    items = spark.createDataFrame(
        [(1, 1, 100, 5.0, D1), (1, 2, 101, 2.5, D1), (2, 1, 102, 5.0, D1), (2, 1, 103, 1.0, D1),
         (3, 1, 104, 1.0, D2)],
        "order_id long, order_item_id int, product_id long, price double, shipping_date timestamp_ntz")
    products = spark.createDataFrame([(100, "toys"), (101, "art"), (102, "bed"), (103, "xx"), (104, "xx")],
                                     "product_id long, product_category_name string")
    translation = spark.createDataFrame([("toys",), ("art",), ("bed",)], "product_category_name string")
    geo = spark.createDataFrame([(1, "c", "s")], "geolocation_zip_code_prefix long, geolocation_city string, "
                                                 "geolocation_state string")
    return CommerceTables(orders, payments, customers, items, products, translation, geo)


def test_daily_category_report(spark):
    rows = commerce.daily_category_report(_c(spark)).collect()
    assert [r.order_purchase_date for r in rows] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)]
    d1 = rows[1]
    assert d1.orders_count == 2 and d1.customers_making_orders_count == 2
    assert d1.revenue_usd == 30.01             # 10.005 -> 10.01 (cast before sum)
    assert d1.average_revenue_per_order_usd == Decimal("15.01")   # 15.005 half-up
    # toys 5, art 5 (2.5*2), bed 5, null 1: tie broken by name
    assert d1.top_3_product_categories_by_revenue == "art, bed, toys"
    assert d1.top_3_product_categories_revenue_percentage == "16.66, 16.66, 16.66"
    d2 = rows[0]
    # order 4 has no customer row and no payment; the only category is untranslated
    assert d2.orders_count == 1 and d2.top_3_product_categories_by_revenue is None
    assert d2.top_3_product_categories_revenue_percentage == "33.33"


def test_missing_items_by_month(spark):
    r = commerce.missing_items_by_month(_c(spark)).collect()
    assert len(r) == 1
    assert (r[0].orders_count, r[0].orders_without_items, r[0].items_count, r[0].items_without_category) == \
        (4, 1, 5, 2)


def test_monthly_rolling_window(spark):
    import pyspark.sql.functions as F
    c = _c(spark)
    more = spark.createDataFrame([(5, 10, dt.datetime(2024, 2, 3)), (6, 10, dt.datetime(2024, 3, 3)),
                                  (7, 11, dt.datetime(2024, 4, 3))],
                                 "order_id long, customer_id long, order_purchase_timestamp timestamp_ntz")
    pays = spark.createDataFrame([(5, 4.0), (6, 8.0), (7, 16.0)], "order_id long, payment_value double")
    c2 = CommerceTables(c.orders.unionByName(more), c.payments.unionByName(pays), c.customers, c.items,
                        c.products, c.translation, c.geolocation)
    rows = commerce.monthly_rolling(c2).orderBy("order_month").collect()
    rpo = [r.revenue_per_order_usd for r in rows]
    assert rpo == [Decimal("11.00"), Decimal("4.00"), Decimal("8.00"), Decimal("16.00")]
    assert [r.rolling_revenue_per_order_usd for r in rows] == [
        Decimal("11.0000"), Decimal("7.5000"), Decimal("7.6667"), Decimal("9.3333")]
    assert rows[0].rolling_customers_count == 2.0
    assert F is not None
