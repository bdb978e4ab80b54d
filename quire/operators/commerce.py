"""Daily and monthly commerce reports.

Semantics follow the daily e-commerce report: per-day order / customer counts
and revenue, per-day-per-category revenue ranked top-3, string-aggregated into
one row per day; plus the described extras (3-month rolling averages, a
missing-item / missing-category audit, a geographic profile, delivery lag).

Scale notes (the fact tables are payments and items, both order-line sized):

* Order-line facts are pre-aggregated per order *before* joining the order
  table (partial aggregation runs map-side, so the shuffle carries one row per
  order, not one per line).  This relies on the primary keys of the model:
  ``order_id`` is unique in orders, ``customer_id`` in customers,
  ``product_id`` in products, category names in the translation table.
* Dimension joins carry no broadcast hints: their sizes are not bounded by
  construction, so AQE decides from measured shuffle sizes (it turns a
  sort-merge join into a broadcast join when one side is small at runtime).
* Windows are partitioned by day (top-3: bounded by the number of categories)
  or run over one row per month (rolling average: bounded by the calendar).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.views import CommerceTables
from . import skew

MONEY = "decimal(18,2)"


def purchase_day(ts: Column | str) -> Column:
    """``DATE_TRUNC('day', ts)`` kept as a zone-less timestamp."""
    return F.to_date(ts).cast("timestamp_ntz")


def purchase_month(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "MM").cast("timestamp_ntz")


def _order_payments(payments: DataFrame) -> DataFrame:
    return (payments.groupBy("order_id")
            .agg(F.sum(F.col("payment_value").cast(MONEY)).alias("order_payments")))


def _paid_orders(c: CommerceTables) -> DataFrame:
    """orders ⋈ payments ⋈ customers at one row per order (payments summed).

    The customer join comes last and is an inner join on the customer key
    (unique in customers), not a semi-join: Catalyst pushes a semi-join below
    the payments join, after which the (period, customer) aggregation must
    shuffle again; the inner join keeps the output partitioned by
    ``customer_id`` and the aggregation reuses that partitioning.  A customer
    holding a large share of the orders is salted (``skew.salted_join``).
    """
    paid = c.orders.join(_order_payments(c.payments), "order_id")
    cust = c.customers.select(F.col("customer_id").alias("c_customer_id"))
    hot = skew.hot_keys(c.orders, ["customer_id"])
    return skew.salted_join(paid, cust, [("customer_id", "c_customer_id")], "inner", hot).drop("c_customer_id")


def _per_customer_period(c: CommerceTables, period: Column, name: str) -> DataFrame:
    """(period, customer_id) -> orders, revenue: the exact inputs of
    COUNT(DISTINCT order), COUNT(DISTINCT customer) and SUM per period."""
    per_order = (_paid_orders(c).groupBy(period.alias(name), "customer_id", "order_id")
                 .agg(F.sum("order_payments").alias("order_payments")))       # a repeated order row counts once
    return (per_order.groupBy(name, "customer_id")
            .agg(F.count("order_id").alias("n_orders"), F.sum("order_payments").alias("revenue")))


def daily_orders(c: CommerceTables) -> DataFrame:
    """Per purchase day: orders, distinct customers and revenue (CTE 1)."""
    per = _per_customer_period(c, purchase_day("order_purchase_timestamp"), "order_purchase_date")
    return (per.groupBy("order_purchase_date")
            .agg(F.sum("n_orders").alias("orders_count"),
                 F.count(F.lit(1)).alias("customers_making_orders_count"),
                 F.sum("revenue").alias("revenue_usd")))


def _product_categories(c: CommerceTables) -> DataFrame:
    """product_id -> translated category (null when the name has no translation)."""
    tr = c.translation.select(F.col("product_category_name").alias("category"))
    return (c.products.join(tr, c.products.product_category_name == tr.category, "left")
            .select("product_id", "category"))


def category_revenue(c: CommerceTables) -> DataFrame:
    """Per (purchase day, category): sum(price * order_item_id) (CTE 2)."""
    hot = skew.hot_keys_many(c.items, [["order_id"], ["product_id"]])     # one job for both keys
    orders = c.orders.select(F.col("order_id").alias("o_order_id"), "order_purchase_timestamp")
    lines = skew.salted_join(c.items, orders, [("order_id", "o_order_id")], "inner",
                             hot[("order_id",)]).drop("o_order_id")
    cats = _product_categories(c).withColumnRenamed("product_id", "p_product_id")
    return (skew.salted_join(lines, cats, [("product_id", "p_product_id")], "inner", hot[("product_id",)])
            .groupBy(purchase_day("order_purchase_timestamp").alias("order_purchase_date"),
                     F.col("category").alias("product_category_name"))
            .agg(F.sum(F.col("price").cast(MONEY) * F.col("order_item_id")).alias("category_revenue")))


def category_rank(cat_rev: DataFrame, top: int = 3) -> DataFrame:
    """Row number per day by category revenue, highest first (CTE 3), top-k kept.

    Ties are broken by category name (nulls last) so the result is
    deterministic; the filter on the row number becomes a WindowGroupLimit.
    """
    w = (Window.partitionBy("order_purchase_date")
         .orderBy(F.col("category_revenue").desc_nulls_first(),
                  F.col("product_category_name").asc_nulls_last()))
    return cat_rev.withColumn("row_num", F.row_number().over(w)).where(F.col("row_num") <= top)


def daily_category_report(c: CommerceTables) -> DataFrame:
    """One row per purchase day with top-3 categories and their revenue share."""
    od = daily_orders(c)
    top3 = category_rank(category_revenue(c), 3)
    j = od.join(top3, "order_purchase_date", "left")
    share = ("cast(cast(round(cast(category_revenue as decimal(18,2)) * 100 / "
             "cast(revenue_usd as decimal(18,2)), 2) as decimal(12,2)) as string)")
    out = (j.groupBy("order_purchase_date", "orders_count", "customers_making_orders_count", "revenue_usd")
           .agg(F.expr("string_agg(product_category_name, ', ') within group (order by row_num)")
                .alias("top_3_product_categories_by_revenue"),
                F.expr(f"string_agg({share}, ', ') within group (order by row_num)")
                .alias("top_3_product_categories_revenue_percentage")))
    avg = F.round(F.col("revenue_usd") / F.col("orders_count").cast("decimal(20,0)"), 2)
    return (out.select(
        "order_purchase_date", "orders_count", "customers_making_orders_count",
        F.round("revenue_usd", 2).cast("double").alias("revenue_usd"),
        avg.cast("decimal(10,2)").alias("average_revenue_per_order_usd"),
        "top_3_product_categories_by_revenue",
        "top_3_product_categories_revenue_percentage")
        .orderBy(F.col("order_purchase_date").desc()))


def monthly_rolling(c: CommerceTables) -> DataFrame:
    """Monthly revenue per order and customers, with 3-month rolling averages.

    The rolling window spans three calendar months (current + 2 preceding), also
    where a month has no orders.
    """
    per = _per_customer_period(c, purchase_month("order_purchase_timestamp"), "order_month")
    monthly = (per.groupBy("order_month")
               .agg(F.sum("n_orders").alias("orders_count"),
                    F.count(F.lit(1)).alias("customers_count"),
                    F.sum("revenue").alias("revenue_usd")))
    rpo = F.round(F.col("revenue_usd") / F.col("orders_count").cast("decimal(20,0)"), 2).cast(MONEY)
    w = Window.orderBy(F.year("order_month") * 12 + F.month("order_month")).rangeBetween(-2, 0)
    return (monthly.withColumn("revenue_per_order_usd", rpo)
            .select("order_month", "orders_count", "customers_count",
                    F.col("revenue_usd").cast("decimal(28,2)").alias("revenue_usd"),
                    "revenue_per_order_usd",
                    F.round(F.avg("revenue_per_order_usd").over(w), 4).cast("decimal(18,4)")
                    .alias("rolling_revenue_per_order_usd"),
                    F.round(F.avg("customers_count").over(w), 4).alias("rolling_customers_count")))


def missing_items_by_month(c: CommerceTables) -> DataFrame:
    """Per purchase month: orders without items, items without a category.

    Items are reduced to one row per order (count, count without category)
    before meeting the order table.
    """
    cats = _product_categories(c).withColumnRenamed("product_id", "p_product_id")
    hot = skew.hot_keys(c.items, ["product_id"])
    per_order = (skew.salted_join(c.items, cats, [("product_id", "p_product_id")], "left", hot)
                 .groupBy("order_id")
                 .agg(F.count(F.lit(1)).alias("n_items"),
                      F.count_if(F.col("category").isNull()).alias("n_uncategorised")))
    j = c.orders.join(per_order, "order_id", "left")
    return (j.groupBy(purchase_month("order_purchase_timestamp").alias("order_month"))
            .agg(F.count(F.lit(1)).alias("orders_count"),
                 F.count_if(F.col("n_items").isNull()).alias("orders_without_items"),
                 F.coalesce(F.sum("n_items"), F.lit(0)).cast("bigint").alias("items_count"),
                 F.coalesce(F.sum("n_uncategorised"), F.lit(0)).cast("bigint")
                 .alias("items_without_category")))


def customer_region_profile(c: CommerceTables) -> DataFrame:
    """Customers, buyers, orders and revenue per (state, city).

    Customers are summed per zip prefix *before* meeting the geolocation
    table: partial aggregation collapses a zip holding a large share of the
    customers map-side, and the geolocation join sees one row per zip on
    both sides, so no customer is counted twice."""
    per_customer = (_paid_orders(c).groupBy("customer_id", "order_id").agg(F.sum("order_payments").alias("order_payments"))
                    .groupBy("customer_id").agg(F.count("order_id").alias("n_orders"),
                         F.sum("order_payments").alias("revenue")))
    per_zip = (c.customers.join(per_customer, "customer_id", "left")
               .groupBy("customer_zip_code_prefix")
               .agg(F.count(F.lit(1)).alias("customers"),
                    F.count("n_orders").alias("buyers"),
                    F.sum("n_orders").alias("n_orders"),
                    F.sum("revenue").alias("revenue")))
    g = _places(c)
    j = per_zip.join(g, F.col("customer_zip_code_prefix") == g.geolocation_zip_code_prefix, "left")
    return (j.groupBy(F.col("geolocation_state").alias("customer_state"),
                      F.col("geolocation_city").alias("customer_city"))
            .agg(F.sum("customers").alias("customers_count"),
                 F.sum("buyers").alias("buying_customers_count"),
                 F.coalesce(F.sum("n_orders"), F.lit(0)).cast("bigint").alias("orders_count"),
                 F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(28,2)").alias("revenue_usd")))


def _places(c: CommerceTables) -> DataFrame:
    """One (state, city) for each zip prefix: a zip with several rows has the first by name."""
    place = F.struct("geolocation_state", "geolocation_city")
    return (c.geolocation.groupBy("geolocation_zip_code_prefix").agg(F.min(place).alias("p"))
            .select("geolocation_zip_code_prefix", "p.geolocation_state", "p.geolocation_city"))


def _lag_histogram(c: CommerceTables) -> DataFrame:
    """Orders by (customer_state, order_month, lag_days): days from purchase to the last shipped item.

    Orders are counted per (zip, month, lag) before the geolocation join, so what goes on has the size
    of the calendar, not of the orders."""
    shipped = c.items.groupBy("order_id").agg(F.max("shipping_date").alias("delivered_at"))
    lag = F.datediff(F.to_date("delivered_at"), F.to_date("order_purchase_timestamp"))
    delivered = c.orders.join(shipped, "order_id").select("customer_id", purchase_month("order_purchase_timestamp").alias("order_month"), lag.alias("lag_days"))
    cust = c.customers.select(F.col("customer_id").alias("c_customer_id"), "customer_zip_code_prefix")
    per_zip = (skew.salted_join(delivered, cust, [("customer_id", "c_customer_id")], "left", skew.hot_keys(c.orders, ["customer_id"]))
               .groupBy("customer_zip_code_prefix", "order_month", "lag_days").agg(F.count(F.lit(1)).alias("n")))
    g = _places(c)
    return (per_zip.join(g, F.col("customer_zip_code_prefix") == g.geolocation_zip_code_prefix, "left")
            .groupBy(F.col("geolocation_state").alias("customer_state"), "order_month", "lag_days").agg(F.sum("n").alias("n")))


def _estimated(c: CommerceTables) -> DataFrame:
    """The histogram with ``estimated_days``: the exact median of the state's earlier months, null in its first one.

    The median runs over counted lags (``percentile`` with a frequency), over a range of months that ends
    before the current one; its state has one entry per different lag."""
    earlier = (Window.partitionBy("customer_state").orderBy(F.year("order_month") * 12 + F.month("order_month"))
               .rangeBetween(Window.unboundedPreceding, -1))
    known = _lag_histogram(c).where("lag_days is not null")
    return known.withColumn("estimated_days", F.percentile("lag_days", 0.5, F.col("n")).over(earlier))


def _against_estimate() -> list[Column]:
    lag, est = F.col("lag_days"), F.col("estimated_days")
    return [F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint").alias(name)
            for test, name in ((lag < est, "early_orders"), (lag == est, "on_time_orders"), (lag > est, "late_orders"))]


def delivery_estimate(c: CommerceTables) -> DataFrame:
    """Per customer state and month: the delivery estimate (median days of the state's earlier months), and how many
    orders came earlier, on the day, or later."""
    return (_estimated(c).groupBy("customer_state", "order_month")
            .agg(F.sum("n").alias("delivered_orders"), F.max("estimated_days").alias("estimated_days"), *_against_estimate()))


def delivery_lag(c: CommerceTables) -> DataFrame:
    """Days from purchase to the last shipped item, summarised per month, and against the states' estimates."""
    days = F.sum(F.col("lag_days") * F.col("n")) / F.sum("n")
    return (_estimated(c).groupBy("order_month")
            .agg(F.sum("n").alias("delivered_orders"), F.round(days, 4).alias("avg_delivery_days"),
                 F.min("lag_days").alias("min_delivery_days"), F.max("lag_days").alias("max_delivery_days"), *_against_estimate()))
