"""Derived views: the audit and commerce data models over the test tables.

The operators in ``quire.operators`` are written against the data model of
the workloads they serve (answers, form fields, options, response contexts,
users, history, files; orders, payments, items, products, translations).
The driver's test data is a TPC-H-like star schema, so each model table is a
projection of one test table.  Every view is a narrow ``select`` (plus one
distinct for the option dimension), so Catalyst still prunes the parquet scan
to the columns a query touches and pushes filters below the projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import REPORT_STAMP_FORMAT
from ..operators.status import ITEM
from .tables import Tables


def _org(c: Column) -> Column:
    return (c % 3).cast("string")


# ---------------------------------------------------------------- audit model

@dataclass
class AuditTables:
    answers: DataFrame        # submitted values
    fields: DataFrame         # form definitions
    options: DataFrame        # choices of a field
    contexts: DataFrame       # who answered when
    users: DataFrame          # accounts
    history: DataFrame        # what happened when
    history_mail: DataFrame   # mails of the history
    files: DataFrame          # uploaded files


def answers(t: Tables) -> DataFrame:
    li = t.lineitem
    kind, amount = li.l_linenumber % 4, (li.l_suppkey % 50 + 1).cast("string")
    items = F.concat(F.lit('[{"cost":'), amount, F.lit(',"item":"'), li.l_returnflag, F.lit('"},{"cost":"'), amount,
                     F.lit('.25","item":"'), li.l_linestatus, F.lit('"},"loose"]'))
    value = (F.when(li.l_linenumber == 7, items)
             .when(li.l_linenumber == 6, F.lit("[]"))
             .when(kind == 0, F.concat(F.lit('{"value":"'), li.l_returnflag, F.lit('"}')))
             .when(kind == 1, li.l_linestatus)
             .when(kind == 2, F.lit('{"value"'))
             .otherwise(F.lit('{"item":"other","cost":1}')))
    return li.select(
        li.l_orderkey.alias("submission_id"),
        _org(li.l_partkey).alias("organization_id"),
        (li.l_orderkey % 10).alias("request_id"),
        (li.l_orderkey % 7).alias("response_id"),
        li.l_partkey.alias("field_id"),
        li.l_suppkey.cast("string").alias("sub_field_id"),
        (li.l_orderkey % 20).alias("form_id"),
        value.alias("value"),
    )


def fields(t: Tables) -> DataFrame:
    p = t.part
    return p.select(
        p.p_partkey.alias("field_id"),
        _org(p.p_partkey).alias("organization_id"),
        F.when(p.p_type == "SMALL", F.lit("review")).otherwise(F.lower(p.p_type)).alias("form_type"),
        p.p_name.alias("form_name"),
        F.lit("short_answer").alias("field_type"),
        F.when(p.p_brand == "Brand#1", F.lit("Table Question"))
         .when(p.p_brand == "Brand#2", F.lit(None).cast("string"))
         .otherwise(p.p_brand).alias("field_label"),
        p.p_size.alias("field_index"),
    )


def options(t: Tables) -> DataFrame:
    li, s = t.lineitem, t.supplier
    rich = s.where(s.s_acctbal > 5000).select("s_suppkey", "s_name")
    return (li.join(rich, li.l_suppkey == rich.s_suppkey)
            .select(li.l_partkey.alias("field_id"),
                    li.l_suppkey.cast("string").alias("option_id"),
                    rich.s_name.alias("option_label"),
                    _org(li.l_partkey).alias("organization_id"))
            .distinct())


def contexts(t: Tables) -> DataFrame:
    o = t.orders
    return o.where(o.o_orderstatus != "P").select(
        o.o_orderkey.alias("submission_id"),
        (o.o_orderkey % 10).alias("request_id"),
        (o.o_orderkey % 7).alias("response_id"),
        (o.o_orderkey % 20).alias("form_id"),
        _org(o.o_orderkey).alias("organization_id"),
        o.o_custkey.alias("created_by"),
        o.o_orderdate.alias("completed_at"),
        o.o_orderdate.alias("created_at"),
        F.when(o.o_orderpriority == "1-URGENT", F.lit(None).cast("string"))
         .otherwise(o.o_orderpriority).alias("review_stage_id"),
        F.concat(F.lit("stage_"), F.substring(o.o_orderpriority, 1, 1)).alias("review_stage_name"),
        F.when(o.o_orderstatus == "F", F.lit("final")).otherwise(F.lit("open")).alias("review_stage_type"),
    )


def users(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(c.c_custkey.alias("userid"),
                    F.concat(F.lower(c.c_name), F.lit("@example.com")).alias("email"))


def history(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        e.user_id.alias("submission_id"),
        e.event_id.alias("submission_history_id"),
        e.ts.alias("activity_date"),
        e.event_type.alias("description"),
        e.props.alias("note"),
        _org(e.user_id).alias("organization_id"),
    )


def history_mail(t: Tables) -> DataFrame:
    e = t.events
    return e.where(e.event_type != "error").select(
        e.event_id.alias("submissionhistoryid"),
        F.concat(F.lit("msg "), e.event_type).alias("emailmessage"),
        F.concat(e.user_id.cast("string"), F.lit("@example.com")).alias("emailrecipients"),
    )


def files(t: Tables) -> DataFrame:
    """One file per document; ids leave gaps, so many answers name no file.  Of three documents one has a
    name to be saved under, one an empty one, one none."""
    d = t.documents
    copy = F.concat(F.lit("copy of "), d.source, F.lit(" "), d.doc_id.cast("string"), F.lit(".txt"))
    return d.select(
        (d.doc_id * 3).alias("id"),
        F.when(d.doc_id % 3 == 0, copy).when(d.doc_id % 3 == 1, F.lit("")).alias("save_as"),
        F.concat(d.source, F.lit("_"), d.doc_id.cast("string"), F.lit(".pdf")).alias("file_name"),
        d.n_chars.alias("file_size_bytes"),
        d.source.alias("bucket_name"),
        F.concat(F.lit("k/"), d.doc_id.cast("string")).alias("storage_key"),
    )


def file_contents(t: Tables) -> DataFrame:
    """(file_id, content): the bytes of each file are its document's text."""
    d = t.documents
    return d.select((d.doc_id * 3).alias("file_id"), F.encode(d.text, "UTF-8").alias("content"))


def audit_tables(t: Tables) -> AuditTables:
    return AuditTables(answers(t), fields(t), options(t), contexts(t), users(t),
                       history(t), history_mail(t), files(t))


def all_submission_ids(t: Tables) -> DataFrame:
    """Request ids of a report that covers every submission in the data."""
    return t.orders.select(F.col("o_orderkey").alias("submission_id"))


def status_log(t: Tables) -> DataFrame:
    """Report-status events (see ``quire.operators.status``): one report per user of the event table.

    A signup puts the report's item, a click sets its processed count, a view its percentage, an
    error deletes it.  A purchase ends the run: every third leaves it ``incomplete``, with an empty
    archive name; the others set status, archive name and link.
    """
    e = t.events
    rid = F.concat(F.lit("r"), e.user_id.cast("string"))
    name = F.concat(F.lit("Report "), e.user_id.cast("string"))
    stamp = F.date_format(e.ts, REPORT_STAMP_FORMAT)
    archive = F.concat(F.lit("AuditGrp"), name, stamp, F.lit(".zip"))
    item = F.struct(stamp.alias("created_at"), F.concat(F.lit("u"), e.user_id.cast("string"), F.lit("@example.com")).alias("created_by"),
                    name.alias("report_name"), F.floor(e.value).alias("total_submissions"), archive.alias("s3_filename"))
    none = F.lit(None)

    def ev(order: int, op: str, num=none, text=none, item=none) -> Column:
        return F.struct(F.lit(order).alias("n"), F.lit(op).alias("op"), num.cast("double").alias("num"), text.cast("string").alias("text"),
                        item.cast(ITEM).alias("item"))

    failed = e.event_id % 3 == 0
    ended = F.when(failed, F.array(ev(0, "complete", text=F.lit("incomplete")), ev(1, "file", text=F.lit("")))).otherwise(
        F.array(ev(0, "complete", text=F.lit("completed")), ev(1, "file", text=archive),
                ev(2, "link", text=F.concat(F.lit("store/"), archive))))
    events = (F.when(e.event_type == "signup", F.array(ev(0, "create", item=item)))
              .when(e.event_type == "click", F.array(ev(0, "progress", num=e.value)))
              .when(e.event_type == "view", F.array(ev(0, "percent", num=e.value)))
              .when(e.event_type == "error", F.array(ev(0, "delete")))
              .when(e.event_type == "purchase", ended))
    one = e.select(_org(e.user_id).alias("organization_id"), rid.alias("report_id"), e.ts.alias("ts"), e.event_id.alias("_id"),
                   F.explode(events).alias("e"))
    return one.select("organization_id", "report_id", "ts", (F.col("_id") * 4 + F.col("e.n")).alias("seq"), "e.op", "e.num", "e.text", "e.item")


# ------------------------------------------------------------- commerce model

@dataclass
class CommerceTables:
    orders: DataFrame        # order_id, customer_id, order_purchase_timestamp
    payments: DataFrame      # order_id, payment_value
    customers: DataFrame     # customer_id, customer_zip_code_prefix
    items: DataFrame         # order_id, order_item_id, product_id, price, shipping_date
    products: DataFrame      # product_id, product_category_name
    translation: DataFrame   # product_category_name
    geolocation: DataFrame   # geolocation_zip_code_prefix, geolocation_city, geolocation_state


def commerce_tables(t: Tables) -> CommerceTables:
    o, li, c, p = t.orders, t.lineitem, t.customer, t.part
    n, r = t.nation, t.region
    orders = o.select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                      o.o_orderdate.alias("order_purchase_timestamp"))
    payments = li.select(li.l_orderkey.alias("order_id"), li.l_extendedprice.alias("payment_value"))
    customers = c.select(c.c_custkey.alias("customer_id"), c.c_nationkey.alias("customer_zip_code_prefix"))
    geolocation = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("geolocation_zip_code_prefix"),
        F.col("n_name").alias("geolocation_city"), F.col("r_name").alias("geolocation_state"))
    items = li.select(li.l_orderkey.alias("order_id"), li.l_linenumber.alias("order_item_id"),
                      li.l_partkey.alias("product_id"), li.l_extendedprice.alias("price"),
                      li.l_shipdate.alias("shipping_date"))
    products = p.select(p.p_partkey.alias("product_id"), p.p_type.alias("product_category_name"))
    translation = (p.where(p.p_type != "ECONOMY")
                   .select(p.p_type.alias("product_category_name")).distinct())
    return CommerceTables(orders, payments, customers, items, products, translation, geolocation)
