"""Report request documents.

A request is a JSON document ``{"organization_id": ..., "report_name": ...,
"submission_ids": [...]}``; ``submission_ids`` may also be a single scalar.
Documents are read as text (one document per file, or one per line) and
parsed on the executors, so any number of requests can be read at once; the
ids are exploded into a DataFrame that the exports semi-join against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_request_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Raw request texts in column ``doc``."""
    df = spark.read.text(path, wholetext=one_per_file)
    return df.select(F.col("value").alias("doc"))


def _as_id_array(ids_json: Column) -> Column:
    """A JSON list stays a list; a scalar becomes a one-element list.  Items are
    text here (``[1, "2"]`` -> 1, 2), so numbers may be written as strings."""
    t = F.trim(ids_json)
    listed = F.when(t.startswith("["), t).otherwise(F.concat(F.lit('["'), F.replace(t, F.lit('"'), F.lit('')), F.lit('"]')))
    return F.from_json(listed, "array<string>")


REQUEST_SCHEMA = "organization_id string, report_name string, submission_ids string"


def parse_requests(docs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """One parse per document; ``submission_ids`` is first taken as JSON text
    (a list or a scalar) and then normalised to ``array<string>``."""
    r = F.from_json(F.col(doc_col), REQUEST_SCHEMA)
    return docs.select(r.alias("r")).select(
        "r.organization_id", "r.report_name",
        _as_id_array(F.col("r.submission_ids")).alias("submission_ids"))


def _items(requests: DataFrame) -> DataFrame:
    """``posexplode_outer``: a plain explode makes Catalyst infer ``size(ids) > 0``
    filters that it pushes below the projection, re-running the JSON parse."""
    return requests.select("organization_id", "report_name", F.posexplode_outer("submission_ids").alias("position", "text"))


def _id() -> Column:
    return F.trim("text").try_cast("bigint")


def request_ids(requests: DataFrame) -> DataFrame:
    """One row per (organization, report, position, requested submission id), in
    the order of the request and with its repeats.  Ids are whole numbers from 0; see ``invalid_ids``."""
    return (_items(requests).select("organization_id", "report_name", "position", _id().alias("submission_id"))
            .where(F.col("submission_id") >= 0))


def at_rest(ids: DataFrame, folder: str) -> DataFrame:
    """``request_ids`` written to ``folder`` and read again.  Parsing has no statistics; a plain filter over a
    scan of known size is what Spark makes a runtime filter of."""
    ids.write.mode("overwrite").parquet(folder)
    return ids.sparkSession.read.schema(ids.schema).parquet(folder).where(F.col("submission_id") >= 0)


def invalid_ids(requests: DataFrame) -> DataFrame:
    """(organization_id, report_name, position, text) of what is not an id: to be
    reported, never dropped in silence.  A request without any id is one row."""
    return _items(requests).where(~F.coalesce(_id() >= 0, F.lit(False)))


def requests_from_customers(customers: DataFrame) -> DataFrame:
    """Request documents derived from a customer table, one per customer.

    Customers of one nation ask for one report of organization ``nation key mod 3``.  Odd
    customers ask with a scalar, even ones with a list that names an id as text, one
    twice, and one that no submission has.
    """
    key = F.col("c_custkey")
    several = F.concat(F.lit("["), (key * 3).cast("string"), F.lit(', "'), (key * 7 + 1).cast("string"), F.lit('", '),
                       (key + 1_000_000_000).cast("string"), F.lit(", "), (key * 3).cast("string"), F.lit("]"))
    ids = F.when(key % 2 == 0, several).otherwise((key * 3).cast("string"))
    report = F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"))
    head = F.to_json(F.struct((F.col("c_nationkey") % 3).cast("string").alias("organization_id"), report.alias("report_name")))
    doc = F.concat(F.regexp_replace(head, "}$", ""), F.lit(', "submission_ids": '), ids, F.lit("}"))
    return customers.select(doc.alias("doc"))


def requests_from_orders(orders: DataFrame, org: str, report_name: str) -> DataFrame:
    """Request documents derived from an order table, one per order.

    Odd keys are written as a scalar, even keys as a one-element list, so both
    document forms are exercised.
    """
    key = F.col("o_orderkey").cast("string")
    ids = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("["), key, F.lit("]"))).otherwise(key)
    head = F.to_json(F.struct(F.lit(org).alias("organization_id"), F.lit(report_name).alias("report_name")))
    doc = F.concat(F.regexp_replace(head, "}$", ""), F.lit(', "submission_ids": '), ids, F.lit("}"))
    return orders.select(doc.alias("doc"))
