"""Stored model tables: the audit model laid out for its joins.

``write_model`` stores the audit tables once, ``read_model`` gives them back as ``AuditTables``:

* tables of an organization are partitioned by ``organization_id``, so a report's filter is a partition filter, and a
  request of several reports prunes partitions at run time (dynamic partition pruning);
* answers, contexts and history are bucketed by ``submission_id``, which every request and the contexts' three-key
  join have, and options and fields by ``field_id``: equal buckets meet without an exchange.  The three-key
  join uses the buckets of one of its keys where ``spark.sql.requireAllClusterKeysForCoPartition`` is off
  (``session.JOB_CONF``); otherwise Spark shuffles it, with equal results.

Each (organization, bucket) is written by one task into one file.  The tables are external ones in the session's
catalog; their columns and buckets are kept in ``<folder>/layout``, so any session can declare them again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from .views import AuditTables

BUCKETS = 64
#: Table -> what it is partitioned and bucketed by.
LAYOUT = {
    "answers": ("organization_id", "submission_id"),
    "fields": ("organization_id", "field_id"),
    "options": ("organization_id", "field_id"),
    "contexts": ("organization_id", "submission_id"),
    "users": (None, "userid"),
    "history": ("organization_id", "submission_id"),
    "history_mail": (None, "submissionhistoryid"),
    "files": (None, "id"),
}


def _name(folder: str, table: str) -> str:
    """A catalog name of its own for each folder."""
    return f"quire_{hashlib.sha256(folder.encode()).hexdigest()[:12]}_{table}"


def _declare(spark: SparkSession, folder: str, table: str, columns: str, buckets: int) -> str:
    name = _name(folder, table)
    partition, bucket = LAYOUT[table]
    parted = f"PARTITIONED BY ({partition}) " if partition else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parted}CLUSTERED BY ({bucket}) SORTED BY ({bucket}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{folder}/{table}'")
    return name


def _ordered(df: DataFrame, partition: str | None) -> DataFrame:
    """The partition column last, as the stored table has it."""
    return df.select(*[c for c in df.columns if c != partition], *([partition] if partition else []))


def write_model(spark: SparkSession, a: AuditTables, folder: str, buckets: int = BUCKETS) -> AuditTables:
    """Store ``a`` under ``folder`` (a shared file system) and return the stored tables."""
    folder = folder.rstrip("/")
    rows = []
    for table, (partition, bucket) in LAYOUT.items():
        df = _ordered(getattr(a, table), partition)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        name = _declare(spark, folder, table, columns, buckets)
        df.repartition(buckets, bucket).write.insertInto(name, overwrite=True)
        rows.append((table, columns, buckets))
    spark.createDataFrame(rows, "table string, columns string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layout")
    return read_model(spark, folder)


def read_model(spark: SparkSession, folder: str) -> AuditTables:
    """The stored tables of ``folder``, lazily."""
    folder = folder.rstrip("/")
    tables = {}
    for r in spark.read.parquet(f"{folder}/layout").collect():          # one row for each table of the model
        name = _declare(spark, folder, r["table"], r["columns"], r["buckets"])
        if LAYOUT[r["table"]][0]:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        tables[r["table"]] = spark.table(name)
    return AuditTables(**tables)


def drop_model(spark: SparkSession, folder: str) -> None:
    """Forget the tables of ``folder`` in this session's catalog; the stored files stay."""
    for table in LAYOUT:
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder.rstrip('/'), table)}")
