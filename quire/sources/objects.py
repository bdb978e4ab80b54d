"""Object storage: put, list and fetch attachments.

Objects live under a root as ``<root>/<bucket>/<key>``.  Listing uses Spark's
``binaryFile`` source with only metadata columns selected, so the ``content``
column is pruned from the scan and no bytes are read; the listing is complete
(every file under the root), not a first page.  Fetching an attachment
manifest does not list the store: the manifest's own tasks look up their
objects' metadata in batches (work grows with the manifest, not with the
bucket, and no listing passes through the driver).  Each row gets ``ok`` or
``missing`` (a missing object is reported and the rest continue), and bytes
are only read by whoever consumes ``object_path`` (the archive writer streams
them straight from storage into the ZIP entry).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs as qfs

OK = "ok"
MISSING = "missing"


def put_objects(spark: SparkSession, objects: DataFrame, root: str) -> DataFrame:
    """Write each row's ``content`` (binary) to ``<root>/<path>``.

    Writes go straight to the final key: writing the same bytes again is
    idempotent, so a retried task simply overwrites its partial objects.
    Returns the manifest (path, bytes) written through Spark's commit protocol.
    """
    root = root.rstrip("/")

    def put(batches):
        fsys, base = qfs.resolve(root)
        made = set()
        for pdf in batches:
            sizes = []
            for path, content in zip(pdf["path"], pdf["content"]):
                target = f"{base}/{path}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    fsys.create_dir(parent, recursive=True)
                    made.add(parent)
                with fsys.open_output_stream(target) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pd.DataFrame({"path": pdf["path"], "bytes": sizes})

    manifest = f"{root}/_quire_manifest/put-{uuid.uuid4().hex[:12]}"
    (objects.select("path", "content")
     .mapInPandas(put, "path string, bytes bigint")
     .write.mode("overwrite").parquet(manifest))
    return spark.read.parquet(manifest)


def list_objects(spark: SparkSession, root: str) -> DataFrame:
    """Every object under ``root``: (bucket_name, storage_key, object_path,
    length, modified).  ``object_path`` is relative to ``root``."""
    prefix = qfs.qualified(root) + "/"
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
           .load(qfs.normalize(root)).select("path", "length", "modificationTime"))
    rel = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 30))
    return (raw.select(rel.alias("object_path"), "length", F.col("modificationTime").alias("modified"))
            .where(F.col("object_path").isNotNull())
            .select(F.substring_index("object_path", "/", 1).alias("bucket_name"),
                    F.expr("substring(object_path, length(substring_index(object_path, '/', 1)) + 2)")
                    .alias("storage_key"),
                    "object_path", "length", "modified"))


def destination(path: Column, new_name: Column | None = None) -> Column:
    """Where a fetched object is saved: ``path``, or the same folder with
    ``new_name`` when that is non-empty."""
    if new_name is None:
        return path
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    return F.when(F.coalesce(new_name, F.lit("")) == "", path).otherwise(F.concat(folder, new_name))


def _probe_objects(root: str):
    """mapInPandas body: adds ``object_path`` (``<bucket>/<key>`` when that
    object exists under ``root``, else null) and its ``length``."""
    def run(batches):
        import pyarrow.fs as pafs

        fsys, base = qfs.resolve(root)
        for pdf in batches:
            rel = [None if b is None or k is None or ".." in k.split("/") else f"{b}/{k}"
                   for b, k in zip(pdf["bucket_name"], pdf["storage_key"])]
            uniq = list(dict.fromkeys(r for r in rel if r is not None))
            infos = dict(zip(uniq, fsys.get_file_info([f"{base}/{r}" for r in uniq]))) if uniq else {}
            found = [r if r is not None and infos[r].type == pafs.FileType.File else None for r in rel]
            sizes = [infos[r].size if r is not None else None for r in found]
            yield pdf.assign(object_path=found, length=pd.array(sizes, dtype="Int64"))
    return run


def fetch_attachments(spark: SparkSession, manifest: DataFrame, root: str,
                      dest_col: str = "folder_directory", new_name_col: str | None = None) -> DataFrame:
    """Resolve a manifest of (bucket_name, storage_key, <dest_col>) against the
    objects under ``root``: adds destination_path, object_path, length, status."""
    m = manifest.withColumn(
        "destination_path",
        destination(F.col(dest_col), F.col(new_name_col) if new_name_col else None))
    schema = T.StructType(list(m.schema.fields) + [T.StructField("object_path", T.StringType()),
                                                   T.StructField("length", T.LongType())])
    j = m.mapInPandas(_probe_objects(root), schema)
    return j.withColumn("status", F.when(F.col("object_path").isNull(), F.lit(MISSING)).otherwise(F.lit(OK)))


def documents_as_objects(documents: DataFrame, where: Column | None = None) -> DataFrame:
    """(path, content) for document texts stored as ``<source>/k/<doc_id>``."""
    d = documents if where is None else documents.where(where)
    return d.select(F.concat(d.source, F.lit("/k/"), d.doc_id.cast("string")).alias("path"),
                    F.encode(d.text, "UTF-8").alias("content"))
