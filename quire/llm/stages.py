"""Operators as stages of a pipeline: documents in, documents out.

A stage takes a documents table (doc_id, text, lang, source, n_chars; extra columns
pass through, whatever their names) and returns what it keeps, with the same columns;
where it changes a text, n_chars follows.  Nulls, empty texts, ties and empty tables are
those of the operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import minhash_tensor, mixing_es, quality_ordinal, repeated_phrases, shared_keys, wordhash
from quire.llm.tables import broadcast_if_small


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


#: Words in a shingle, and percent of shared shingles, of the near-dedup stage.
STAGE_SHINGLE = 5
STAGE_PERCENT = 80


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns, but doc_id and text, under names that no operator uses; and these names."""
    names = {c: f"_user_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.withColumnsRenamed(names), names


def _back(docs: DataFrame, like: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(names.get(c, c)).alias(c) for c in like.columns])


def good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the quality classifier, fitted on the rated ones among them, does not reject."""
    renamed, names = _aside(docs)
    return _back(quality_ordinal.rate(renamed, renamed, labels).where("kept"), docs, names)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document (the smallest doc_id) of each group of near duplicates (``STAGE_PERCENT`` of their
    ``STAGE_SHINGLE``-word shingles); of rows that share a doc_id, the first by text.  Rows without doc_id stay."""
    verdicts = minhash_tensor.near_duplicates(docs, shingle=STAGE_SHINGLE, percent=STAGE_PERCENT)
    dropped = broadcast_if_small(verdicts.where("not kept").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = (docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    repeated = broadcast_if_small(repeated)
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in ("text", *[c for c in docs.columns if c not in ("doc_id", "text")])])
    one = (kept.join(repeated, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionAll(one.select(*docs.columns))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All documents, without the passages that documents with smaller doc_ids have."""
    renamed, names = _aside(docs)
    cut = repeated_phrases.remove_repeats(renamed)
    if "n_chars" in names:
        length = names["n_chars"]
        cut = cut.withColumn(length, F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col(length)))
    return _back(cut, docs, names)


def _copies(batches, names: list[str]):
    """Rows with _epochs and _extra -> that many whole copies, and one of the first _extra words."""
    for part in shared_keys.slices(batches):
        w = wordhash.words(part.column("text"), hashed=False)
        buf, offsets = wordhash.utf8(part.column("text"))
        epochs, extra = part.column("_epochs").to_numpy(), part.column("_extra").to_numpy()
        cut = np.flatnonzero(extra > 0)
        heads = [bytes(buf[offsets[r]:w.end[w.first[r] + extra[r] - 1]]).decode() for r in cut]
        whole = part.take(pa.array(np.repeat(np.arange(part.num_rows), epochs))).select(names)
        begun = part.take(pa.array(cut)).select(names)
        at = names.index("text")
        begun = begun.set_column(at, begun.schema.field(at), pa.array(heads, begun.schema.field(at).type))
        yield from (b for b in (whole, begun) if b.num_rows)


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix: each source's documents as often as its target takes them, the last one's first words."""
    part = mixing_es.mix(docs, broadcast_if_small(mixing_es.quality_weights(labels)), whole=True).where("taken > 0")
    names = list(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = part.select(*[F.col("row")[c].alias(c) for c in names], F.col("epochs").alias("_epochs"), F.col("extra").alias("_extra"))
    return _with_length(rows.mapInArrow(lambda it: _copies(it, names), schema)).select(*names)
