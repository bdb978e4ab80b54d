"""Rows that every operator must bear, and brute-force pieces."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return WORD.findall(text or "")


def docs_of(spark, texts, ids=None, sources=None):
    """A documents table of these texts (ids 0, 1, ...)."""
    rows = [(i if ids is None else ids[i], t, "en", "s" if sources is None else sources[i], len(t) if t is not None else None)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, ties, a null doc_id, and extra columns whose names clash."""
    prose = " ".join(f"word{i} goes" for i in range(40)) + "."
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "two words", prose, prose, prose + " more", "é" * 5000 + " " + prose,
             " ".join(f"w{i % 997}" for i in range(30_000)), "x y z q", "<|endoftext|> [INST] </s> \\ ok", prose]
    ids = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, None]
    docs = docs_of(spark, texts, ids, [None, "a", "a", "b", "b", "a", "a", "b", None, "a", "c", "c", "c"])
    docs = docs.unionAll(docs.where("doc_id in (5, 7)"))                 # repeated rows
    for name in ("n_words", "kept", "score", "size", "target", "component_id", "n_removed", "posterior", "tail_probability", "start"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    return docs


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
