"""quire — submission-audit exports and daily commerce reports as Spark jobs.

Subpackages:
    sources    readers: parquet tables, derived audit/commerce views, request
               documents, object listings and attachment fetches
    functions  Column-level expressions (value resolution, path layouts, text
               formats, multi-literal substitution)
    operators  DataFrame -> DataFrame operators (exports, commerce reports,
               status fold, batch progress) and the path-addressed sinks
    plans      end-to-end report plans and the registry of named queries
    streaming  Structured Streaming fold of the report-status log
"""

__all__ = ["session"]
