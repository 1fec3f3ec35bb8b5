"""Index statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import format_bytes
from .index import Index

TERM_BYTES, DOC_BYTES, TOKEN_BYTES = 20, 50, 12


def summary(index: Index) -> DataFrame:
    """One row: totals over all sites, average length, estimated size and health."""
    terms = index.term_dict.agg(F.countDistinct("term").alias("total_terms"))
    docs, length, n = F.col("total_docs"), F.col("total_length"), F.col("total_terms")
    size = n * TERM_BYTES + docs * DOC_BYTES + length * TOKEN_BYTES
    ratio = F.when(docs > 0, F.round(n / docs, 2)).otherwise(0.0)
    rows = index.totals().crossJoin(terms)
    return rows.select(
        docs, n, length,
        F.when(docs > 0, F.round(length / docs, 2)).otherwise(0.0).alias("avg_length"),
        size.alias("storage_bytes"),
        format_bytes(size).alias("storage"),
        ratio.alias("term_doc_ratio"),
        F.when(ratio > 5, "green").when(ratio > 2, "yellow").otherwise("red").alias("health"),
    )


def top_terms(index: Index, n: int = 10) -> DataFrame:
    """(term, doc_freq) over all sites, most used first."""
    counts = index.term_dict.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"))
    return counts.orderBy(F.desc("doc_freq"), "term").limit(n)


def stats(index: Index, detailed: bool = False) -> dict[str, DataFrame]:
    return {"summary": summary(index)} | ({"top_terms": top_terms(index)} if detailed else {})
