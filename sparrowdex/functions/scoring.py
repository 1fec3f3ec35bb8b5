"""Ranking and presentation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import Settings


def bm25(freq: Column, doc_freq: Column, doc_len: Column, avg_len: Column, n_docs: Column, s: Settings) -> Column:
    idf = F.log(F.lit(1.0) + (n_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))
    norm = F.lit(s.bm25_k1) * (F.lit(1.0 - s.bm25_b) + F.lit(s.bm25_b) * (doc_len / avg_len))
    return idf * (freq * F.lit(s.bm25_k1 + 1.0)) / (freq + norm)


def average_length(total_length: Column, total_docs: Column) -> Column:
    return F.greatest(F.lit(1), total_length) / F.greatest(F.lit(1), total_docs)


def format_bytes(n: Column) -> Column:
    """1536 -> "1.5 KB": two decimals at most, units up to TB."""
    n = F.greatest(n.cast("long"), F.lit(0).cast("long"))
    power, unit = F.lit(0), F.lit("B")
    for k, u in enumerate(("KB", "MB", "GB", "TB"), 1):
        power, unit = F.when(n >= 1 << (10 * k), k).otherwise(power), F.when(n >= 1 << (10 * k), u).otherwise(unit)
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    return F.concat(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", ""), F.lit(" "), unit)


def doc_key(element_id: Column, site_id: Column) -> Column:
    """The key that a result is known by outside: "element-site"."""
    return F.concat_ws("-", element_id.cast("string"), site_id.cast("string"))


def parse_doc_key(key: Column) -> Column:
    """(element_id, site_id) of such a key."""
    parts = F.split(key, "-")
    return F.struct(parts[0].cast("bigint").alias("element_id"), parts[1].cast("int").alias("site_id"))
