"""The corpus tables as elements, and their indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Index, build
from ..sources.elements import elements, union_types
from ..sources.store import ParquetStore, shared_folder

SITES = {"de": 1, "en": 2, "es": 3, "fr": 4}
TITLE = r"^[^.\n]*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(lang: Column) -> Column:
    out = F.lit(0)
    for k, v in SITES.items():
        out = F.when(lang == k, v).otherwise(out)
    return out


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language, toxic ones disabled. The text holds the title already."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    return elements(docs, "document", F.col("doc_id"), site_of(F.col("lang")), F.regexp_extract("text", TITLE, 0), {"body": F.col("text")}, enabled=F.coalesce(F.col("toxic"), F.lit(0)) != 1)


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return elements(table(spark, sf_dir, "pages"), "page", F.col("page_id"), 1, F.regexp_extract(html, r"<title>([^<]*)</title>", 1), {"body": F.regexp_replace(html, r"<[^>]*>", " ")})


def part_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(table(spark, sf_dir, "part"), "part", F.col("p_partkey"), 1, F.col("p_name"), attributes={"brand": F.col("p_brand"), "type": F.col("p_type")})


def conversation_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return elements(rows, "message", F.col("conv_id") * 1000 + F.col("turn"), 1, fields={"text": F.col("text")}, has_titles=False)


def all_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_types(*(f(spark, sf_dir) for f in (document_elements, page_elements, part_elements, conversation_elements)))


_built: dict[tuple[str, str, str], Index] = {}


def index_of(spark: SparkSession, sf_dir: str, kind: str = "document") -> Index:
    """The stored index of one element type, built once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _built:
        for old in [k for k in _built if k[0] != key[0]]:
            del _built[old]
        makers = {"document": document_elements, "page": page_elements, "part": part_elements}
        _built[key] = ParquetStore(spark, shared_folder(spark)).write(build(makers[kind](spark, sf_dir)))
    return _built[key]
