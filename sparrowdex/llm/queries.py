"""Queries over the corpus tables, one for each operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, license_scan, line_dedup, packing, quality_model, quality_rules, superminhash, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.induce(docs, _table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), counts=True)
    lines, dropped = (F.col(c).cast("long") for c in line_dedup.COUNTS)
    return out.select("doc_id", "text", lines.alias("n_lines"), dropped.alias("n_dropped"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.divergence(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.scores(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.groups(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"))


QUERIES = [op1_toxicity, op2_line_dedup, op3_decontamination, op4_quality_rules, op5_language_id, op6_warc, op7_quality_classifier, op8_superminhash, op9_license_scan, op10_best_fit_packing]
SQL = {"op2_line_dedup": line_dedup.SQL, "op3_decontamination": decontaminate.SQL, "op4_quality_rules": quality_rules.SQL, "op6_warc": warc.SQL}


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
