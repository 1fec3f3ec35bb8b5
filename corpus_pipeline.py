"""Corpus preparation: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage gets all rows that the one before kept, as Parquet, and its decisions
take effect. The last one returns the packed sequences; the others the columns of
`documents`, extra ones with them, whatever their names.

Defined results, for every stage: null and empty texts are no evidence against a document
and stay, up to a packed length of 1; rows with a null id stay unless their own text sends
them away; texts of any length are read whole; ties go to the least id, and rows that share
one are ordered by a hash of their text; an empty table gives an empty table. Repeated rows
share their fate, but that the near-duplicate stage keeps one of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparrowdex.llm import decontaminate, line_dedup, packing, quality_model, superminhash
from sparrowdex.llm._work import Workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on the labels, rejects; short ones and those without a token stay."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_good(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has, or an earlier place; documents of nothing else go."""
    return line_dedup.drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that was similar before lines were taken out (of a near copy,
    only the lines that differ are left by then, which nothing resembles any more), and of
    those that stay, one of each group whose texts are similar now."""
    work = Workspace(spark, "near_dedup")
    once = work.save(superminhash.keep_one(docs, earlier=spark.read.parquet(f"{sf_dir}/documents.parquet")), "once")
    return superminhash.keep_one(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a run of words of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, start, units) of all that is left, whole."""
    return packing.best_fit(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

# The classifier is trained and the packing is an online algorithm: neither is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            work.drop(before)
        before = docs
    return docs
