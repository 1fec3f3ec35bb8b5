"""Shared-folder tables and small helpers that the operators of this package use."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's spark.checkpoint.dir.

    Only where the session names none and runs in one process (tests) a temporary folder
    is made, once per session, and set as the checkpoint folder; on a cluster, whose
    executors couldn't reach it, a missing setting is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparrowdex-"))
    return sc.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file systems; missing ones are no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one operator call, in a folder of their own under the shared one.

    `save` cuts lineage by writing Parquet and reading it back: it survives the
    loss of any executor. `drop` and `keep` free tables that later steps don't
    need; the rest goes when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        self.saved.append(path)
        schema = df.schema
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)  # an empty table has no file to infer it from
        out._sparrowdex_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._sparrowdex_path)

    def keep(self, *tables: DataFrame) -> None:
        """Frees all tables but these."""
        kept = [t._sparrowdex_path for t in tables]
        for path in self.saved:
            if path not in kept:
                remove(self.spark, path)
        self.saved = kept

    def close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                remove(self.spark, self.path)
        except Exception:  # the session has ended already: nothing can be deleted through it
            pass


def text_key(text: Column) -> Column:
    """64-bit key of a text, null included, independent of plain xxhash64(text)."""
    return F.xxhash64(F.lit("row"), text)
