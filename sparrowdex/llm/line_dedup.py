"""Line dedup against levelled sorted runs of line hashes.

A run is a Parquet table of the 128-bit hashes of lines already seen, bucketed
and sorted by hash. A batch of documents is hashed, merge-anti-joined with every
run, and the hashes that are new become a run on level 0. As soon as a level
holds `fanout` runs they are merged into one run of the next level, so a corpus
of B batches has at most (fanout - 1) log B runs and each hash is rewritten
log B times. Buckets are the same for all runs and for each batch's shuffle:
joins and compactions read runs without moving them.

A line is what `\\n` separates, compared without white space at its ends. Blank
lines are neither counted nor dropped. Of equal lines, the first in the order of
(doc_id, position) stays, over the whole table however it is batched. Rows equal in
id, text and position are the same line and share its fate.

Defined results: a null text is kept as null and holds no lines. Null ids come
first in the order, and documents that share an id are ordered by a hash of
their text. Rows equal in id and text are one document and get the same result.
Tables may be empty; extra columns are kept and never read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, remove, text_key

BATCHES, FANOUT = 4, 3
COUNTS = ("__n_lines", "__n_dropped")
LINE = r"^\s+|\s+$"


class Runs:
    """Levelled runs in a folder; `levels[k]` lists the table names on level k."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = FANOUT):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.levels: list[list[str]] = []

    def _write(self, hashes: DataFrame, level: int) -> None:
        name = f"run_{uuid.uuid4().hex}"
        (
            hashes.repartition(self.buckets, "h1", "h2")
            .write.format("parquet")
            .option("compression", "zstd")
            .option("path", f"{self.folder}/{name}")
            .bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines (h1, h2, ...) in none of the runs: a merge anti join with each."""
        for run in self.tables():
            lines = lines.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def add(self, hashes: DataFrame) -> None:
        """Adds distinct, unseen hashes as a run, then compacts full levels."""
        self._write(hashes.select("h1", "h2"), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            merged = self.spark.table(names[0])
            for n in names[1:]:
                merged = merged.union(self.spark.table(n))
            self._write(merged, level + 1)
            for n in names:
                self._drop(n)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        for level in self.levels:
            for n in level:
                self._drop(n)
        self.levels = []


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, pos, h1, h2) of each non-blank line."""
    text = F.col(text_col).cast("string")
    line = F.regexp_replace("line", LINE, "")
    return (
        docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("id", "row", "pos", line.alias("line"))
        .filter("line <> ''")
        .select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, Workspace]:
    """(id, row, gone) with the positions of each document's repeated lines, written to the shared folder."""
    spark = docs.sparkSession
    work = Workspace(spark, "linededup")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = sorted({int(x) for x in (ids.agg(F.percentile_approx("id", [(k + 1) / batches for k in range(batches - 1)], 10000).alias("q")).first()["q"] or [])}) if batches > 1 else []
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.coalesce((F.col("id") > c).cast("int"), F.lit(0))
    lines = work.save(_lines(docs, id_col, text_col).withColumn("batch", batch), "lines", ["batch"])
    runs = Runs(spark, work.path, buckets, fanout)
    gone = None
    for k in range(len(cuts) + 1):
        mine = lines.filter(F.col("batch") == k).drop("batch")
        # an aggregate, combined before its shuffle: a line that very many documents share is one row per task
        heads = mine.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "pos")).alias("first"))
        new = work.save(runs.unseen(heads), f"new{k}")
        kept = new.select(*[F.col(c).alias(f"kept_{c}") for c in ("h1", "h2")], *[F.col(f"first.{c}").alias(f"kept_{c}") for c in ("id", "row", "pos")])
        # the position is part of the key, so that shared lines don't meet in one partition
        same = F.col("id").eqNullSafe(F.col("kept_id"))
        for c in ("h1", "h2", "row", "pos"):
            same = same & (F.col(c) == F.col(f"kept_{c}"))
        dropped = mine.join(kept, same, "left_anti")
        part = work.save(dropped.groupBy("id", "row").agg(F.collect_set("pos").alias("gone")), f"gone{k}")
        gone = part if gone is None else gone.union(part)
        runs.add(new)
        work.drop(new)
    runs.close()
    work.drop(lines)
    return gone, work


def _rebuilt(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """`docs` with columns c0, c1, ... (so that no name can clash), the text without repeats, n_lines and n_dropped."""
    gone, _ = repeated_lines(docs, id_col, text_col, **options)
    names = [f"c{k}" for k in range(len(docs.columns))]
    docs, own_id, own_text = docs.toDF(*names), names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    text = F.col(own_text).cast("string")
    out = docs.join(gone.toDF("gone_id", "gone_row", "gone"), F.col(own_id).cast("long").eqNullSafe(F.col("gone_id")) & (text_key(text) == F.col("gone_row")), "left")
    every = F.split(text, "\n", -1)
    left = F.array_join(F.filter(every, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    filled = F.size(F.filter(every, lambda x: F.regexp_replace(x, LINE, "") != ""))
    return out.select(
        *[F.when(F.col("gone").isNull(), text).otherwise(left).alias(n) if n == own_text else n for n in names],
        F.when(text.isNull(), 0).otherwise(filled).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, counts: bool = False) -> DataFrame:
    """`docs`, all rows and columns, with repeated lines taken out of the text.

    With `counts`, the columns __n_lines (non-blank lines before) and __n_dropped are added."""
    out = _rebuilt(docs, id_col, text_col, batches=batches, fanout=fanout)
    return out.toDF(*docs.columns, *COUNTS) if counts else out.drop("n_lines", "n_dropped").toDF(*docs.columns)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`dedup_lines` without the documents of which no non-blank line is left
    because all were repeats. Documents that had none before stay."""
    out = _rebuilt(docs, id_col, text_col, **options).filter("n_lines = 0 or n_dropped < n_lines")
    return out.drop("n_lines", "n_dropped").toDF(*docs.columns)


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), marked AS (
  SELECT doc_id, pos, line, trimmed = '' AS blank,
         row_number() OVER (PARTITION BY trimmed ORDER BY doc_id, pos) AS n
  FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS trimmed FROM lines)
), built AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE blank OR n = 1), '') AS text,
         count(*) FILTER (WHERE NOT blank) AS n_lines, count(*) FILTER (WHERE NOT blank AND n > 1) AS n_dropped
  FROM marked GROUP BY doc_id
)
SELECT doc_id, text, n_lines, n_dropped FROM built
"""
