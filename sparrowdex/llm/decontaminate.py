"""Benchmark decontamination by Wu-Manber search for many strings at once.

Patterns are the runs of `words` words of every benchmark item (all its words
where it has fewer), normalised like the documents: lower case, one space for
every run of characters that aren't letters or digits, and a space at either end,
so that matches start and end with words. With m the length of the shortest
pattern, a window of m bytes slides over a document. A table gives for the last
`block` bytes of the window how far it may move before any pattern's first m
bytes can fit; unknown blocks move it by m - block + 1. Where the shift is 0, the
bucket of that suffix block holds the patterns to compare byte by byte. Most of a
text is never looked at.

The distinct patterns are made by Spark, numbered and written to the shared folder in
sets of about `max_bytes`; a task reads the set it searches for from there. Neither the
driver nor a broadcast holds them, however many items the benchmark has, and every set
is one more pass over the texts.

Defined results: null or wordless texts and items never match; texts and items of any
length are used whole. Item ids may be null or repeated: items that share an id are one
item with the patterns of all. Documents that share an id, or have none, count as one:
n_patterns is the number of the item's distinct patterns that occur in any of them.
Nothing is ranked, so there are no ties. Empty tables match nothing. Extra columns are
passed through by `decontaminate`, whatever their names, and never read."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Workspace

WORDS, BLOCK, MAX_BYTES = 13, 8, 8 << 20
COST = 4  # bytes of a set for each byte of a pattern, with its place in both tables
CHAIN = 8  # sets searched for in one pass of `decontaminate`, each by a worker of its own


def normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


class WuManber:
    """Exact search for byte patterns; `search` yields (end of the window, pattern number) of every occurrence."""

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        self.patterns = [p for p in patterns if p]
        self.m = min(map(len, self.patterns), default=0)
        self.block = b = min(block, self.m)
        self.far = self.m - b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[int]] = {}
        for k, p in enumerate(self.patterns):
            for end in range(b, self.m + 1):
                x = p[end - b : end]
                self.shift[x] = min(self.shift.get(x, self.far), self.m - end)
            self.bucket.setdefault(p[self.m - b : self.m], []).append(k)

    def search(self, text: bytes):
        if not self.m:
            return
        m, b, far, get, n = self.m, self.block, self.far, self.shift.get, len(text)
        end = m
        while end <= n:
            s = get(text[end - b : end], far)
            if s:
                end += s
                continue
            for k in self.bucket[text[end - b : end]]:
                if text.startswith(self.patterns[k], end - m):
                    yield end, k
            end += 1


class Patterns:
    """The benchmark's distinct patterns (number, pattern) in sets, and (number, item)."""

    def __init__(self, benchmark: DataFrame, words: int, max_bytes: int):
        self.work = Workspace(benchmark.sparkSession, "patterns")
        w = F.split(F.trim("t"), " ")
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (words - 1)))
        runs = (
            benchmark.select(F.col("item_id").cast("long").alias("item"), normalised(F.col("text")).alias("t"))
            .filter("t is not null and trim(t) <> ''")
            .select("item", w.alias("w"))
            .select("item", "w", F.explode(starts).alias("k"))
            .select("item", F.concat(F.lit(" "), F.array_join(F.slice("w", F.col("k"), words), " "), F.lit(" ")).alias("pattern"))
        )
        runs = self.work.save(runs.distinct(), "runs")
        # numbers are final once they are written
        kinds = self.work.save(runs.select("pattern").distinct().withColumn("number", F.monotonically_increasing_id()), "kinds")
        size = kinds.agg(F.coalesce(F.sum(F.octet_length("pattern").cast("long")), F.lit(0))).first()[0]
        self.sets = -(-COST * size // max_bytes)
        of = F.pmod(F.xxhash64("pattern"), F.lit(max(1, self.sets))).cast("int")
        self.by_set = self.work.save(kinds.withColumn("part", of).repartition("part"), "sets", ["part"])
        self.items = runs.join(kinds, "pattern").select("number", "item")

    def path(self, k: int) -> str:
        return f"{self.by_set._sparrowdex_path}/part={k}"


def _machine(path: str, block: int) -> tuple[WuManber, list[int]]:
    """A set's machine and the numbers of its patterns; an empty set has no folder."""
    disk, folder = fs.FileSystem.from_uri(path)
    if disk.get_file_info(folder).type == fs.FileType.NotFound:
        return WuManber([], block), []
    files = [f.path for f in disk.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    rows = pa.concat_tables([pq.ParquetFile(disk.open_input_file(f)).read(columns=["pattern", "number"]) for f in files])
    return WuManber([p.encode() for p in rows["pattern"].to_pylist()], block), rows["number"].to_pylist()


def _matcher(path: str, block: int):
    def run(batches):
        machine, numbers = _machine(path, block)
        for batch in batches:
            docs, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text is not None:
                    own = {k for _, k in machine.search(text)}
                    docs += [doc] * len(own)
                    found += [numbers[k] for k in own]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "number"])

    return run


def _clean(path: str, block: int):
    def run(batches):
        machine, _ = _machine(path, block)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([t is None or next(machine.search(t), None) is None for t in texts], pa.bool_()))

    return run


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id, n_patterns) of the documents that hold a pattern of an item."""
    patterns = Patterns(benchmark, words, max_bytes)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    hits = docs.sparkSession.createDataFrame([], "doc_id long, number long")
    for k in range(patterns.sets):
        own = text.mapInArrow(_matcher(patterns.path(k), block), "doc_id long, number long")
        hits = hits.union(own) if k else own
    found = hits.distinct().join(patterns.items, "number").groupBy("doc_id", F.col("item").alias("item_id"))
    return found.agg(F.count("*").alias("n_patterns"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, in which no pattern occurs: a map, without a shuffle.

    Every CHAIN sets the rows that are left are written, so that a task holds at most so many sets."""
    patterns = Patterns(benchmark, words, max_bytes)
    names = [f"c{k}" for k in range(len(docs.columns))]
    out = docs.toDF(*names).withColumn("__normalised", normalised(F.col(names[docs.columns.index(text_col)])))
    before = None
    for k in range(patterns.sets):
        if k and k % CHAIN == 0:
            now = patterns.work.save(out, "left")
            if before is not None:
                patterns.work.drop(before)
            out = before = now
        out = out.mapInArrow(_clean(patterns.path(k), block), out.schema)
    return out.drop("__normalised").toDF(*docs.columns)


SQL = rf"""
WITH norm AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, ' ' || array_to_string(w[k:k + {WORDS - 1}], ' ') || ' ' AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WORDS - 1}) + 1)) AS k FROM norm WHERE len(w) > 0 AND w[1] <> '')
), texts AS (
  SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' AS t FROM documents
)
SELECT doc_id, item_id, count(*) AS n_patterns FROM texts JOIN windows ON contains(t, p) GROUP BY doc_id, item_id
"""
