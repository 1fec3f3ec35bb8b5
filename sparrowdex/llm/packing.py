"""Bounded-space online best-fit packing of documents into fixed-length sequences.

Documents arrive in a fixed pseudo-random order and never wait. At most `open_bins`
bins are open; a bit set keyed by free space (one Python integer: bit f is set when
a bin with f free units is open) gives the bin with the least sufficient free space
in one step: the lowest set bit at or above the item's length. If none fits and
all places are taken, the fullest bin closes and a new one opens. A document longer
than a bin is cut into full bins, which close at once, and a rest that is packed
like any item: all of every text is packed.

Lengths are UTF-8 bytes plus one end mark by default (the units of a byte-level
model); `length` takes any expression, such as a token-count column.

A shard is packed by one task. Shards are cut by a hash of the row into pieces of
about `shard_rows` documents, so work grows in proportion with the input, memory
stays at one shard's ids and lengths, and each shard leaves at most `open_bins`
bins partly full. Equal rows (id, length and text) travel as one row with their
number and are dealt out again in blocks of a sixteenth of a shard: neither rows without an
id nor a row met a billion times fall into one shard.

Defined results: null texts have length 1 (the end mark), empty ones too; texts of any
length are packed whole. A null id is packed like any other. Rows that repeat are
packed once each. A length that is null or not positive counts as 1. Ties: of equally
full bins the one opened first takes the item. bin_id is unique over all shards. An
empty table gives no rows; extra columns are never read, whatever their names."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import text_key

CAPACITY, OPEN_BINS, SHARD_ROWS = 8192, 64, 50_000


def pack(lengths, capacity: int, open_bins: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """([(item, offset in the item, units, bin)], number of bins) in the given order."""
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")
    out, bits, by_free, bins, n_open = [], 0, {}, 0, 0
    for item, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            out.append((item, at, capacity, bins))
            bins += 1
            at += capacity
        need = length - at
        if not need:
            continue
        fits = bits >> need
        if fits:
            free = need + ((fits & -fits).bit_length() - 1)
            own = by_free[free]
            b = own.pop(0)  # of equally full bins, the one that opened first
            if not own:
                del by_free[free]
                bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                own = by_free[fullest]
                own.pop(0)
                if not own:
                    del by_free[fullest]
                    bits ^= 1 << fullest
                n_open -= 1
            b, free = bins, capacity
            bins += 1
            n_open += 1
        out.append((item, at, need, b))
        left = free - need
        if left:
            own = by_free.setdefault(left, [])
            own.append(b)
            own.sort()
            bits |= 1 << left
        else:
            n_open -= 1
    return out, bins


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, shard_rows: int = SHARD_ROWS, length: Column | None = None) -> DataFrame:
    """(bin_id, doc_id, start, units): `units` of the document from `start` on lie in the bin."""
    units = length if length is not None else F.octet_length(F.col(text_col).cast("string")) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(units, F.lit(1)), F.lit(1)).cast("long").alias("units"), text_key(F.col(text_col).cast("string")).alias("text"))
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    block = max(1, shard_rows // 16)
    # equal rows are combined before the shuffle, then dealt out again in blocks
    every = rows.groupBy("doc_id", "units", "text").agg(F.count("*").alias("n"))
    every = every.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("block"))
    every = every.withColumn("order", F.xxhash64(F.lit("pack"), "doc_id", "units", "text", "block")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("long"))
    every = every.select("doc_id", "units", "order", "shard", F.least(F.lit(block), F.col("n") - F.col("block") * block).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "doc_id", "units"], kind="stable", na_position="first")
        pdf = pdf.loc[pdf.index.repeat(pdf["n"])]
        placed, _ = pack(pdf["units"].tolist(), capacity, open_bins)
        item, start, size, own = (np.array(x, np.int64) for x in zip(*placed))
        return pd.DataFrame({"bin_id": own * shards + int(pdf["shard"].iloc[0]), "doc_id": pdf["doc_id"].astype("Int64").array[item], "start": start, "units": size})

    return every.groupBy("shard").applyInPandas(run, "bin_id long, doc_id long, start long, units long")
