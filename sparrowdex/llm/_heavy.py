"""Frequent items in bounded space, and merging of what tasks emit, level by level.

`Heavy` is the mergeable summary of Misra and Gries (Agarwal et al. 2012): at most
`size` counters, each too low by at most total / (size + 1). An item that occurs more
often than that, over all tasks together, is always among those kept: no frequent item
is lost, and what reaches the driver doesn't grow with the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGE = 64  # rows that one call of a merge gets at most


class Heavy:
    """Counters of 64-bit items, sorted by item, with a spelling for each."""

    def __init__(self, size: int):
        self.size, self.total = size, 0
        self.item, self.count, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, item: np.ndarray, count: np.ndarray, spell: Callable[[np.ndarray], list]) -> None:
        """Adds distinct items; `spell` gives the spellings of those at the given places."""
        self._merge(item, count, spell, int(count.sum()))

    def merge(self, item: np.ndarray, count: np.ndarray, words: np.ndarray, total: int) -> None:
        """Adds another summary of `total` uses."""
        self._merge(item, count, lambda at: words[at], total)

    def _merge(self, item, count, spell, total) -> None:
        self.total += total
        have = len(self.item)
        every, n = np.concatenate([self.item, item]), np.concatenate([self.count, count])
        order = np.argsort(every, kind="stable")  # of equal items, the one that is spelled already comes first
        every = every[order]
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        n, at = (np.add.reduceat(n[order], start) if len(start) else n), order[start]
        if len(start) > self.size:
            n = n - np.partition(n, len(n) - self.size - 1)[len(n) - self.size - 1]
        keep = n > 0
        at = at[keep]
        word = np.empty(len(at), object)
        old = at < have
        word[old] = self.word[at[old]]
        word[~old] = spell(at[~old] - have)
        self.item, self.count, self.word = every[start][keep], n[keep], word


def merged(parts: DataFrame, key: str, schema: str, merge: Callable[[pd.DataFrame], pd.DataFrame], n_parts: int) -> DataFrame:
    """`parts` merged to one row for each key. Up to MERGE tasks' rows meet in one call, then
    up to MERGE of the results, and so on: no call's memory grows with the number of tasks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf).assign(part=pdf["part"].iloc[0] // MERGE)

    out = parts.withColumn("part", F.spark_partition_id().cast("long"))
    while n_parts > MERGE:
        out = out.groupBy(key, F.floor(F.col("part") / MERGE).alias("into")).applyInPandas(one, f"{schema}, part long")
        n_parts = -(-n_parts // MERGE)
    # by the key alone: one row is left for each even if there were more tasks than thought
    return out.drop("part").groupBy(key).applyInPandas(merge, schema)


def partitions(df: DataFrame) -> int:
    """Number of partitions that a scan is planned with. It only sets the number of levels in
    `merged`; for a DataFrame with a shuffle in it, that shuffle runs to find it."""
    return df.rdd.getNumPartitions()
