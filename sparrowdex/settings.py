"""Validated settings of an index and its searches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Ranges are checked on construction; connection settings of external stores
    are the options of the Spark reader or writer that is used, so there are none here."""

    enabled: bool = True
    store: str = "parquet"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    title_boost: float = 5.0
    exact_boost: float = 3.0
    ngram_sizes: tuple[int, ...] = (1, 2, 3)
    similarity_threshold: float = 0.25
    max_candidates: int = 100
    max_distance: int = 2

    def __post_init__(self):
        for name, low, high in (
            ("bm25_k1", 0.1, 5.0), ("bm25_b", 0.0, 1.0), ("title_boost", 1.0, 20.0), ("exact_boost", 1.0, 20.0),
            ("similarity_threshold", 0.0, 1.0), ("max_candidates", 10, 1000), ("max_distance", 0, 10),
        ):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if not self.ngram_sizes or any(not 1 <= n <= 5 for n in self.ngram_sizes):
            raise ValueError("ngram_sizes must be one or more sizes from 1 to 5")
        if self.store not in ("parquet", "memory", "jdbc"):
            raise ValueError(f"unknown store: {self.store}")


DEFAULT = Settings()
