"""Fuzzy matching: similarity, thresholds, edit distance, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_LENGTH = 4


def jaccard(common: Column, left: Column, right: Column) -> Column:
    """Similarity from the numbers of common, left and right n-grams; 0 where a side is empty."""
    return F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(common / (left + right - common))


def ngram_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def adaptive_threshold(length: Column, base: float) -> Column:
    """Shorter terms get by with less similarity."""
    return (
        F.when(length <= 2, F.lit(max(0.10, base * 0.4)))
        .when(length == 3, F.lit(max(0.15, base * 0.6)))
        .when(length == 4, F.lit(max(0.20, base * 0.8)))
        .when(length <= 6, F.lit(max(0.25, base * 0.8)))
        .otherwise(F.lit(float(base)))
    )


def adaptive_distance(length: Column, most: int) -> Column:
    return F.when(length <= 3, F.lit(min(1, most))).otherwise(F.lit(most))


def byte_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over UTF-8 bytes."""
    return F.levenshtein(*(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b)))


def is_prefix(term: Column, candidate: Column) -> Column:
    return (F.char_length(term) >= PREFIX_LENGTH) & (F.char_length(term) < F.char_length(candidate)) & candidate.startswith(term)


def is_close(term: Column, candidate: Column, most: int) -> Column:
    return is_prefix(term, candidate) | (byte_distance(term, candidate) <= adaptive_distance(F.char_length(term), most))


def confidence(term: Column, candidate: Column, similarity: Column) -> Column:
    a, b = F.char_length(term), F.char_length(candidate)

    def clamp(x: Column, high: float) -> Column:
        return F.greatest(F.lit(0.25), F.least(F.lit(high), x))

    return (
        F.when(term == candidate, F.lit(1.0))
        .when(is_prefix(term, candidate), clamp(F.lit(0.5) * (a / b) + F.lit(0.5) * similarity, 0.45))
        .otherwise(clamp(F.lit(0.6) * (F.lit(1.0) - byte_distance(term, candidate) / F.greatest(a, b)) + F.lit(0.4) * similarity, 0.6))
    )


def wants_fuzzy(length: Column, has_exact: Column) -> Column:
    return (length >= 3) & (~has_exact | (length >= 5))
