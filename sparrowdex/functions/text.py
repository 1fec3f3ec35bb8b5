"""Tokens, stop words and n-grams."""

from __future__ import annotations

import string
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


@cache
def stop_words() -> tuple[str, ...]:
    path = Path(__file__).resolve().parent.parent / "resources" / "stopwords_en.txt"
    return tuple(path.read_text(encoding="utf-8").split())


def fold_case(text: Column) -> Column:
    """Lower case for ASCII letters only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokenize(text: Column) -> Column:
    """Letter and digit runs in order, with repeats; a lone "0" is dropped."""
    parts = F.split(F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), TOKEN_BREAK, " "), " ")
    return F.filter(parts, lambda t: ~t.isin("", "0"))


def is_stop_word(term: Column) -> Column:
    return term.isin(*stop_words())


def remove_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_stop_word(t))


def only_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, is_stop_word)


def query_tokens(tokens: Column) -> Column:
    """Stop words go unless nothing else is left."""
    kept = remove_stop_words(tokens)
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def ngrams(term: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct character n-grams of the term with a space at either end."""
    padded = F.concat(F.lit(" "), term, F.lit(" "))

    def slide(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(padded) - (n - 1))
        # sequence() counts down when its end is below its start: guard short terms
        return F.when(F.char_length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = [slide(n) for n in sizes]
    return F.array_distinct(F.filter(F.concat(*grams), lambda g: F.trim(g) != ""))


def query_tokens_of(spark: SparkSession, query: str) -> list[str]:
    """Tokens of one query, as `query_tokens(tokenize(...))` gives them, without a job: by the
    regular expressions of the JVM, whose classes of letters and digits the index was made with."""
    folded = query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    parts = spark.sparkContext._jvm.java.util.regex.Pattern.compile(TOKEN_BREAK).matcher(folded).replaceAll(" ").split(" ")
    tokens = [t for t in parts if t not in ("", "0")]
    stop = set(stop_words())
    return [t for t in tokens if t not in stop] or tokens


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers and strings as literals of the plan: no job and no Python worker reads them."""

    def one(x: object) -> str:
        if isinstance(x, str):
            return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{x!r}D" if isinstance(x, float) else str(x)

    fields = [f.split() for f in schema.split(", ")]
    values = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in fields)} FROM VALUES {values} AS v({', '.join(n for n, _ in fields)})")


def query_text(query: object) -> str:
    """A query as its string: of an object with a `query`, that; of nothing, ""."""
    query = getattr(query, "query", query)
    return "" if query is None else str(query)


def has_query(query: object) -> bool:
    """Whether there is anything to search for: neither "" nor "0"."""
    return query_text(query) not in ("", "0")


def deletions(term: Column, most: int) -> Column:
    """Hashes of the byte strings that are left when up to `most` bytes of the term are taken
    out. Strings at most `most` edits apart have one in common; not all that do are so close."""
    b = F.decode(F.encode(term, "UTF-8"), "ISO-8859-1")

    def without_one(x: Column) -> Column:
        n = F.char_length(x)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n)))).otherwise(F.array().cast("array<string>"))

    every = last = F.array(b)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, without_one)))
        every = F.concat(every, last)
    return F.array_distinct(F.transform(every, lambda x: F.xxhash64(x)))
