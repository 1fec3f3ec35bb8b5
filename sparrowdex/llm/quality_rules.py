"""Quality rules by distribution divergence.

A document's histogram of character classes (a-z, A-Z, 0-9, ASCII white space,
other ASCII, non-ASCII) and its histogram over its language's common words (and one
class for the rest) are compared to those of all documents of the language by
Jensen-Shannon distance (square root of the divergence in base 2, so 0 to 1). A
document fails where a distance exceeds limit + slack / sqrt(n) for n characters or
words (the distance of a sample from its own distribution shrinks like that), but only
if n is at least `min_chars` or `min_words`: shorter texts are too noisy to judge.

Words are runs of ASCII letters, digits and non-ASCII characters; ASCII letters are
folded. A word is common in a language if at least `common` of the language's words
are it. The first pass summarises each task's words in a few counters that lose no word
of that share (`_heavy`), beside the histograms of character classes; the second counts
those candidates everywhere: exact counts over all documents without shuffling the
vocabulary, and of a fixed size however many documents there are.

What a task holds is one counter for each language's candidate words and, for a piece
of its texts, the words that occur in each: neither grows with languages x words. The
references of `at_once` languages are broadcast together, those with the most documents
first; their size is bounded by 4 / `common` words a language. Where there are more
languages, the rows of the rest are written in sets of about as many languages, and each
set is judged in the same way on its own: every language has a reference, and no step
holds more than a set of them. `max_languages`, where a caller gives it, leaves only so
many a reference.

Defined results: a null, empty or wordless text has null distances (the distance of its
characters where it has any) and is kept; texts of any length are read whole. Null and
'' are one language. A document in a language without a reference has null distances
and is kept. Every row, repeated or not, is judged by its own text and language, and
counts once in its language's reference, so equal texts have equal results. Ids are
passed through, null ones too. Empty tables give no rows; extra columns are never read."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._heavy import Heavy, merged, partitions
from ._tokens import Tokens, chunks, hash_words
from ._work import Workspace

COMMON, MIN_CHARS, MIN_WORDS, AT_ONCE = 0.004, 200, 50, 256
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK = 0.15, 1.5, 0.28, 0.8
CLASSES = ["lower", "upper", "digit", "space", "punct", "other"]
_class = np.full(256, 6, np.int64)  # 6: continuation bytes, not counted
_class[:128] = 4
for _lo, _hi, _c in ((97, 123, 0), (65, 91, 1), (48, 58, 2), (9, 14, 3), (32, 33, 3), (192, 256, 5)):
    _class[_lo:_hi] = _c
_ascii_lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def classes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(offs))
    return np.bincount(doc * 7 + _class[data], minlength=n * 7).reshape(n, 7)[:, :6]


def _word(data: np.ndarray, t: Tokens, k: int) -> bytes:
    return data[t.start[k] : t.end[k]].tobytes().translate(_ascii_lower)


class _Langs:
    """Numbers of language names, in the order of first sight."""

    def __init__(self):
        self.names: dict[str, int] = {}

    def codes(self, column) -> np.ndarray:
        return np.array([self.names.setdefault(v or "", len(self.names)) for v in column.to_pylist()], np.int64)


_FIELDS = "lang string, n long, chars array<long>, items binary, counts binary, words array<string>"


def _candidates(size: int):
    """Per task and language: character classes, number of words, and a summary of the words' uses."""

    def run(batches):
        langs = _Langs()
        chars: dict[int, np.ndarray] = {}
        words: dict[int, Heavy] = {}
        for batch in batches:
            code = langs.codes(batch.column(1))
            for lo, hi, data, offs in chunks(batch.column(0)):
                own, c, t = code[lo:hi], classes(data, offs), Tokens(data, offs)
                of = own[t.doc] if len(t.doc) else np.zeros(0, np.int64)
                for k in np.unique(own).tolist():
                    chars[k] = chars.get(k, 0) + c[own == k].sum(axis=0)
                    at = np.flatnonzero(of == k)
                    h, first, n = np.unique(t.hash[at], return_index=True, return_counts=True)
                    words.setdefault(k, Heavy(size)).add(h, n, lambda new: [_word(data, t, at[f]).decode("utf-8", "replace") for f in first[new]])
        if chars:
            rows = [(name, words[k].total, chars[k].tolist(), words[k].item.tobytes(), words[k].count.tobytes(), words[k].word.tolist()) for name, k in langs.names.items() if k in chars]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "n", "chars", "items", "counts", "words"])

    return run


def _merge(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heavy = Heavy(size)
        for n, i, c, w in zip(pdf["n"], pdf["items"], pdf["counts"], pdf["words"]):
            heavy.merge(np.frombuffer(i, np.uint64), np.frombuffer(c, np.int64), np.array(w, object), int(n))
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "n": [heavy.total], "chars": [np.sum(np.stack(pdf["chars"].tolist()), axis=0)], "items": [heavy.item.tobytes()], "counts": [heavy.count.tobytes()], "words": [heavy.word.tolist()]})

    return run


def frequent(rows: DataFrame, run, size: int) -> list:
    """One row of _FIELDS for each language, from a pass that emits them for each task."""
    return merged(rows.mapInArrow(run, _FIELDS), "lang", _FIELDS, _merge(size), partitions(rows)).collect()


class Reference:
    """Character classes of each language, and the uses of its common words: entry j is a
    word of language lang[j], found by the key of both."""

    def __init__(self, chars: dict[str, list[int]], total: dict[str, int], words: dict[str, dict[int, int]]):
        self.langs = {name: k for k, name in enumerate(sorted(chars))}
        self.chars = np.array([chars[x] for x in sorted(chars)], float).reshape(-1, 6)
        every = [(self.langs[x], h, n) for x, own in words.items() for h, n in own.items()]
        lang, h, n = (np.array([e[c] for e in every], t) for c, t in ((0, np.int64), (1, np.uint64), (2, np.int64)))
        key = lang_key(lang, h)
        order = np.argsort(key)
        self.key, self.lang, self.hash, self.uses = key[order], lang[order], h[order], n[order]
        self.total = np.array([total[x] for x in sorted(chars)], float)

    def codes(self, column) -> np.ndarray:
        """Numbers of languages, -1 for one without a reference."""
        return np.array([self.langs.get(v, -1) for v in column.to_pylist()], np.int64)

    def hits(self, t: Tokens, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, entry) of each token that is a word of its document's language."""
        if not len(self.key) or not len(t.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = lang_key(lang[t.doc], t.hash)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        ok = (self.key[at] == k) & (lang[t.doc] >= 0)
        return t.doc[ok], at[ok]

    def distances(self, data, offs, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(characters, words, character distance, word distance) of documents with language numbers."""
        t, n = Tokens(data, offs), len(offs) - 1
        c = classes(data, offs)
        n_words = t.counts() if len(t.doc) else np.zeros(n, np.int64)
        d, entry = self.hits(t, lang)
        key, uses = np.unique(d * max(1, len(self.key)) + entry, return_counts=True)
        d, entry = key // max(1, len(self.key)), key % max(1, len(self.key))
        # words of the language that the text doesn't use add half their share to the divergence, as q log2(q / (q / 2)) = q
        total = np.maximum(self.total, 1)[lang] if len(self.total) else np.ones(n)
        p, q = uses / np.maximum(n_words, 1)[d], self.uses[entry] / total[d]
        common = np.bincount(self.lang, weights=self.uses, minlength=len(self.total))
        rest = (common / np.maximum(self.total, 1))[lang] - np.bincount(d, weights=q, minlength=n) if len(self.total) else np.zeros(n)
        other_p = 1 - np.bincount(d, weights=p, minlength=n)
        other_q = 1 - (common / np.maximum(self.total, 1))[lang] if len(self.total) else np.zeros(n)
        js = np.bincount(d, weights=_part(p, q), minlength=n) + rest + _part(other_p, other_q)
        known = (lang >= 0) & (n_words > 0) & (self.total[lang] > 0 if len(self.total) else False)
        chars = js_distance(c, self.chars[lang]) if len(self.chars) else np.full(n, np.nan)
        return c.sum(axis=1), n_words, np.where(lang >= 0, chars, np.nan), np.where(known, np.sqrt(np.maximum(js / 2, 0)), np.nan)


def lang_key(lang: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit key for a word in a language."""
    return h ^ ((lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _part(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What a class with shares p and q adds to twice the divergence."""
    p, q = np.where(p > 1e-15, p, 0), np.where(q > 1e-15, q, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = (p + q) / 2
        return np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rowwise Jensen-Shannon distance of two histograms; nan where one is empty."""
    sp, sq = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt(np.maximum(_part(np.nan_to_num(p / sp), np.nan_to_num(q / sq)).sum(axis=1) / 2, 0))
    return np.where((sp[:, 0] > 0) & (sq[:, 0] > 0), out, np.nan)


def reference(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: float = COMMON, max_languages: int | None = None) -> Reference:
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    if max_languages is not None:
        most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages + 1).collect()
        if len(most) > max_languages:  # else every language has a reference
            rows = rows.filter(F.col("lang").isin([r["lang"] for r in most[:max_languages]]))
    size = int(4 / common)  # a word with the share `common` is kept by a summary of 1 / common counters already
    first = frequent(rows, _candidates(size), size)
    chars = {r["lang"]: list(r["chars"]) for r in first}
    total = {r["lang"]: r["n"] for r in first}
    start = Reference(chars, total, {r["lang"]: {int(h): 1 for h in hash_words(r["words"])} for r in first})
    shared = docs.sparkSession.sparkContext.broadcast(start)

    def count(batches):
        ref = shared.value
        acc = np.zeros(len(ref.key), np.int64)
        for batch in batches:
            lang = ref.codes(batch.column(1))
            for lo, hi, data, offs in chunks(batch.column(0)):
                acc += np.bincount(ref.hits(Tokens(data, offs), lang[lo:hi])[1], minlength=len(acc))
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(acc[at])], names=["entry", "n"])

    words: dict[str, dict[int, int]] = {x: {} for x in chars}
    names = sorted(chars)
    for r in rows.mapInArrow(count, "entry long, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect():
        name = names[start.lang[r["entry"]]]
        if r["n"] >= common * total[name]:
            words[name][int(start.hash[r["entry"]])] = r["n"]
    shared.destroy()
    return Reference(chars, total, words)


def divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: float = COMMON, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, char_slack: float = CHAR_SLACK, word_limit: float = WORD_LIMIT, word_slack: float = WORD_SLACK, max_languages: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(doc_id, n_chars, n_words, char_distance, word_distance, keep) of every row, distances rounded to 6 digits."""
    spark = docs.sparkSession

    def run(shared, batches):
        ref = shared.value
        for batch in batches:
            lang = ref.codes(batch.column(2))
            for lo, hi, data, offs in chunks(batch.column(1)):
                chars, words, cd, wd = ref.distances(data, offs, lang[lo:hi])
                cd, wd = np.round(cd, 6), np.round(wd, 6)
                with np.errstate(invalid="ignore"):
                    keep = ~((chars >= min_chars) & (cd > char_limit + char_slack / np.sqrt(np.maximum(chars, 1))) | (words >= min_words) & (wd > word_limit + word_slack / np.sqrt(np.maximum(words, 1))))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(chars), pa.array(words), pa.array(cd, from_pandas=True), pa.array(wd, from_pandas=True), pa.array(keep)], names=["doc_id", "n_chars", "n_words", "char_distance", "word_distance", "keep"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))

    def judged(own: DataFrame, shared) -> DataFrame:
        return own.mapInArrow(partial(run, shared), "doc_id long, n_chars long, n_words long, char_distance double, word_distance double, keep boolean")

    first = reference(docs, text_col, lang_col, common, at_once if max_languages is None else max_languages)
    shared = spark.sparkContext.broadcast(first)
    if max_languages is not None or len(first.langs) < at_once:
        return judged(rows, shared)
    known = F.col("lang").isin(list(first.langs))
    n = rows.filter(~known).select("lang").distinct().count()
    if not n:
        return judged(rows, shared)
    work, sets = Workspace(spark, "languages"), -(-n // at_once)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // sets)  # tasks that a set's rows are written by
    rest = rows.filter(~known).withColumn("part", F.pmod(F.xxhash64("lang"), F.lit(sets)).cast("int"))
    rest = work.save(rest.repartition(F.col("part"), F.pmod(F.xxhash64("text", "doc_id"), F.lit(spread))), "rest", ["part"])
    out = judged(rows.filter(known), shared)
    for k in range(sets):
        own = rest.filter(F.col("part") == k).drop("part")
        held = spark.sparkContext.broadcast(reference(own, common=common))
        out = out.union(work.save(judged(own, held), f"set{k}"))
        held.destroy()
    work.drop(rest)
    return out


_N = {"lower": "[^a-z]", "upper": "[^A-Z]", "digit": "[^0-9]", "space": r"[^ \t-\r]", "other": r"[\x00-\x7f]"}
_JS = "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))"
SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
chars AS (
  SELECT doc_id, lang, length(text) AS n_chars, {', '.join(f"length(regexp_replace(text, '{r}', '', 'g')) AS {c}" for c, r in _N.items())} FROM docs
), char_hist AS (
  SELECT doc_id, lang, n_chars, unnest(['lower', 'upper', 'digit', 'space', 'other', 'punct']) AS class,
         unnest([lower, upper, digit, space, other, n_chars - lower - upper - digit - space - other]) AS n FROM chars
), char_ref AS (
  SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM char_hist GROUP BY lang, class
), char_js AS (
  SELECT doc_id, n_chars, CASE WHEN n_chars > 0 THEN round({_JS}, 6) END AS char_distance
  FROM (SELECT h.doc_id, h.n_chars, h.n / h.n_chars AS p, r.q FROM char_hist h JOIN char_ref r USING (lang, class)) GROUP BY doc_id, n_chars
), words AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS word FROM docs
), word_counts AS (
  SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS total FROM words GROUP BY lang, word
), common AS (
  SELECT lang, word, n / total AS q FROM word_counts WHERE n >= {COMMON}::DOUBLE * total
), word_ref AS (
  SELECT * FROM common UNION ALL SELECT lang, NULL, 1 - coalesce(sum(q), 0) FROM (SELECT DISTINCT lang FROM word_counts) LEFT JOIN common USING (lang) GROUP BY lang
), per_doc AS (
  SELECT doc_id, lang, count(*) AS n_words FROM words GROUP BY doc_id, lang
), hits AS (
  SELECT doc_id, lang, word, count(*) AS n FROM words JOIN common USING (lang, word) GROUP BY doc_id, lang, word
), word_hist AS (
  SELECT d.doc_id, d.n_words, r.q, CASE WHEN r.word IS NULL THEN d.n_words - coalesce((SELECT sum(n) FROM hits WHERE hits.doc_id = d.doc_id), 0) ELSE coalesce(h.n, 0) END / d.n_words AS p
  FROM per_doc d JOIN word_ref r USING (lang) LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.word = r.word
), word_js AS (
  SELECT doc_id, n_words, round({_JS}, 6) AS word_distance FROM word_hist GROUP BY doc_id, n_words
)
SELECT doc_id, n_chars, coalesce(n_words, 0) AS n_words, char_distance, word_distance,
       NOT (n_chars >= {MIN_CHARS} AND coalesce(char_distance > {CHAR_LIMIT}::DOUBLE + {CHAR_SLACK}::DOUBLE / sqrt(greatest(n_chars, 1)), false) OR coalesce(n_words, 0) >= {MIN_WORDS} AND coalesce(word_distance > {WORD_LIMIT}::DOUBLE + {WORD_SLACK}::DOUBLE / sqrt(greatest(coalesce(n_words, 0), 1)), false)) AS keep
FROM char_js LEFT JOIN word_js USING (doc_id)
"""
