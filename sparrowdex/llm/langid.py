"""Language identification in two steps: the family first, then the language in it.

Features of a text are its hashed runs of one to three bytes (letters folded to
lower case where ASCII, everything that is not part of a word folded to one space),
as square roots of relative frequencies scaled to length 1. A family is chosen by
linear support vector machines, one for each pair of families; inside it, one for
each pair of its languages. A pair's winner gets a vote; ties go to the larger sum
of margins, then to the name that sorts first.

The machines (squared hinge loss, L2 penalty) are fitted in numpy on at most
`max_train` documents whose language is given, chosen by a hash of the id, in equal
shares by language as far as there are any. They are the only thing broadcast; their
size depends on the number of languages alone, of which the `max_languages` with the
most ids are learned. A language that `families` doesn't name is a family of its own.

Defined results: a null, empty or wordless text has no language (nulls); texts of any
length are read whole. Documents with a null id or language aren't trained on; those
that share an id and a language count as one (the least text). Every row, repeated
or not, is judged by its own text. If fewer than two languages can be trained, the one
there is is returned for every text, or null; so after an empty table. Equal hashes of
ids are settled by the id. Extra columns are never read."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tokens import LOWER, U, WORDS, chunks, mix

DIM, MAX_TRAIN, MAX_LANGUAGES, PENALTY, ROUNDS = 2048, 4000, 64, 1e-4, 150
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}


def features(data: np.ndarray, offs: np.ndarray, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(n, dim) unit vectors in float32, and whether a text has any word byte."""
    n = len(offs) - 1
    out = np.zeros((n, dim), np.float32)
    word = WORDS[data] > 0
    folded = np.where(word, LOWER[data], U(0))
    doc = np.repeat(np.arange(n), np.diff(offs))
    some = np.bincount(doc[word], minlength=n) > 0 if len(data) else np.zeros(n, bool)
    for lo in range(0, n, 512):
        hi = min(n, lo + 512)
        a, b = offs[lo], offs[hi]
        f, d = folded[a:b], doc[a:b] - lo
        acc = np.zeros((hi - lo) * dim)
        for size in (1, 2, 3):
            if len(f) < size:
                break
            x = np.full(len(f) - size + 1, size, U)
            for k in range(size):
                x = x * U(257) + f[k : len(f) - size + 1 + k]
            ok = d[: len(x)] == d[size - 1 :]
            if size > 1:  # runs of separators alone say nothing
                ok &= (f[: len(x)] > 0) | (f[size - 1 :] > 0)
            else:
                ok &= f > 0
            key = d[: len(x)] * dim + (mix(x * U(0x9E3779B97F4A7C15)) >> U(20)).astype(np.int64) % dim
            acc += np.bincount(key[ok], minlength=len(acc))
        acc = np.sqrt(acc.reshape(-1, dim))
        out[lo:hi] = acc / np.maximum(np.linalg.norm(acc, axis=1, keepdims=True), 1e-12)
    return out, some


def machine(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear SVM for y in (-1, 1), classes weighted equally:
    accelerated gradient descent on the squared hinge loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = last = np.zeros(x.shape[1])
    step = 1 / (penalty + 2 * 2 * 1.0)  # rows have squared length 2, the class weights sum to 1
    for k in range(rounds):
        v = w + k / (k + 3) * (w - last)
        slack = np.maximum(0, 1 - y * (x @ v))
        last, w = w, v - step * (penalty * v - 2 * x.T @ (c * slack * y))
    return w[:-1], float(w[-1])


class OneVersusOne:
    def __init__(self, x: np.ndarray, names: np.ndarray):
        self.names = sorted(set(names.tolist()))
        self.pairs = []
        rows = []
        for a, b in combinations(range(len(self.names)), 2):
            mask = (names == self.names[a]) | (names == self.names[b])
            w, bias = machine(x[mask], np.where(names[mask] == self.names[a], 1.0, -1.0))
            self.pairs.append((a, b))
            rows.append(np.append(w, bias))
        self.w = np.array(rows).T if rows else np.zeros((x.shape[1] + 1, 0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its mean margin over its pairs)"""
        n, k = len(x), len(self.names)
        m = x.astype(np.float64) @ self.w[:-1] + self.w[-1]
        votes, margin = np.zeros((n, k)), np.zeros((n, k))
        for j, (a, b) in enumerate(self.pairs):
            votes[:, a] += m[:, j] >= 0
            votes[:, b] += m[:, j] < 0
            margin[:, a] += m[:, j]
            margin[:, b] -= m[:, j]
        best = np.lexsort((np.tile(-np.arange(k), (n, 1)), margin, votes), axis=1)[:, -1] if n else np.zeros(0, np.int64)
        return best, margin[np.arange(n), best] / max(1, k - 1)


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, str]):
        own = np.array([families.get(v, v) for v in langs.tolist()], dtype=object)
        self.family = OneVersusOne(x, own) if len(x) else None
        self.within = [OneVersusOne(x[own == f], langs[own == f]) for f in self.family.names] if self.family else []

    def predict(self, column) -> tuple[list, list, np.ndarray]:
        n = len(column)
        family, lang, margin = [None] * n, [None] * n, np.full(n, np.nan)
        if self.family is None:
            return family, lang, margin
        for lo, hi, data, offs in chunks(column):
            x, some = features(data, offs)
            f, _ = self.family.predict(x)
            for k, m in enumerate(self.within):
                rows = np.flatnonzero((f == k) & some)
                best, own = m.predict(x[rows])
                margin[lo + rows] = own
                for r, b in zip(rows.tolist(), best.tolist()):
                    family[lo + r], lang[lo + r] = self.family.names[k], m.names[b]
        return family, lang, margin


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, families: dict[str, str] | None = None, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    families = FAMILIES if families is None else families
    known = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and id is not null")
    order = F.xxhash64(F.lit("lang"), "id")
    # by its number of ids (a sketch, within some 5 %), a language is thinned to little more than max_train
    # before the exact choice, so that no task gets all of it
    want = 1.3 * max_train + 8 * max_train**0.5 + 8
    share = F.lit(0.0)
    for r in known.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect():
        share = F.when(F.col("lang") == r["lang"], want / max(1, r["n"])).otherwise(share)
    thin = known.filter(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).distinct()
    by_hash = [F.pmod(order, F.lit(1 << 30)), order, F.col("id")]
    ids = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*by_hash))).filter(F.col("n") <= max_train)
    chosen = ids.orderBy("n", order, "id", "lang").limit(max_train).select("id", "lang")  # bounded: may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(2)):
                x, some = features(data, offs)
                ok = pa.array(some)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].filter(ok), batch.column(1)[lo:hi].filter(ok), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary()).filter(ok)], names=["id", "lang", "x"])

    # one text for each chosen id, before anything is collected
    once = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    found = once.select("id", "lang", "text").mapInArrow(run, "id long, lang string, x binary").collect()
    found.sort(key=lambda r: (r["id"], r["lang"]))
    x = np.array([np.frombuffer(bytes(r["x"]), "<f2") for r in found], np.float32).reshape(len(found), DIM)
    return LanguageModel(x, np.array([r["lang"] for r in found], dtype=object), families)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, predicted, margin) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            family, lang, margin = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(family, pa.string()), pa.array(lang, pa.string()), pa.array(margin, from_pandas=True)], names=["doc_id", "family", "predicted", "margin"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, family string, predicted string, margin double")
