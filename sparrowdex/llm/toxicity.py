"""Toxicity by lexicon induction: random walks over a word graph.

For each language a graph joins the words that at least `min_share` of its documents
use (the background of ordinary words) and, however few documents use them, the words
in toxic company: those that labelled toxic documents, or places within `window` tokens
of a toxic seed, hold more often than chance explains, by signed root of the likelihood
ratio (at least `seed_z`, as for seeds). An edge's weight is the positive pointwise mutual information of its two words
within `window` tokens of each other, counted over all documents. Walks that restart
at labelled seed terms, toxic ones in one run and clean ones in another, settle on
two distributions t and c over the words; a word's polarity is how much more the
toxic walk visits it: (t - c) / (t + c + 2 r), from -1 to 1, where r is the share of
a walk without seeds, so that rarely visited words stay near 0. Words above `cut`
form the induced lexicon. A document's score is the polarity of its lexicon words'
uses, summed, over the square root of its number of tokens; it is toxic where the
score exceeds `limit` and its different lexicon words' polarities (the evidence) sum
to at least `evidence`.

Seed terms are given by language, or come from labelled documents: the terms whose
share among toxic ones most exceeds that among clean ones, by signed root of the likelihood ratio
(toxic seeds, at least `seed_z`), and the most used terms with no such excess (clean
seeds). Every term of the labelled toxic documents is tried as a toxic seed. At most
`max_labelled` labelled ids of either kind are used, chosen by a hash of the id. Given
seed terms are cut into tokens like texts, each of which is a seed; one that isn't
found in its language has no effect.

Frequent words are found without shuffling the vocabulary: one pass keeps a summary of
bounded size that loses no word of that share (`_heavy`), the next counts its words
exactly. Their co-occurrence counts are dense blocks, compressed and
summed level by level; with more than `max_cells` cells they take several passes over the texts.
The words in toxic company come from exact counts of all words, summed by a shuffle; their
co-occurrence counts are sparse and summed by another. What reaches the driver depends on
`min_share`, the number of languages, and the words in toxic company with their pairs.
A word that only goes with words in toxic company, never with a seed or in a labelled toxic
document, joins the graph only if it is frequent; one that two or three documents use can't
reach `seed_z` unless toxic company is very rare.

Defined results: null, empty or tokenless texts score 0 and aren't toxic; texts of any
length are read whole. Null and '' are one language. Without seeds of either kind, a
language's lexicon is empty. Labels that are null or contradict each other are ignored.
Every row, repeated or not, counts and is scored by its own text and language, with its id
passed through, null ones too. Equal scores of seeds are settled by the order of the
words. Empty tables give an empty lexicon and no rows; extra columns are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._heavy import Heavy, merged, partitions
from ._tokens import Tokens, chunks, hash_words, mix
from ._work import Workspace
from .quality_rules import _Langs, _word, frequent

MIN_SHARE, WINDOW, MAX_CELLS, MAX_LABELLED = 0.012, 10, 24_000_000, 10_000
SEEDS, SEED_Z, RESTART, STEPS, DOUBT, PRIOR = 12, 4.5, 0.15, 60, 0.5, 2.0
CUT, EVIDENCE, LIMIT = 0.2, 0.5, 0.03
COUNTERS = 1 << 15  # in the summary of a language's words
ROWS = 256  # words in a block of the co-occurrence counts
RARE_DOUBT = 1.5  # DOUBT for pairs with a rare word: one or two meetings are chance there too
HELD = 1 << 20  # words or pairs that a task sums before it hands them on


def _key(lang: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit key for a word in a language."""
    return h ^ ((lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _once(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens sorted by a 64-bit key of their document and word, and where each key starts: one sort, in no order that matters."""
    key = mix(t.hash ^ (t.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _frequent(size: int):
    """Per task and language: number of documents, and a summary of the documents each word is in."""

    def run(batches):
        langs, docs, words = _Langs(), {}, {}
        for batch in batches:
            code = langs.codes(batch.column(1))
            for lo, hi, data, offs in chunks(batch.column(0)):
                own, t = code[lo:hi], Tokens(data, offs)
                order, start = _once(t)
                order = order[start]
                d, h = t.doc[order], t.hash[order]
                for k, n in zip(*np.unique(own, return_counts=True)):
                    docs[int(k)] = docs.get(int(k), 0) + int(n)
                    at = np.flatnonzero(own[d] == k)
                    x, first, m = np.unique(h[at], return_index=True, return_counts=True)
                    words.setdefault(int(k), Heavy(size)).add(x, m, lambda new: [_word(data, t, order[at[f]]).decode("utf-8", "replace") for f in first[new]])
        if docs:
            rows = [(name, words[k].total, [docs[k]], words[k].item.tobytes(), words[k].count.tobytes(), words[k].word.tolist()) for name, k in langs.names.items() if k in docs]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "n", "chars", "items", "counts", "words"])

    return run


def candidates(rows: DataFrame, min_share: float, counters: int = COUNTERS) -> tuple[dict[str, int], dict[str, list[str]]]:
    """(documents, words) by language; no word that `min_share` of the documents use is missing.

    A summary's counters are too low by at most what they lost in all / (counters + 1).
    Should that reach the share asked for (documents of very many different words), the
    pass is repeated with as many counters as it takes."""
    while True:
        first = frequent(rows, _frequent(counters), counters)
        docs = {r["lang"]: r["chars"][0] for r in first}
        count = {r["lang"]: np.frombuffer(r["counts"], np.int64) for r in first}
        slack = {r["lang"]: (r["n"] - int(count[r["lang"]].sum())) / (counters + 1) for r in first}
        if all(slack[x] < min_share * docs[x] for x in docs):
            break
        counters = max(int(r["n"] / (min_share * docs[r["lang"]])) + 1 for r in first)
    return docs, {r["lang"]: [w for w, c in zip(r["words"], count[r["lang"]]) if c + slack[r["lang"]] >= min_share * docs[r["lang"]]] for r in first}


class Vocabulary:
    """Words by language, numbered in one range: those of language k are [start[k], start[k + 1])."""

    def __init__(self, words: dict[str, list[str]]):
        self.langs = {x: k for k, x in enumerate(sorted(words))}
        self.words = [w for x in self.langs for w in words[x]]
        sizes = [len(words[x]) for x in self.langs]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.lang = np.repeat(np.arange(len(sizes)), sizes)
        key = _key(self.lang, hash_words(self.words))
        self.order = np.argsort(key)
        self.key = key[self.order]

    def numbers(self, t: Tokens, lang: np.ndarray) -> np.ndarray:
        """Number of each token's word, -1 if it isn't in the vocabulary of the document's language."""
        if not len(self.key) or not len(t.hash):
            return np.full(len(t.hash), -1, np.int64)
        k = _key(lang[t.doc], t.hash)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where(self.key[at] == k, self.order[at], -1)


def _codes(vocabulary: Vocabulary, column) -> np.ndarray:
    return np.array([vocabulary.langs[v] for v in column.to_pylist()], np.int64)


def _pairs(doc: np.ndarray, number: np.ndarray, window: int):
    """Pairs of vocabulary words at most `window` tokens apart in a document."""
    at = np.flatnonzero(number >= 0)
    d, x = doc[at], number[at]
    for step in range(1, window + 1):
        if len(at) <= step:
            return
        ok = (at[step:] - at[:-step] <= window) & (d[step:] == d[:-step])
        if not ok.any():
            return
        yield np.minimum(x[:-step], x[step:])[ok], np.maximum(x[:-step], x[step:])[ok]


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    size = int(pdf["size"].iloc[0])
    total = np.zeros(size, np.int64)
    for x in pdf["sums"]:
        total += np.frombuffer(pa.decompress(x, size * 8, "zstd", asbytes=True), "<i8")
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "size": [size], "sums": [pa.compress(total.tobytes(), "zstd", asbytes=True)]})


Edges = tuple[np.ndarray, np.ndarray, np.ndarray]  # word, other word (not before it), value; each pair once


def cooccurrence(rows: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, max_cells: int = MAX_CELLS) -> Iterator[Edges]:
    """Counts of the pairs that occur over all texts, one language after the other.
    The driver holds eight bytes for each pair, and one language at a time in full."""
    sizes = np.diff(vocabulary.start)
    width = sizes[vocabulary.lang]  # columns of a word's row
    first = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)  # a row's first cell
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in sizes]  # place in the language's matrix, count
    schema = "block long, size long, sums binary"
    a = 0
    while a < len(width):
        b = max(a + 1, int(np.searchsorted(first, first[a] + max_cells, side="right")) - 1)

        def run(batches, a=a, b=b):
            v = shared.value
            acc = np.zeros(first[b] - first[a], np.int32)
            for batch in batches:
                lang = _codes(v, batch.column(1))
                for lo, hi, data, offs in chunks(batch.column(0)):
                    t = Tokens(data, offs)
                    for x, y in _pairs(t.doc, v.numbers(t, lang[lo:hi]), window):
                        if b - a < len(width):
                            ok = (x >= a) & (x < b)
                            x, y = x[ok], y[ok]
                        np.add.at(acc, first[x] - first[a] + y - v.start[v.lang[x]], np.int32(1))
            for lo in range(a, b, ROWS):
                part = acc[first[lo] - first[a] : first[min(lo + ROWS, b)] - first[a]]
                if part.any():
                    packed = pa.compress(part.astype("<i8").tobytes(), "zstd", asbytes=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([len(part)]), pa.array([packed], pa.binary())], names=["block", "size", "sums"])

        for r in merged(rows.mapInArrow(run, schema), "block", schema, _sum, partitions(rows)).toLocalIterator():
            cells = np.frombuffer(pa.decompress(bytes(r["sums"]), r["size"] * 8, "zstd", asbytes=True), "<i8")
            at = np.flatnonzero(cells)
            row = np.searchsorted(first, first[r["block"]] + at, side="right") - 1
            column, lang = first[r["block"]] + at - first[row], vocabulary.lang[row]
            for k in np.unique(lang).tolist():
                own = lang == k
                place, n = (row[own] - vocabulary.start[k]) * sizes[k] + column[own], cells[at[own]]
                found[k].append(tuple(v.astype(np.int32 if v.max() < 1 << 31 else np.int64) for v in (place, n)))
        a = b
    for k, parts in enumerate(found):
        place, n = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        found[k] = parts = []
        size = max(1, int(sizes[k]))  # a plain int: the places keep their type
        x, y = place // size, place % size
        del place
        yield x, y, n
        del x, y, n


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows of values."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(values, first) if len(first) else values


def rare_edges(rows: DataFrame, vocabulary: Vocabulary, rare: np.ndarray, window: int = WINDOW) -> list[Edges]:
    """Counts of the pairs with a rare word (a mask over the vocabulary), by language, sparse and without a limit on the texts."""
    size = len(vocabulary.words)
    shared = rows.sparkSession.sparkContext.broadcast((vocabulary, rare))

    def run(batches):
        v, rare = shared.value
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lang = _codes(v, batch.column(1))
            for lo, hi, data, offs in chunks(batch.column(0)):
                t = Tokens(data, offs)
                number = v.numbers(t, lang[lo:hi])
                has = np.zeros(hi - lo, bool)
                has[t.doc[(number >= 0) & rare[number]]] = True
                number = np.where(has[t.doc], number, -1) if len(number) else number
                for x, y in _pairs(t.doc, number, window):
                    ok = rare[x] | rare[y]
                    key, n = np.concatenate([key, x[ok] * size + y[ok]]), np.concatenate([n, np.ones(int(ok.sum()), np.int64)])
                    if len(key) > 2 * HELD:
                        key, n = _summed(key, n)
                        if len(key) > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])
                            key, n = key[:0], n[:0]
        key, n = _summed(key, n)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    def pack(batches):
        for batch in batches:
            pair, n = (np.asarray(c) for c in batch.columns)
            packed = [pa.array([pa.compress(v.astype("<i8").tobytes(), "zstd", asbytes=True)], pa.binary()) for v in (pair, n)]
            yield pa.RecordBatch.from_arrays([pa.array([len(n)]), *packed], names=["size", "pairs", "sums"])

    found: list[list[Edges]] = [[] for _ in vocabulary.langs]
    summed = rows.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in summed.mapInArrow(pack, "size long, pairs binary, sums binary").toLocalIterator():
        pair, n = (np.frombuffer(pa.decompress(bytes(r[c]), r["size"] * 8, "zstd", asbytes=True), "<i8") for c in ("pairs", "sums"))
        x, y = pair // size, pair % size
        lang = vocabulary.lang[x]
        for k in np.unique(lang).tolist():
            own = lang == k
            v = n[own]
            found[k].append(((x[own] - vocabulary.start[k]).astype(np.int32), (y[own] - vocabulary.start[k]).astype(np.int32), v.astype(np.int32 if v.max() < 1 << 31 else np.int64)))
    none = (np.zeros(0, np.int32),) * 3
    return [tuple(np.concatenate(c) for c in zip(*parts)) if parts else none for parts in found]


def ppmi(edges: Edges, n_words: int, doubt: float | np.ndarray = DOUBT) -> Edges:
    """Positive pointwise mutual information in bits, from the lower end of each
    count's range (the count less `doubt` standard deviations, one for all or for each pair), so that words met
    together once or twice by chance have no edge."""
    x, y, n = edges
    other = x != y
    both = np.bincount(x, weights=n, minlength=n_words) + np.bincount(y[other], weights=n[other], minlength=n_words)
    total = both.sum()
    if not total:
        return x[:0], y[:0], np.zeros(0)
    margin = both / total
    w = np.sqrt(n)
    w *= -doubt
    w += n
    np.maximum(w, 0, out=w)
    w /= total
    w /= margin[x]
    w /= margin[y]
    with np.errstate(divide="ignore"):
        np.log2(w, out=w)
    keep = (w > 0) & other
    return x[keep], y[keep], w[keep]


def _degrees(weights: Edges, n_words: int) -> np.ndarray:
    x, y, w = weights
    return np.bincount(x, weights=w, minlength=n_words) + np.bincount(y, weights=w, minlength=n_words)


def _spread(weights: Edges, share: np.ndarray) -> np.ndarray:
    """What each word gets over its edges, some edges at a time: no copies of them all."""
    out = np.zeros(len(share))
    for lo in range(0, len(weights[0]), HELD):
        x, y, w = (v[lo : lo + HELD] for v in weights)
        out += np.bincount(y, weights=share[x] * w, minlength=len(out)) + np.bincount(x, weights=share[y] * w, minlength=len(out))
    return out


def walk(weights: Edges, n_words: int, seeds: np.ndarray, restart: float = RESTART, steps: int = STEPS) -> np.ndarray:
    """Visiting probabilities of a random walk that restarts at the seeds; a word without edges restarts."""
    s = np.zeros(n_words)
    s[seeds] = 1 / len(seeds)
    degree = _degrees(weights, n_words)
    p = s.copy()
    for _ in range(steps):
        share = np.divide(p, degree, out=np.zeros_like(p), where=degree > 0)
        p = (1 - restart) * (_spread(weights, share) + p[degree == 0].sum() * s) + restart * s
    return p


def polarity(weights: Edges, n_words: int, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """-1 to 1 per word; 0 where neither walk gets."""
    if not len(toxic) or not len(clean):
        return np.zeros(n_words)
    t, c, degree = walk(weights, n_words, toxic), walk(weights, n_words, clean), _degrees(weights, n_words)
    total = t + c + PRIOR * degree / max(degree.sum(), 1e-12)
    return np.divide(t - c, total, out=np.zeros_like(t), where=total > 0)


def excess(tox: np.ndarray, clean: np.ndarray, n_tox, n_clean) -> np.ndarray:
    """Signed root of the likelihood ratio: how far `tox` of `n_tox` exceeds `clean` of `n_clean`."""
    share = (tox + clean) / (n_tox + n_clean)

    def part(seen, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / (n * share)), 0) + np.where(seen < n, (n - seen) * np.log((n - seen) / (n * (1 - share))), 0)

    g = np.sqrt(2 * np.maximum(np.nan_to_num(part(tox, n_tox) + part(clean, n_clean)), 0))
    return np.where(tox / n_tox > clean / n_clean, g, -g)


def pick_seeds(df: np.ndarray, tox: np.ndarray, clean: np.ndarray, n_tox: int, n_clean: int, seeds: int = SEEDS, seed_z: float = SEED_Z) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of toxic and clean seed terms, from the documents of each kind that use a word."""
    if not n_tox or not n_clean:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    z = excess(tox, clean, n_tox, n_clean)
    top = np.argsort(-z, kind="stable")[:seeds]
    rest = np.flatnonzero(z < 1)
    return top[z[top] >= seed_z], rest[np.argsort(-df[rest], kind="stable")[:seeds]]


def _kinds(label: tuple[np.ndarray, np.ndarray], own) -> np.ndarray:
    """0 for an id without a label, 1 for a clean and 2 for a toxic one."""
    ids, toxic = label
    if not len(ids):
        return np.zeros(len(own), np.int64)
    x = np.asarray(own.fill_null(-1))
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where((ids[at] == x) & np.asarray(own.is_valid()), toxic[at] + 1, 0)


_TALLY = "lang long, key long, n long, toxic long, word string"


def _tally(rows: DataFrame, start: Vocabulary, label: tuple[np.ndarray, np.ndarray] | None, seeds: Vocabulary | None, window: int) -> DataFrame:
    """(lang, key, n, toxic, word) of every word: the documents that use it, and those of them
    that are toxic by label or, with `seeds`, have it within `window` tokens of a seed. With
    labels only the labelled documents count. Words never in toxic company have no spelling."""
    shared = rows.sparkSession.sparkContext.broadcast((start, label, seeds))

    def run(batches):
        v, label, seeds = shared.value
        key, values, spelled = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64), {}

        def batch_of(key, values):
            columns = [pa.array(values[:, 0]), pa.array(key.view(np.int64)), pa.array(values[:, 1]), pa.array(values[:, 2]), pa.array([spelled.get(k) for k in key.tolist()], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "key", "n", "toxic", "word"])

        for batch in batches:
            if label is not None:
                kind = _kinds(label, batch.column(2))
                batch, kind = batch.filter(pa.array(kind > 0)), kind[kind > 0]
            lang = _codes(v, batch.column(1))
            for lo, hi, data, offs in chunks(batch.column(0)):
                t = Tokens(data, offs)
                if not len(t.doc):
                    continue
                if seeds is None:
                    near = kind[lo:hi][t.doc] == 2
                else:
                    near, at = np.zeros(len(t.doc), bool), np.flatnonzero(seeds.numbers(t, lang[lo:hi]) >= 0)
                    for step in range(1, window + 1):
                        for to in (at - step, at + step):
                            ok = (to >= 0) & (to < len(near))
                            ok[ok] = t.doc[to[ok]] == t.doc[at[ok]]
                            near[to[ok]] = True
                order, start = _once(t)
                near = np.logical_or.reduceat(near[order], start)  # whether any of a document's equal words is in toxic company
                order = order[start]
                own = lang[lo:hi][t.doc[order]]
                k = _key(own, t.hash[order])
                x, first = np.unique(k[near], return_index=True)
                at = order[near][first]
                for i, a in zip(x.tolist(), at.tolist()):
                    if i not in spelled:
                        spelled[i] = _word(data, t, a).decode("utf-8", "replace")
                x, inverse = np.unique(k, return_inverse=True)
                new = np.zeros((len(x), 3), np.int64)
                new[inverse, 0] = own
                new[:, 1] = np.bincount(inverse, minlength=len(x))
                new[:, 2] = np.bincount(inverse[near], minlength=len(x))
                key, values = np.concatenate([key, x]), np.concatenate([values, new])
                if len(key) > 2 * HELD:
                    key, values = _distinct(key, values)
                    if len(key) > HELD:
                        yield batch_of(key, values)
                        key, values, spelled = key[:0], values[:0], {}
        yield batch_of(*_distinct(key, values))

    return rows.mapInArrow(run, _TALLY).groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.max("word").alias("word"))


def _distinct(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_summed, with the language (the first column, equal for equal keys) kept as it is."""
    x, first = np.unique(key, return_index=True)
    out = _summed(key, values)[1]
    out[:, 0] = values[first, 0]
    return x, out


def _company(tally: DataFrame, n_tox: np.ndarray, n_clean: np.ndarray, seed_z: float) -> list[tuple[int, str, int, int]]:
    """(language, word, uses in toxic company, other uses) of the words that exceed chance by `seed_z`, of totals by language."""

    def run(batches):
        for batch in batches:
            lang, n, tox = (np.asarray(batch.column(c)) for c in (0, 1, 2))
            with np.errstate(divide="ignore", invalid="ignore"):
                z = excess(tox, n - tox, n_tox[lang], n_clean[lang])
            yield batch.filter(pa.array((z >= seed_z) & (n_tox[lang] > 0) & (n_clean[lang] > 0)))

    found = tally.filter("toxic > 0").select("lang", "n", "toxic", "word").mapInArrow(run, "lang long, n long, toxic long, word string")
    return sorted((r["lang"], r["word"], r["toxic"], r["n"] - r["toxic"]) for r in found.collect())


class Lexicon:
    """Words with polarity above the cut, by language."""

    def __init__(self, entries: dict[str, dict[str, float]]):
        self.vocabulary = Vocabulary({x: sorted(v) for x, v in entries.items()})
        self.weight = np.array([entries[x][w] for x in sorted(entries) for w in sorted(entries[x])], float)
        self.entries = entries

    def score(self, data, offs, lang) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, uses, evidence) of each document."""
        t = Tokens(data, offs)
        n, number = t.n_docs, self.vocabulary.numbers(t, lang)
        at = np.flatnonzero(number >= 0)
        d, x = t.doc[at], number[at]
        size = max(1, len(self.weight))
        key, uses = np.unique(d * size + x, return_counts=True)
        total, evidence = np.zeros(n), np.zeros(n)
        if len(key):
            np.add.at(total, key // size, self.weight[key % size] * uses)
            np.add.at(evidence, key // size, self.weight[key % size])
        counts = t.counts() if len(t.doc) else np.zeros(n)
        return total / np.sqrt(np.maximum(counts, 1)), np.bincount(d, minlength=n), evidence


def _tokens_of(term: str | None) -> list[str]:
    data = np.frombuffer((term or "").encode(), np.uint8)
    t = Tokens(data, np.array([0, len(data)]))
    return [_word(data, t, k).decode() for k in range(len(t.doc))]


def induce(docs: DataFrame, labels: DataFrame | None = None, seeds: dict[str, tuple[list[str], list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE, window: int = WINDOW, cut: float = CUT, max_cells: int = MAX_CELLS, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """The induced lexicon. `seeds` maps a language to its (toxic, clean) terms; without it they come from the labels."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(id_col).cast("long").alias("id"))
    spark = docs.sparkSession
    n_docs, words_of = candidates(rows.select("text", "lang"), min_share)
    seeds = None if seeds is None else {x or "": tuple([t for w in own for t in _tokens_of(w)] for own in kinds) for x, kinds in seeds.items()}
    found = {x: sorted(set(words_of[x]) | {w for own in (seeds or {}).get(x, ()) for w in own}) for x in n_docs}
    start = Vocabulary(found)
    label = _labels(labels, max_labelled) if labels is not None and seeds is None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((start, label))

    def count(batches):
        v, label = shared.value
        acc, n = np.zeros((len(v.words), 3), np.int64), np.zeros((len(v.langs), 2), np.int64)
        for batch in batches:
            lang, kind = _codes(v, batch.column(1)), _kinds(label, batch.column(2))
            np.add.at(n, (lang[kind > 0], kind[kind > 0] - 1), 1)
            for lo, hi, data, offs in chunks(batch.column(0)):
                t = Tokens(data, offs)
                number = v.numbers(t, lang[lo:hi])
                key = np.unique(t.doc[number >= 0] * len(v.words) + number[number >= 0])
                d, x = key // max(1, len(v.words)), key % max(1, len(v.words))
                acc[:, 0] += np.bincount(x, minlength=len(acc))
                for c in (1, 2):
                    acc[:, c] += np.bincount(x[kind[lo:hi][d] == c], minlength=len(acc))
        at = np.flatnonzero(acc[:, 0])
        at = np.concatenate([at, -1 - np.flatnonzero(n.sum(axis=1))])
        values = np.vstack([acc[at[at >= 0]], np.hstack([np.zeros((int((at < 0).sum()), 1), np.int64), n[-1 - at[at < 0]]])])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(values[:, c])) for c in range(3))], names=["word", "df", "clean", "toxic"])

    acc, n = np.zeros((len(start.words), 3), np.int64), np.zeros((len(start.langs), 2), np.int64)
    for r in rows.mapInArrow(count, "word long, df long, clean long, toxic long").groupBy("word").agg(F.sum("df"), F.sum("clean"), F.sum("toxic")).collect():
        if r[0] >= 0:
            acc[r[0]] = r[1:]
        else:
            n[-1 - r[0]] = r[2:]
    words: dict[str, list[str]] = {}
    chosen = {}
    names = list(start.langs)
    labelled: dict[str, list[tuple[str, int, int]]] = {x: [] for x in names}
    if n.all(axis=1).any():
        for k, w, tox, clean in _company(_tally(rows, start, label, None, window), n[:, 1], n[:, 0], SEED_Z):
            labelled[names[k]].append((w, tox, clean))
    common = {}
    for x, k in start.langs.items():
        at = np.arange(start.start[k], start.start[k + 1])
        given = [set(own) for own in (seeds or {}).get(x, ((), ()))]
        at = np.array([i for i in at if acc[i, 0] and (acc[i, 0] >= min_share * n_docs[x] or start.words[i] in given[0] | given[1])], np.int64)
        words[x] = [start.words[i] for i in at]
        common[x] = len(at)
        own = set(words[x])
        more = [r for r in labelled[x] if r[0] not in own]
        words[x] += [w for w, _, _ in more]
        tox, clean = np.append(acc[at, 2], [t for _, t, _ in more]), np.append(acc[at, 1], [c for _, _, c in more])
        if seeds is None:
            chosen[x] = pick_seeds(np.append(acc[at, 0], np.zeros(len(more))), tox, clean, n[k, 1], n[k, 0])
        else:
            chosen[x] = tuple(np.array([i for i, w in enumerate(words[x]) if w in g], np.int64) for g in given)
    toxic = Vocabulary({x: [words[x][i] for i in chosen[x][0]] for x in names})
    if len(toxic.words):
        work = Workspace(spark, "toxicity")
        tally = work.save(_tally(rows, start, None, toxic, window), "words")
        total = np.zeros((len(names), 2), np.int64)
        for r in tally.groupBy("lang").agg(F.sum("toxic"), F.sum(F.col("n") - F.col("toxic"))).collect():
            total[r[0]] = r[1:]
        own = {x: set(words[x]) for x in names}
        for k, w, _, _ in _company(tally, total[:, 0], total[:, 1], SEED_Z):
            if w not in own[names[k]]:
                words[names[k]].append(w)
        work.close()
    vocabulary = Vocabulary(words)
    rare = np.concatenate([np.arange(len(words[x])) >= common[x] for x in names]) if names else np.zeros(0, bool)
    sparse = rare_edges(rows.select("text", "lang"), vocabulary, rare, window) if rare.any() else []
    dense = cooccurrence(rows.select("text", "lang"), Vocabulary({x: words[x][: common[x]] for x in names}), window, max_cells)
    entries = {}
    for (x, k), m in zip(vocabulary.langs.items(), dense):
        doubt = DOUBT
        if sparse:
            doubt = np.repeat(np.float32([DOUBT, RARE_DOUBT]), [len(m[0]), len(sparse[k][0])])
            m = tuple(np.concatenate(c) for c in zip(m, sparse[k]))
            sparse[k] = ()
        m = ppmi(m, len(words[x]), doubt)
        del doubt
        weight = polarity(m, len(words[x]), *chosen[x])
        del m
        entries[x] = {w: float(p) for w, p in zip(words[x], weight) if p > cut}
    return Lexicon(entries)


def _labels(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ids, toxic 0/1) of at most `most` labelled ids of each kind."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top")
    rows = [r for y in (0, 1) for r in known.filter(F.col("y") == y).select("id", "y").orderBy(F.xxhash64(F.lit("tox"), "id"), "id").limit(most).collect()]
    rows.sort()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", evidence: float = EVIDENCE, limit: float = LIMIT) -> DataFrame:
    """(doc_id, score, n_uses, evidence, toxic) of every row; a language the lexicon doesn't know scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        for batch in batches:
            lang = np.array([lex.vocabulary.langs.get(v, len(lex.vocabulary.langs)) for v in batch.column(2).to_pylist()], np.int64)
            for lo, hi, data, offs in chunks(batch.column(1)):
                s, uses, e = lex.score(data, offs, lang[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(s), pa.array(uses), pa.array(e), pa.array((e >= evidence) & (s > limit))], names=["doc_id", "score", "n_uses", "evidence", "toxic"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "doc_id long, score double, n_uses long, evidence double, toxic boolean")
