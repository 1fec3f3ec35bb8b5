"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with temperature-calibrated probabilities.

Random indexing: every token (a run of letters and digits, or of punctuation, case
kept) owns a sparse ternary index vector drawn from its hash; its word vector is the
sum of the index vectors of all tokens within `window` of it, over all documents.
Tokens share `buckets` rows by hash, so the table has a fixed size at any input.
Sums are integers: the table doesn't depend on task order. A document is the mean of
its tokens' normalised word vectors, beside the mean of its tokens' own index
vectors. The network (numpy, one hidden layer) is fitted on at most `max_labelled`
labelled documents, chosen by a hash of the id; a fifth of them is held out to set
the temperature that makes its probabilities honest.

Passes: one for the table (each task emits one table, summed by row block, level by level), one over
the labelled documents, one for the scores. Only the table (`buckets` x `dim` small
integers) and the network are broadcast; neither grows with the data.

Defined results: texts of any length are read whole. A document without tokens (null, empty or blank text) has no
probability (null) and isn't rejected, nor is one of fewer than `min_tokens`. If the labels hold fewer than `min_class`
documents of either class, nothing is known and every probability is null. Labels
that are null, or contradict each other for one id, are ignored; of documents that share
a labelled id, the least text is trained on. Each row, repeated or not, is scored by its
own text: equal texts have equal probabilities. Equal hashes of ids are settled by the id.
Empty tables give an unknown model and no rows; extra columns are passed through by
`keep_good`, whatever their names, and never read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._heavy import merged, partitions
from ._tokens import CASED, RUNS, U, Tokens, chunks, mix

BUCKETS, DIM, NONZERO, WINDOW = 1 << 13, 32, 2, 2
HIDDEN, MAX_LABELLED, MIN_CLASS, EPOCHS, SEED = 32, 10_000, 8, 60, 7
REJECT_BELOW = 0.35  # calibrated probability of good quality under which a document goes
MIN_TOKENS = 25  # shorter documents hold too little evidence to be rejected
BLOCKS = 64  # row blocks of the table, for the sum


def index_vectors(buckets: int, dim: int, nonzero: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, nonzero) positions and signs."""
    x = mix(np.arange(buckets, dtype=U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(1, nonzero + 1, dtype=U)[None, :] * U(0xD1B54A32D192ED03))
    return ((x >> U(33)) % U(dim)).astype(np.int64), np.where(x & U(1), 1, -1)


def _bucket(t: Tokens, buckets: int) -> np.ndarray:
    return (t.hash & U(buckets - 1)).astype(np.int64)


def _tables(buckets: int, dim: int, nonzero: int, window: int):
    def run(batches):
        place, sign = index_vectors(buckets, dim, nonzero)
        acc = np.zeros(buckets * dim, np.int64)
        for batch in batches:
            for _, _, data, offs in chunks(batch.column(0)):
                t = Tokens(data, offs, RUNS, CASED)
                b = _bucket(t, buckets)
                row = b * dim
                for step in range(1, window + 1):
                    if len(b) <= step:
                        break
                    same = t.doc[step:] == t.doc[:-step]
                    for one, other in ((row[:-step][same], b[step:][same]), (row[step:][same], b[:-step][same])):
                        for j in range(nonzero):
                            acc += np.bincount(one + place[other, j], weights=sign[other, j], minlength=len(acc)).astype(np.int64)
        if acc.any():
            parts = acc.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["block", "sums"])

    return run


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, "<i8") for x in pdf["sums"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.astype("<i8").tobytes()]})


def word_table(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, dim: int = DIM, nonzero: int = NONZERO, window: int = WINDOW) -> np.ndarray:
    """(buckets, 2 dim) rows: the normalised context sum, then the index vector."""
    schema = "block long, sums binary"
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    parts = merged(texts.mapInArrow(_tables(buckets, dim, nonzero, window), schema), "block", schema, _sum, partitions(texts))
    acc = np.zeros((BLOCKS, buckets * dim // BLOCKS))
    for r in parts.collect():
        acc[r["block"]] = np.frombuffer(r["sums"], "<i8")
    acc = acc.reshape(buckets, dim)
    acc /= np.maximum(np.linalg.norm(acc, axis=1, keepdims=True), 1e-9)
    place, sign = index_vectors(buckets, dim, nonzero)
    own = np.zeros((buckets, dim))
    np.add.at(own, (np.arange(buckets)[:, None], place), sign)
    return np.hstack([acc, own]).astype(np.float32)


def pooled(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean table row of each document's tokens (0 without tokens), summed in float64."""
    t = Tokens(data, offs, RUNS, CASED)
    n = len(offs) - 1
    counts = t.counts() if n else np.zeros(0)
    rows = _bucket(t, len(table))
    # distinct (document, bucket) pairs with counts, then one segmented sum
    key, c = np.unique(t.doc * len(table) + rows, return_counts=True)
    out = np.zeros((n, table.shape[1]))
    if len(key):
        d = key // len(table)
        starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        for lo in range(0, len(starts), 256):  # keeps the gathered rows small
            s = starts[lo : lo + 256]
            a, b = s[0], (starts[lo + 256] if lo + 256 < len(starts) else len(key))
            out[d[s]] = np.add.reduceat(table[key[a:b] % len(table)] * c[a:b, None].astype(np.float64), s - a, axis=0)
    return out / np.maximum(counts, 1)[:, None], counts


class Network:
    """ReLU layer and logistic output, fitted with Adam; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        x, y = x[order], y[order].astype(float)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.mean) / self.scale
        held = max(1, len(y) // 5)
        (hx, hy), (x, y) = (x[:held], y[:held]), (x[held:], y[held:])
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) if len(y) else y
        d = x.shape[1]
        p = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
                h = np.maximum(x[idx] @ p[0] + p[1], 0)
                g = (_sigmoid(h @ p[2] + p[3]) - y[idx]) * weight[idx] / max(1, len(idx))
                gh = np.outer(g, p[2]) * (h > 0)
                step += 1
                for k, grad in enumerate((x[idx].T @ gh + 1e-4 * p[0], gh.sum(axis=0), h.T @ g + 1e-4 * p[2], np.array([g.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    p[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / ((v[k] / (1 - 0.999**step)) ** 0.5 + 1e-8)
        self.p, self.temperature = p, 1.0
        z = self._logit(hx)
        nll = [(-np.mean(np.where(hy > 0, np.log(_sigmoid(z / t) + 1e-12), np.log(1 - _sigmoid(z / t) + 1e-12))), t) for t in np.geomspace(0.25, 8, 41)]
        self.temperature = float(min(nll)[1])
        self.held_accuracy = float(np.mean((z > 0) == (hy > 0)))

    def _logit(self, x):
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """A word table and the network over it (None where the labels don't allow one)."""

    def __init__(self, table: np.ndarray, network: Network | None):
        self.table, self.network = table, network

    def score(self, column, reject_below: float, min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of a string column, nan where there is none, and whether to keep."""
        out, keep = np.full(len(column), np.nan), np.ones(len(column), bool)
        if self.network is not None:
            for lo, hi, data, offs in chunks(column):
                x, counts = pooled(data, offs, self.table)
                out[lo:hi] = np.where(counts > 0, self.network.probability(x), np.nan)
                keep[lo:hi] = ~(out[lo:hi] < reject_below) | (counts < min_tokens)
        return out, keep


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, min_class: int = MIN_CLASS, **table_options) -> Model:
    table = word_table(docs, text_col, **table_options)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("id", "y")
    chosen = known.orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(max_labelled)  # bounded: may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def features(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(1)):
                x, counts = pooled(data, offs, shared.value)
                ok = pa.array(counts > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].filter(ok), batch.column(2)[lo:hi].filter(ok), pa.array([r.tobytes() for r in x], pa.binary()).filter(ok)], names=["id", "y", "x"])

    once = rows.groupBy("id", "y").agg(F.min("text").alias("text"))  # one text for each id, before anything is collected
    found = once.select("id", "text", "y").mapInArrow(features, "id long, y int, x binary").collect()
    found.sort(key=lambda r: r["id"])
    y = np.array([r["y"] for r in found])
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < min_class:
        return Model(table, None)
    return Model(table, Network(np.array([np.frombuffer(bytes(r["x"])) for r in found]), y))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject_below: float = REJECT_BELOW, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, probability, keep) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p, keep = shared.value.score(batch.column(1), reject_below, min_tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, from_pandas=True), pa.array(keep)], names=["doc_id", "probability", "keep"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, probability double, keep boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", reject_below: float = REJECT_BELOW, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier doesn't reject."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at).cast(pa.large_string()), reject_below, min_tokens)[1]))

    return docs.mapInArrow(run, docs.schema)
