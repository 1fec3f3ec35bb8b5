"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A document is the set of its runs of `shingle` words (ASCII letters folded,
punctuation and white space ignored). Each set element ranks the `m` signature
components by a random permutation of its own: on level j it offers
(j, uniform) to the j-th component of its permutation, so one element's offers
are correlated and each level covers new components. Elements advance level by
level; a document stops at the level that fills its last component, because all
later offers are larger.

Plan:
1. one pass over the texts gives signatures, written to the shared folder;
2. texts of the same token sequence are one class, made by a combined aggregate;
   everything below is about classes, which are numbered;
3. (band, bucket) rows of the classes: a combined aggregate finds the least class of
   each bucket, its hub, and a join brings it to the other members, numbers only;
4. only texts of classes that share a bucket are fetched, once each;
5. every class is paired with the least of its hubs, then, where that didn't bring them
   together, with the others; pairs are verified by exact Jaccard similarity of the full
   shingle sets and united. So a text of a large cluster meets one other, not one a band;
6. where a bucket still has members of several components, all pairs across
   components are verified as well. Pairs inside a component need no check, as
   they can't change the grouping, and aren't made, as the largest component of a
   bucket is never joined with itself: the groups are exactly the connected
   components of all verified candidate pairs, without a pair per two copies.

Before a pair's texts are compared, 8-bit parts of the two signatures are: a pair is
given up where they agree five standard deviations more rarely than `threshold` demands,
which befalls a pair at the threshold with a probability of some 3e-7 (one more similar
with less), beside 0.08 of never sharing a bucket.

Defined results: a row is known by its id and text. A null, empty or token-free text is in
no group but its own, and such rows aren't duplicates of each other. Texts of any length
are compared whole. In `groups`, rows with a null id get no result, and an id with
several texts joins the groups of all of them. `keep_one` judges each row by its own
text: of a group the row with the least id stays, and rows without an id come after all
others; rows that share an id are ordered by a hash of their text; of rows equal in id
and text one stays (the least as JSON). Empty tables give no rows. Extra columns,
whatever their names, are kept and don't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tokens import U, Tokens, chunks, mix, shingles
from ._work import Workspace, text_key

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
LAZY = 6  # levels before an element's permutation is held in full
EMPTY = np.iinfo(np.uint64).max
_STEP = U(0x9E3779B97F4A7C15)
_LOW = U(0xFFFFFFFF)


def _draw(e: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(offer, position in [level, m)) of each element on a level."""
    x = mix(e + U(int(_STEP) * (level + 1) & 0xFFFFFFFFFFFFFFFF))
    return (U(level) << U(32)) | (x & _LOW), (U(level) + (((x >> U(32)) * U(m - level)) >> U(32))).astype(np.int64)


def signatures(doc: np.ndarray, element: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs, m) of sets given as sorted (doc, element); EMPTY throughout where a set is empty."""
    sig = np.full(n_docs * m, EMPTY, U)
    if not len(doc):
        return sig.reshape(n_docs, m)

    ks: list[np.ndarray] = []  # each level's swap partner, and what stood at the level's position
    stood: list[np.ndarray] = []
    for level in range(min(m, LAZY)):
        v, k = _draw(element, level, m)
        component, here = k, np.full(len(k), level, np.int64)
        for ki, si in zip(ks, stood):  # a position's content is what its last swap put there
            component = np.where(ki == k, si, component)
            here = np.where(ki == level, si, here)
        np.minimum.at(sig, doc * m + component, v)
        on = (sig.reshape(n_docs, m) == EMPTY).any(axis=1)[doc]
        doc, element = doc[on], element[on]
        ks, stood = [x[on] for x in (*ks, k)], [x[on] for x in (*stood, here)]
        if not len(doc):
            return sig.reshape(n_docs, m)
        if level == 1:  # few documents are left, those that repeat their elements among them: each counts once from here on
            one = _distinct(doc, element)
            doc, element = doc[one], element[one]
            ks, stood = [x[one] for x in ks], [x[one] for x in stood]
    lo = 0
    while lo < len(doc):  # blocks of whole documents
        hi = min(lo + (1 << 15), len(doc))
        hi = int(np.searchsorted(doc, doc[hi - 1], side="right"))
        _finish(doc[lo:hi], element[lo:hi], [k[lo:hi] for k in ks], n_docs, m, sig)
        lo = hi
    return sig.reshape(n_docs, m)


def _distinct(doc: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Places of one of each (document, element), in the documents' order."""
    order = np.lexsort((element, doc))
    d, e = doc[order], element[order]
    return order[np.append(True, (d[1:] != d[:-1]) | (e[1:] != e[:-1]))]


def _finish(doc, element, before, n_docs, m, sig) -> None:
    """The levels after those in `before`, with each element's permutation in full (Fisher-Yates)."""
    perm = np.tile(np.arange(m, dtype=np.int16), (len(doc), 1))
    rows = np.arange(len(doc))
    for level, k in enumerate(before):
        perm[rows, k], perm[:, level] = perm[:, level].copy(), perm[rows, k]
    live = doc  # documents with an empty component; perm is cut only as these halve
    for level in range(len(before), m):
        v, k = _draw(element, level, m)
        component = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[:, level]
        perm[rows, level] = component
        np.minimum.at(sig, doc * m + component, v)
        on = (sig.reshape(n_docs, m)[doc[0] : doc[-1] + 1] == EMPTY).any(axis=1)[doc - doc[0]]
        left = int(on.sum())
        if not left:
            return
        if left * 2 < len(live):
            doc, element, perm = doc[on], element[on], perm[on]
            live, rows = doc, np.arange(len(doc))


def _sketch(shingle: int, bands: int, rows: int):
    m = bands * rows
    schema = pa.schema([("absent", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("same", pa.int64()), ("same2", pa.int64()), ("low", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column(3)):
                t = Tokens(data, offs)
                d, e = shingles(t, shingle)
                sig = signatures(d, e, hi - lo, m)
                filled = np.flatnonzero(t.counts() > 0)
                # the token sequence as two independent 64-bit sums over position-dependent hashes
                at = np.arange(len(t.doc), dtype=np.int64) - np.searchsorted(t.doc, t.doc)
                same = [mix(np.bincount(t.doc, minlength=hi - lo).astype(U) + _sum_by(t.doc, mix(t.hash + mix(at.astype(U) + U(salt))), hi - lo)) for salt in (1, 1 << 40)]
                sig = sig[filled]
                key = np.zeros((len(filled), bands), U)
                for r in range(rows):
                    key = key * U(0xD6E8FEB86659FD93) + sig[:, r::rows][:, :bands]
                key = mix(key + np.arange(bands, dtype=U) * _STEP).view(np.int64)
                low = np.ascontiguousarray(mix(sig) & U(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[lo:hi].take(pa.array(filled)) for c in range(3)),
                        pa.array(same[0][filled].view(np.int64)),
                        pa.array(same[1][filled].view(np.int64)),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(filled) + 1, dtype=np.int32) * bands), pa.array(key.ravel())),
                    ],
                    schema=schema,
                )

    return run


def _sum_by(doc: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    c = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=c[1:])
    ends = np.searchsorted(doc, np.arange(n + 1))
    return c[ends[1:]] - c[ends[:-1]]


def _agree(pairs: DataFrame, low: DataFrame, m: int, threshold: float) -> DataFrame:
    """Drops pairs whose 8-bit signature parts agree too rarely for `threshold`: see the module."""
    least = int(m * (threshold - 5 * (threshold * (1 - threshold) / m) ** 0.5))
    if least <= 0:
        return pairs

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), m) for s in (a, b))
        return pd.Series((x == y).sum(axis=1) >= least)

    a, b = (low.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").filter(close("low_a", "low_b")).select("a", "b")


def _jaccard(shingle: int, threshold: float):
    def sets(column):
        out = []
        for lo, hi, data, offs in chunks(column):
            d, e = shingles(Tokens(data, offs), shingle)
            ends = np.searchsorted(d, np.arange(hi - lo + 1))
            out += [np.unique(e[s:t]) for s, t in zip(ends[:-1], ends[1:])]
        return out

    def run(batches):
        for batch in batches:
            left, right = sets(batch.column("text_a")), sets(batch.column("text_b"))
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.float64)
            union = np.array([len(x) + len(y) for x, y in zip(left, right)], np.float64) - both
            j = both / np.maximum(union, 1)
            ok = np.flatnonzero(j >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(j[ok])], names=["a", "b", "jaccard"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_jaccard(shingle, threshold), "a long, b long, jaccard double")


def _across(members: DataFrame) -> DataFrame:
    """The pairs (a < b) of different roots in the same bucket, from (key, node, root). The root
    with most members in a bucket is joined with the others only: what the join makes is at most
    twice the pairs that it is for, however large a component."""
    main = members.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main")).select("key", F.col("main.root").alias("main"))
    x = members.join(main, "key").filter("root <> main").select("key", F.col("node").alias("x"), F.col("root").alias("root_x"))
    y = members.select("key", F.col("node").alias("y"), F.col("root").alias("root_y"))
    return x.join(y, "key").filter("root_x <> root_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _forest(batches):
    """Union-find over the edges of one partition: a star for each local component."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while (p := parent.setdefault(root, root)) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter((x for x in parent if parent[x] != x), np.int64)
    roots = np.array([find(int(x)) for x in nodes], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, root): the least node connected to it, for nodes that aren't their own root.

    Union-find in each partition shrinks the edges to stars; large-star and
    small-star rounds (Kiveris et al. 2014), each ending in the shared folder,
    then connect the stars. Rounds grow with the logarithm of the longest chain."""
    now = work.save(edges.toDF("a", "b").mapInArrow(_forest, "node long, root long"), "forest")
    while not _is_star(now):
        both = now.select("node", "root").union(now.select("root", "node")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("node"), F.least("m", "x").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node")
        stars = small.select("node", F.col("m").alias("root")).union(small.select(F.col("root").alias("node"), F.col("m").alias("root"))).filter("node <> root").distinct()
        after = work.save(stars, "stars")
        work.drop(now)
        now = after
    return now.distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one root, and no root is a node."""
    ends = edges.distinct().select(F.explode(F.array(F.struct(F.col("node").alias("x"), F.lit(1).alias("up")), F.struct(F.col("root").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least")).filter("up > 1 or up = 1 and least = 0").isEmpty()


KEY = ["absent", "id", "row"]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(absent, id, row, text): rows without an id sort after the others."""
    i, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(i.isNull().cast("int").alias("absent"), F.coalesce(i, F.lit(0)).alias("id"), text_key(text).alias("row"), text.alias("text"))


_SKETCH = "absent int, id long, row long, same long, same2 long, low binary, keys array<long>"


class Classes:
    """The classes of equal token sequences in some texts, and the edges between similar ones."""

    def __init__(self, texts: DataFrame, earlier: DataFrame | None, shingle: int, bands: int, rows: int, threshold: float):
        """An id with one `earlier` text, and no other, is judged by that instead of its text."""
        self.work = work = Workspace(texts.sparkSession, "superminhash")
        run = _sketch(shingle, bands, rows)
        sketch = every = work.save(texts.mapInArrow(run, _SKETCH), "sketch")
        every = every.groupBy(*KEY, "same", "same2").agg(F.count("*").alias("copies"))
        if earlier is not None:
            before = work.save(earlier.filter("absent = 0").mapInArrow(run, _SKETCH), "earlier")
            known = sketch.filter("absent = 0").select("id")
            sole = before.groupBy("id").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.min("same").alias("was"), F.min("same2").alias("was2")).filter("lo = hi")
            sole = work.save(sole.join(known, "id", "left_semi").select("id", "was", "was2"), "sole")
            own = sketch.join(sole.select(F.col("id").alias("sole_id")), (F.col("absent") == 0) & (F.col("id") == F.col("sole_id")), "left_anti")
            sketch = before.join(sole.select("id"), "id", "left_semi").select(*sketch.columns)
            if own.isEmpty():
                texts = earlier
            else:
                sketch, texts = sketch.unionByName(own), texts.union(earlier)
            every = every.join(sole.withColumn("none", F.lit(0)), (F.col("absent") == F.col("none")) & (every["id"] == sole["id"]), "left").select(*[every[k] for k in KEY], "copies", F.coalesce("was", "same").alias("same"), F.coalesce("was2", "same2").alias("same2"))
        # rows are combined before the shuffle: a text that very many rows share is one row per task
        same = sketch.groupBy("same", "same2").agg(F.min(F.struct(*KEY)).alias("rep"), F.first("low").alias("low"), F.first("keys").alias("keys"))
        # numbers are final once they are written
        self.table = work.save(same.select("same", "same2", "rep.*", "low", "keys").withColumn("node", F.monotonically_increasing_id()), "classes")
        self.members = work.save(every.join(self.table.select("same", "same2", "node"), ["same", "same2"]).select(*KEY, "copies", "node"), "members")
        self.near = self._edges(texts, shingle, bands * rows, threshold)

    def _edges(self, texts: DataFrame, shingle: int, m: int, threshold: float) -> DataFrame:
        work = self.work
        low = self.table.select("node", "low")
        keys = self.table.select("node", F.explode("keys").alias("key"))
        hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most")).filter("hub <> most").drop("most")
        buckets = work.save(keys.join(hubs, "key").select("key", "node", "hub"), "buckets")
        needed = buckets.select("node").distinct().join(self.table.select(*KEY, "node"), "node")
        once = texts.groupBy(*KEY).agg(F.first("text").alias("text"))
        found = work.save(once.join(needed, KEY).select("node", "text"), "texts")
        pairs = work.save(buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
        least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        near = work.save(_verified(_agree(least, low, m, threshold), found, shingle, threshold).select("a", "b"), "near")
        roots = components(near, work)
        root_a, root_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        apart = pairs.join(least.select(F.col("a").alias("least"), "b"), "b").filter("a <> least").join(root_a, "a", "left").join(root_b, "b", "left")
        apart = apart.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
        more = work.save(_verified(_agree(apart, low, m, threshold), found, shingle, threshold).select("a", "b"), "more")
        near = near.union(more)
        # buckets that still hold several components
        roots = components(near, work)
        member = buckets.join(roots, "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root"))
        several = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
        open_ = work.save(member.join(several, "key").filter("node <> hub").select("key", "node", "root"), "open")
        rest = work.save(_verified(_agree(_across(open_), low, m, threshold), found, shingle, threshold).select("a", "b"), "rest")
        work.drop(found, buckets, open_, pairs)
        return near.union(rest)

    def rooted(self, links: DataFrame | None = None) -> DataFrame:
        """The members with the root of their group, over the similar pairs and `links`."""
        roots = components(self.near if links is None else self.near.union(links.select("a", "b")), self.work)
        return self.members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of every document that has a near duplicate, its group's
    least id included; see the module for the defined results.

    With 40 bands of 4 rows, a pair is a candidate with probability 0.92 at
    similarity 0.5, 0.996 at 0.6 and above 0.9999 at 0.7."""
    c = Classes(_texts(docs, id_col, text_col), None, shingle, bands, rows, threshold)
    named = c.members.filter("absent = 0").select("id", "node")
    several = named.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("id", "a")
    links = named.join(several, "id").filter("a <> node").select("a", F.col("node").alias("b"))
    found = c.rooted(links).filter("absent = 0").select("id", "root").distinct()
    least = found.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return found.join(least, "root").select(F.col("id").alias("doc_id"), "group_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, without those that a group's least row, or an equal row, stands for.

    `earlier` holds the texts (same column names) that the documents had before some of their
    lines were taken out. A document is then judged by its earlier text; one without an id, or
    whose id has no earlier text or several, by its present one."""
    before = None if earlier is None else _texts(earlier, id_col, text_col)
    c = Classes(_texts(docs, id_col, text_col), before, shingle, bands, rows, threshold)
    rooted = c.work.save(c.rooted().select(*KEY, "copies", "root"), "rooted")
    kept = rooted.groupBy("root").agg(F.min(F.struct(*KEY)).alias("kept"))
    marked = rooted.join(kept, "root").withColumn("stays", F.struct(*KEY) == F.col("kept"))
    out = c.work.save(marked.filter("not stays or copies > 1").select(*[F.col(k).alias(f"__{k}") for k in KEY], "stays"), "out")
    c.work.keep(out)

    def same(df: DataFrame) -> Column:
        i = df[id_col].cast("long")
        return (i.isNull().cast("int") == F.col("__absent")) & (F.coalesce(i, F.lit(0)) == F.col("__id")) & (text_key(df[text_col].cast("string")) == F.col("__row"))

    rest = docs.join(out.drop("stays"), same(docs), "left_anti")
    again = out.filter("stays")
    if again.isEmpty():
        return rest
    # rows that repeat an id and a text: one of each, combined before the shuffle
    copies = docs.join(again, same(docs)).select(*[F.col(f"__{k}") for k in KEY], F.struct(*[docs[c] for c in docs.columns]).alias("__all"))
    one = copies.groupBy(*[f"__{k}" for k in KEY]).agg(F.min_by("__all", F.to_json("__all")).alias("__all"))
    return rest.unionByName(one.select("__all.*"))
