"""Slow, plain versions of the operators, and the rows that tests share."""

from __future__ import annotations

import re
from collections import defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of these names are used inside the operators.
CLASHING = ["id", "row", "pos", "gone", "__gone", "__gone_id", "__n_lines", "__normalised", "key", "hub", "root", "units", "order", "shard", "batch", "x", "y", "c0", "label", "keep"]


def documents(spark, rows, clashing=False):
    """Rows are (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clashing:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASHING])
    return df


def loaded(spark, sf_dir="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text):
    """Runs of ASCII letters, digits and non-ASCII characters, ASCII letters folded."""
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-z0-9\x80-\U0010ffff]+", text or "")]


def shingle_set(text, n=3):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(rows, threshold=0.5, n=3):
    """(similar pairs with their similarity, doc -> least id of its group) over all pairs."""
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    pairs = {(min(a, b), max(a, b)): j for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if x and y and a != b and (j := jaccard(x, y)) >= threshold}
    return pairs, components({i for i, _ in rows}, pairs)


def dedup_lines(rows):
    """[(doc_id, text, lines, dropped)] with each line kept where it is first by (doc_id, position)."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out.append((i, None, 0, 0))
            continue
        kept, n, dropped = [], 0, 0
        for line in text.split("\n"):
            bare = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", line)
            if bare:
                n += 1
                if bare in seen:
                    dropped += 1
                    continue
                seen.add(bare)
            kept.append(line)
        out.append((i, "\n".join(kept), n, dropped))
    return out


def normal(text):
    return " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "


def leaks(docs, items, n=13):
    """{(doc_id, item_id): number of the item's distinct word runs that the document holds}"""
    out = defaultdict(int)
    texts = [(i, normal(t)) for i, t in docs if t is not None]
    for item, text in items:
        w = normal(text or "").split()
        runs = {" " + " ".join(w[k : k + n]) + " " for k in range(max(1, len(w) - n + 1))} if w else set()
        for i, t in texts:
            if hits := sum(r in t for r in runs):
                out[i, item] = hits
    return dict(out)


def best_fit(lengths, capacity, open_bins):
    """[(item, start, units, bin)] by a scan over a plain list of the open bins."""
    out, bins, open_ = [], 0, []  # open_: (bin, free)
    for item, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            out.append((item, at, capacity, bins))
            bins, at = bins + 1, at + capacity
        need = length - at
        if not need:
            continue
        fitting = [(free, b) for b, free in open_ if free >= need]
        if fitting:
            free, b = min(fitting)
            open_.remove((b, free))
        else:
            if len(open_) == open_bins:
                free, b = min((free, b) for b, free in open_)
                open_.remove((b, free))
            b, free, bins = bins, capacity, bins + 1
        out.append((item, at, need, b))
        if free - need:
            open_.append((b, free - need))
    return out
