import random
import string
import tracemalloc

import numpy as np
import pytest
from brute import CLASHING, components, dedup_lines, documents, jaccard, loaded, near_groups, shingle_set, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.llm import line_dedup, superminhash
from sparrowdex.llm._tokens import Tokens, shingles
from sparrowdex.llm._work import Workspace

ODD = [(1, "a b\nsame line\n\n  same line \nend"), (2, None), (3, ""), (4, "same line\n other"), (4, "same line\n other"), (5, "\n \n"), (6, "end"), (None, "end\nnull id line"), (7, "Same line"), (8, "x " * 50_000 + "\ntail")]


def lines_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", *line_dedup.COUNTS).distinct().collect()), key=str)


def test_lines_match_brute_force(spark):
    docs = loaded(spark)
    got = lines_of(line_dedup.dedup_lines(docs, counts=True))
    assert got == sorted(dedup_lines([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (7, 2), (5, 4)])
def test_lines_odd_rows_and_any_batching(spark, batches, fanout):
    got = lines_of(line_dedup.dedup_lines(documents(spark, ODD), counts=True, batches=batches, fanout=fanout))
    # rows that repeat an id and a text are one document
    assert got == sorted(dedup_lines(list(dict.fromkeys(ODD))), key=str)


def test_lines_keep_columns_and_rows(spark):
    docs = documents(spark, ODD, clashing=True)
    out = line_dedup.drop_repeats(docs, batches=2)
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r[c] == f"kept {c}" for r in rows for c in CLASHING)
    ids = [r["doc_id"] for r in rows]
    assert ids.count(4) == 2 and 6 not in ids and 2 in ids and 3 in ids and 5 in ids  # 6 held only a repeat


def test_lines_empty_table(spark):
    docs = documents(spark, [])
    assert line_dedup.dedup_lines(docs).count() == 0 and line_dedup.drop_repeats(docs).count() == 0


def test_runs_compact(spark):
    work = Workspace(spark, "runs")
    runs = line_dedup.Runs(spark, work.path, 2, 2)
    for k in range(5):
        runs.add(spark.createDataFrame([(10 * k + j, j) for j in range(3)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    probe = spark.createDataFrame([(10, 0), (10, 1), (41, 1), (42, 2)], "h1 long, h2 long")
    assert [tuple(r) for r in runs.unseen(probe).collect()] == [(10, 1)]
    runs.close()


# SuperMinHash


def naive_signature(elements, m):
    """One element at a time, after the paper: a Fisher-Yates shuffle that advances with the level."""
    sig = [int(superminhash.EMPTY)] * m
    for e in elements:
        perm = list(range(m))
        for level in range(m):
            v, k = superminhash._draw(np.array([e], np.uint64), level, m)
            k = int(k[0])
            perm[level], perm[k] = perm[k], perm[level]
            sig[perm[level]] = min(sig[perm[level]], int(v[0]))
    return sig


@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), max_size=5), st.sampled_from([1, 3, 8, 32]))
@settings(max_examples=40, deadline=None)
def test_signatures_are_those_of_the_plain_algorithm(sets, m):
    doc = np.array([k for k, s in enumerate(sets) for _ in s], np.int64)
    got = superminhash.signatures(doc, np.array([e for s in sets for e in s], np.uint64), len(sets), m)
    assert got.tolist() == [naive_signature(s, m) for s in sets]


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        both, one, other = ([rng.getrandbits(64) for _ in range(rng.randint(20, 80))] for _ in range(3))
        sets = [both + one, both + other]
        doc = np.array([k for k, s in enumerate(sets) for _ in s])
        sig = superminhash.signatures(doc, np.array([e for s in sets for e in s], np.uint64), 2, 160)
        errors.append((sig[0] == sig[1]).mean() - len(both) / (len(both) + len(one) + len(other)))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.045


@given(st.lists(st.text(max_size=30), max_size=6), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_shingles(texts, n):
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    t = Tokens(np.frombuffer(b"".join(data), np.uint8), offs)
    d, h = shingles(t, n)
    for k, text in enumerate(texts):
        assert len(np.unique(h[d == k])) == len(shingle_set(text, n))
        assert int((t.doc == k).sum()) == len(words(text))


def test_groups_match_brute_force(spark):
    docs = loaded(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pairs, group = near_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in superminhash.groups(docs).collect()}
    found = [p for p in pairs if got.get(p[0], p[0]) == got.get(p[1], p[1])]
    assert pairs and len(found) >= 0.95 * len(pairs)
    assert all(got.get(a) == got.get(b) for (a, b), j in pairs.items() if j >= 0.75)
    # nothing is joined that brute force keeps apart
    assert all(group[i] == group[g] for i, g in got.items())


def test_groups_with_many_copies_and_chains(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    base = rng.choices(vocabulary, k=60)
    rows = [(k, " ".join(base)) for k in range(100, 400)]  # exact copies
    for k in range(40):  # near copies
        w = list(base)
        w[rng.randrange(60)] = "changed"
        rows.append((k + 1000, " ".join(w)))
    chain = rng.choices(vocabulary, k=400)
    rows += [(2000 + k, " ".join(chain[k * 10 : k * 10 + 100])) for k in range(30)]
    rows += [(3000 + k, " ".join(rng.choices(vocabulary, k=50))) for k in range(50)]
    _, group = near_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in superminhash.groups(documents(spark, rows)).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == group


def test_groups_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " .,! "), (9, text), (5, text.upper()), (5, text.upper()), (None, text), (7, text + "!"), (8, "alone"), (10, "word " * 200_000), (11, "word " * 200_000)]
    got = sorted(map(tuple, superminhash.groups(documents(spark, rows, clashing=True)).collect()))
    assert got == [(5, 5), (7, 5), (9, 5), (10, 10), (11, 10)]
    docs = documents(spark, rows, clashing=True)
    kept = superminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 8, 10]))
    assert superminhash.groups(documents(spark, [])).count() == 0 == superminhash.keep_one(documents(spark, [])).count()


def slow_keep_one(rows, threshold=0.5):
    """Rows (id, text) that stay: of each component of similar rows the first, null ids last."""
    rows = list(dict.fromkeys(r for r in rows if words(r[1])))
    sets = [shingle_set(t) for _, t in rows]
    group = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= threshold])
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(group[k], []).append((i is None, i or 0, t))
    return best


def test_rows_are_known_by_id_and_text(spark):
    """An id that repeats with another text loses neither; equal rows collapse, without an id too."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase, k=5)) for _ in range(500)]
    a, u, v, w = (" ".join(rng.choices(vocabulary, k=40)) for _ in range(4))
    near = v.replace(v.split()[20], "other")
    rows = [(1, a), (2, a), (2, u), (3, u.upper()), (4, v), (4, near), (5, near + " more"), (6, w), (6, w), (6, w), (None, w), (None, u + " tail"), (None, "nobody else's words at all"), (None, "nobody else's words at all"), (7, None), (7, None), (None, "")]
    rows += [(rng.choice([None, *range(10, 20)]), rng.choice([a, u, v, " ".join(rng.choices(vocabulary, k=30))])) for _ in range(60)]
    docs = documents(spark, rows, clashing=True).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in superminhash.keep_one(docs).collect()]
    plain = [r for r in rows if not words(r[1])]
    assert sorted((r for r in got if not words(r[1])), key=str) == sorted(plain, key=str)
    got = [r for r in got if words(r[1])]
    best = slow_keep_one(rows)
    assert len(got) == len(set(got)) == len(best)
    for i, t in got:  # one of each group: the one with the least id
        own = next(g for g in best.values() if (i is None, i or 0, t) in g)
        assert (i is None, i or 0) == min(g[:2] for g in own)
    assert (2, u) in got and (2, a) not in got and (6, w) in got and (None, w) not in got


def test_one_bucket_of_very_many_ids(spark):
    """10^6 copies of one text and 10^4 near ones share every bucket: a row per copy, no window, no pair per two copies."""
    text = " ".join(f"word{k}" for k in range(30))
    copies = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    near = spark.range(2_000_000, 2_010_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text + " tail"), F.col("id") % 50).alias("text"))
    found = superminhash.groups(copies.union(near))
    assert found.count() == 1_010_000 and found.select("group_id").distinct().collect() == [(0,)]
    assert "Window" not in found._jdf.queryExecution().toString()


def test_earlier_texts_count_too(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choices(string.ascii_lowercase, k=1)[0] + str(rng.randrange(999)) for _ in range(12))
    lines = [line() for _ in range(8)]
    before = [(1, "\n".join(lines)), (2, "\n".join(lines[:7] + [line()])), (3, line()), (4, line()), (5, line()), (5, line()), (6, line())]
    after = [before[0], (2, before[1][1].split("\n")[7]), before[2], (4, before[2][1]), (5, "left of the first"), (6, before[5][1]), (7, "left of the first")]
    kept = superminhash.keep_one(documents(spark, after), earlier=documents(spark, before))
    # 2 was a near copy of 1, 4 was none of 3; 5 has two earlier texts and is judged by its present one, as is 7, a copy of it
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert sorted(r["doc_id"] for r in superminhash.keep_one(documents(spark, after)).collect()) == [1, 2, 3, 5, 6]  # 4 resembles 3 by now


def test_a_repeated_word_holds_no_permutation_each():
    """One shingle, however often it occurs, gives the signature of its set in the memory of its tokens."""
    n = 500_000
    tracemalloc.start()
    got = superminhash.signatures(np.zeros(n, np.int64), np.full(n, 7, np.uint64), 1, 160)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == superminhash.signatures(np.zeros(1, np.int64), np.full(1, 7, np.uint64), 1, 160)).all()
    assert peak < 200 * n


def test_pairs_across_components(spark):
    rng = random.Random(4)
    rows = [(key, node, node % roots) for key, roots in ((1, 2), (2, 5), (3, 1)) for node in rng.sample(range(200), 40)]
    rows += [(4, node, 0) for node in range(300, 330)] + [(4, 400, 1), (4, 401, 1), (4, 402, 2)]
    want = {(a, b) for k, a, r in rows for j, b, s in rows if k == j and r != s and a < b}
    assert sorted(map(tuple, superminhash._across(spark.createDataFrame(rows, "key long, node long, root long")).collect())) == sorted(want)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r["node"]: r["root"] for r in superminhash.components(spark.createDataFrame(edges, "a long, b long").repartition(7), Workspace(spark, "components")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}


def test_jaccard_helper():
    assert jaccard({1, 2}, {2, 3}) == 1 / 3
