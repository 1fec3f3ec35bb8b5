import random
from collections import defaultdict

import pytest
from brute import CLASHING, best_fit, components, dedup_lines, documents, leaks, loaded, near_groups
from compare import database, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparrowdex.llm import packing, quality_model, superminhash

SF = "/root/testdata/sf0.001"


@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 20), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_packing_is_that_of_a_plain_scan(lengths, capacity, open_bins):
    got, bins = packing.pack(lengths, capacity, open_bins)
    assert got == best_fit(lengths, capacity, open_bins)
    assert bins == len({b for *_, b in got})


def packed(df, capacity):
    """Checks that nothing overflows, is lost or lies twice; returns (doc -> units, bin fills)."""
    fill, own = defaultdict(int), defaultdict(list)
    for r in df.collect():
        fill[r["bin_id"]] += r["units"]
        own[r["doc_id"]].append((r["start"], r["units"]))
    assert all(0 < f <= capacity for f in fill.values())
    return own, fill


def test_packing_covers_every_text(spark):
    docs = loaded(spark)
    own, fill = packed(packing.best_fit(docs, shard_rows=70), packing.CAPACITY)
    want = {r["doc_id"]: r["n"] for r in docs.select("doc_id", (F.octet_length("text") + 1).alias("n")).collect()}
    assert own.keys() == want.keys()
    for i, parts in own.items():
        at = 0
        for start, units in sorted(parts):
            assert start == at
            at += units
        assert at == want[i]
    shards = 3
    assert sum(f < packing.CAPACITY * 0.9 for f in fill.values()) <= shards * packing.OPEN_BINS


def test_packing_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "x"), (None, "x"), (4, "y" * 100_000)]
    own, _ = packed(packing.best_fit(documents(spark, rows, clashing=True)), packing.CAPACITY)
    assert own[1] == [(0, 1)] and own[2] == [(0, 1)] and own[3] == [(0, 4)] * 2 and own[None] == [(0, 2)] * 2 and sum(u for _, u in own[4]) == 100_001
    assert packing.best_fit(documents(spark, [])).count() == 0
    odd = packing.best_fit(documents(spark, rows), length=F.when(F.col("doc_id") == 3, -5).when(F.col("doc_id") == 4, F.lit(None)).otherwise(7))
    own, _ = packed(odd, packing.CAPACITY)
    assert own[3] == [(0, 1)] * 2 and own[4] == [(0, 1)] and own[1] == [(0, 7)]
    same = documents(spark, [(7, "the same")] * 500 + [(None, f"text {k % 3}") for k in range(500)])
    out = packing.best_fit(same, shard_rows=100)
    assert out.count() == 1000 and out.groupBy(F.col("bin_id") % 10).count().filter("count > 300").count() == 0  # no shard gets all
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            packing.pack([1], *bad)


def test_pipeline_matches_brute_force(spark):
    docs = loaded(spark)
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = quality_model.fit(docs, labels)
    good = {r["doc_id"] for r in quality_model.scores(docs, model).filter("keep").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    lines = [(i, t) for i, t, n, dropped in dedup_lines(rows) if n == 0 or dropped < n]
    left = {i for i, _ in lines}
    _, group = near_groups([r for r in rows if r[0] in left])  # by the texts before lines were taken out
    once = [(i, t) for i, t in lines if group[i] == i]
    leaky = {d for d, _ in leaks(once, [(r["item_id"], r["text"]) for r in bench.collect()])}
    want = {i: len(t.encode()) + 1 for i, t in once if i not in leaky}
    own, _ = packed(corpus_pipeline.run(spark, SF), packing.CAPACITY)
    assert {i: sum(u for _, u in parts) for i, parts in own.items()} == want
    assert len(want) < len(once) < len(lines) <= len(rows) < docs.count()


def test_pipeline_stages_keep_columns_and_survive_odd_tables(spark):
    rng = random.Random(1)
    plain = [(100 + k, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega"], k=40))) for k in range(5)]
    rows = [(1, None), (2, ""), (None, "null id"), (3, "same text here and more"), (3, "same text here and more"), (4, "long " * 50_000), *plain]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for table in (rows, []):
        docs = documents(spark, table, clashing=True)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != names[-1]:
                assert out.columns == docs.columns, name
                docs = out
        assert out.columns == ["bin_id", "doc_id", "start", "units"]
        assert (out.count() > 0) == bool(table)


def test_near_duplicates_by_the_texts_that_line_dedup_leaves(spark, tmp_path):
    """What line dedup leaves counts too: texts that resemble each other only then don't both go on."""
    rng = random.Random(6)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    shared, left, near = line(300), line(60), line(40)
    before = [(1, f"{line(200)}\n{left}"), (2, f"{line(200)}\n{left} tail"), (3, f"{near}\n{shared}"), (4, f"{line(30)}\n{shared}"), (5, line(50))]
    after = [(1, left), (2, f"{left} tail"), (3, before[2][1]), (4, before[3][1].split("\n")[0]), (5, before[4][1])]
    documents(spark, before).write.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, documents(spark, after, clashing=True), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5]  # 4 was a near copy of 3


def test_registered_queries(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    ours = [q for q in queries if q.startswith("op") and q[2].isdigit()]
    assert [int(q[2:].split("_")[0]) for q in ours] == list(range(1, 11)) and "pipeline" in queries
    con = database(SF)
    for name in ours:
        if name in sql:
            assert differences(queries[name](spark, SF), con, sql[name]) == [], name


def test_groups_across_two_texts_of_one_id(spark):
    a, b = ("one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen")
    got = {r["doc_id"]: r["group_id"] for r in superminhash.groups(documents(spark, [(1, a), (2, a), (2, b), (3, b)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1} and components({1, 2}, [(1, 2)]) == {1: 1, 2: 1} and CLASHING
