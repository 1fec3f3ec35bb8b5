import json
import os
import random
import shutil
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from compare import database, differences
from pyspark.sql import functions as F

from sparrowdex import queries as core
from sparrowdex.__main__ import main
from sparrowdex.operators import maintain
from sparrowdex.operators.index import build
from sparrowdex.operators.search import search
from sparrowdex.settings import Settings
from sparrowdex.sources.elements import elements

from sparrowdex.sources.store import JdbcStore, MemoryStore, ParquetStore, StoreLocked, open_store
from sparrowdex.streaming.incremental import index_stream

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def rows(spark, titles):
    df = spark.createDataFrame(titles, "site int, id long, title string, seq int")
    return elements(df, "entry", F.col("id"), F.col("site"), F.col("title"), keep=["seq"])


def contents(index):
    return sorted(map(tuple, index.postings.collect()))


FIRST = [(1, 1, "alpha one", 0), (1, 2, "beta two", 0), (2, 1, "gamma", 0)]


def test_versions_and_pointer(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        store.read()
    built = build(rows(spark, FIRST).drop("seq"))
    live = store.write(built)
    assert contents(live) == contents(built) and store.versions() == [1]
    assert live.counted == tuple(built.totals().first()) and sorted(r["term"] for r in store.document(1, 1).collect()) == ["alpha", "one"]
    for k in range(3):
        maintain.rebuild(rows(spark, [(1, k + 1, "delta", 0)]).drop("seq"), store)
    assert store.versions() == [3, 4] and store.current() == 4
    assert [r["element_id"] for r in search(store.read(), "delta").collect()] == [3]
    plan = store.read().postings.filter("site_id = 1 and term = 'delta'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and "EqualTo(term,delta)" in plan
    store.drop()
    assert store.current() is None


def test_locks(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    index = build(rows(spark, FIRST).drop("seq"))
    with store._lock():
        for blocked in (lambda: store.write(index), lambda: store.write_site(index, 1)):
            with pytest.raises(StoreLocked):
                blocked()
    with store._lock(1):  # another site may be written, the same or the whole store not
        assert store.write_site(index, 2).doc_stats.count() == 1
        for blocked in (lambda: store.write_site(index, 1), lambda: store.write(index)):
            with pytest.raises(StoreLocked):
                blocked()
    assert not [n for n in store._names() if "lock" in n]
    store._take("_lock")  # a writer that died
    assert ParquetStore(spark, str(tmp_path), lock_ttl=-1.0).write(index).doc_stats.count() == 3
    with pytest.raises(StoreLocked), store._lock():  # a lock that someone else took over isn't removed
        store._put("_lock", "someone else", True)
    assert store._owner("_lock") == "someone else"


def test_segments_are_like_one_index(spark, tmp_path):
    """Random upserts, deletions and site rebuilds, merged by level, against an index made anew."""
    rng = random.Random(5)
    store = ParquetStore(spark, str(tmp_path / "index"), fanout=2)
    now = {(s, i): f"word{i} start" for s in (1, 2) for i in range(1, 6)}
    store.write(build(rows(spark, [(*k, t, 0) for k, t in now.items()]).drop("seq")))
    for step in range(7):
        if step == 4:
            now = {k: t for k, t in now.items() if k[0] != 2} | {(2, 9): "site anew"}
            maintain.rebuild(rows(spark, [(*k, t, 0) for k, t in now.items()]).drop("seq"), store, site_id=2)
            continue
        change = {(rng.randrange(1, 4), rng.randrange(1, 8)): rng.choice(["", "0", "the new one", f"word{step} again"]) for _ in range(4)}
        store.upsert(rows(spark, [(*k, t, step) for k, t in change.items()]), order="seq")
        now = {k: t for k, t in (now | change).items() if t not in ("", "0")}
    index, want = store.read(), build(rows(spark, [(*k, t, 0) for k, t in now.items()]).drop("seq"))
    assert len(store._manifest()["segments"]) < 5
    names = lambda df: sorted(map(tuple, df.collect()))
    assert contents(index) == contents(want) and names(index.doc_stats) == names(want.doc_stats)
    assert names(index.term_dict.select("site_id", "term", "doc_freq", "ngram_count")) == names(want.term_dict.select("site_id", "term", "doc_freq", "ngram_count"))
    assert index.counted == tuple(want.totals().first())
    assert [tuple(r) for r in search(index, "word").collect()] == [tuple(r) for r in search(want, "word").collect()]
    assert contents(store.delete(spark.createDataFrame([(2, 9)], "site_id int, element_id long"))) == [r for r in contents(want) if r[:2] != (2, 9)]
    before = store.current()
    assert store.upsert(rows(spark, []), order="seq").counted and store.current() == before  # nothing to write


def test_settings_and_schema_are_stored(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "index"))
    store.write(build(rows(spark, FIRST).drop("seq"), Settings(ngram_sizes=(2,), title_boost=2.0)))
    assert store.read().settings == Settings(ngram_sizes=(2,), title_boost=2.0)
    assert store.read(Settings(ngram_sizes=(2,), title_boost=7.0)).settings.title_boost == 7.0
    with pytest.raises(ValueError):
        store.read(Settings())
    m = store._manifest() | {"schema": 1}
    store._put(f"current.{store.current() + 1}", json.dumps(m), True)
    with pytest.raises(ValueError):
        store.read()


def test_jdbc_store_keeps_what_it_has(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    store = JdbcStore(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, partitions=2)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert contents(store.write(build(rows(spark, FIRST).drop("seq")))) == contents(build(rows(spark, FIRST).drop("seq")))
    for k, word in enumerate(("delta", "epsilon", "zeta")):  # each upsert reads what the last one wrote
        index = store.upsert(rows(spark, [(1, 10 + k, word, k)]), order="seq")
    assert {(r[1], r[2]) for r in contents(index)} == {(1, "alpha"), (1, "one"), (2, "beta"), (2, "two"), (1, "gamma"), (10, "delta"), (11, "epsilon"), (12, "zeta")}
    assert [r["element_id"] for r in search(index, "epsilon").collect()] == [11] and index.counted == tuple(index.doc_stats.groupBy().agg(F.count("*"), F.sum("doc_len")).first())
    assert len(store._versions()) == 2
    store._do(f"CREATE TABLE {store.prefix}lock (n INTEGER)")
    with pytest.raises(StoreLocked):
        store.write(index)
    store._do(f"DROP TABLE {store.prefix}lock")
    store.drop()
    with pytest.raises(FileNotFoundError):
        store.read()


def test_statistics_command(spark, tmp_path, capsys):
    ParquetStore(spark, str(tmp_path / "index")).write(build(rows(spark, FIRST).drop("seq")))
    assert main(["stats", "--driver", "parquet", "--path", str(tmp_path / "index"), "--detailed"]) == 0
    said = capsys.readouterr().out
    assert "total_docs 3" in said and "top_terms:" in said and "term alpha" in said


def test_memory_store_and_factory(spark, tmp_path, monkeypatch):
    store = open_store(spark, "memory")
    assert isinstance(store, MemoryStore)
    with pytest.raises(FileNotFoundError):
        store.read()
    assert contents(store.write(build(rows(spark, FIRST).drop("seq")))) == contents(store.read())
    for k in range(3):  # each made from the one before, which is let go
        index = store.upsert(rows(spark, [(1, 7, f"delta{k}", k)]), order="seq")
    assert {r[2] for r in contents(index) if r[1] == 7} == {"delta2"} and index.counted[0] == 4
    maintain.rebuild(rows(spark, [(2, 3, "omega", 0)]).drop("seq"), store, site_id=2)
    assert {r[2] for r in contents(store.read()) if r[0] == 2} == {"omega"}
    store.drop()
    monkeypatch.setenv("SPARROWDEX_STORE", "parquet")
    monkeypatch.setenv("SPARROWDEX_PATH", str(tmp_path))
    assert open_store(spark, "memory").path == str(tmp_path)
    monkeypatch.setenv("SPARROWDEX_STORE", "other")
    with pytest.raises(ValueError):
        open_store(spark)


def test_stream_applies_changes_in_order_and_again(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "index"))
    store.write(build(rows(spark, FIRST).drop("seq")))
    source = tmp_path / "changes"
    rows(spark, [(1, 1, "late", 9), (1, 1, "early", 3), (1, 5, "five", 1)]).coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    for _ in range(2):  # the second start finds nothing new
        index_stream(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "check")).awaitTermination()
    assert [(r[1], r[2]) for r in contents(store.read())] == [(1, "late"), (2, "beta"), (2, "two"), (5, "five"), (1, "gamma")]
    # a change that is older than the one applied, in a later batch
    rows(spark, [(1, 1, "older still", 5)]).coalesce(1).write.mode("append").parquet(str(source))
    index_stream(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "check")).awaitTermination()
    assert [r[2] for r in contents(store.read()) if r[:2] == (1, 1)] == ["late"]
    rows(spark, [(1, 5, "", 2)]).coalesce(1).write.mode("append").parquet(str(source))
    index_stream(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "check")).awaitTermination()
    assert 5 not in {r[1] for r in contents(store.read())}


def test_settings_travel_with_the_index(spark):
    index = build(rows(spark, FIRST).drop("seq"), Settings(ngram_sizes=(2,), title_boost=1.0))
    assert {len(g) for r in index.term_dict.collect() for g in r["ngrams"]} == {2}
    assert search(index, "gamma", 2).first()["score"] * 5 == pytest.approx(search(build(rows(spark, FIRST).drop("seq")), "gamma", 2).first()["score"])


@pytest.mark.parametrize("name", core.queries())
def test_queries_match_their_sql(spark, name):
    assert differences(core.queries()[name](spark, SF), database(SF), core.oracle_sql()[name]) == []


def test_rest_works_without_the_optional_parts(tmp_path):
    """Import and registration, with the llm folders and the pipeline deleted."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(q) == set(e.oracle_sql()) and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": ""})


def test_build_moves_texts_and_not_words(spark):
    rows = spark.createDataFrame([(1, "oil oil", "Oil of Oil"), (1, "the oil salt", "Salt"), (2, "", "Rose"), (3, "of", None)], "id long, body string, title string")
    made = build(elements(rows, "entry", F.col("id"), 1, F.col("title"), {"body": F.col("body")}, has_titles=False))
    plan = made.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    got = {(r["element_id"], r["term"]): (r["freq"], r["in_title"], r["doc_len"]) for r in made.postings.collect()}
    # rows of one element are one: its words add up, those of its titles count where nothing else has them
    assert got == {(1, "oil"): (3, True, 5), (1, "salt"): (1, True, 5), (1, "of"): (1, True, 5), (2, "rose"): (1, True, 1)}
