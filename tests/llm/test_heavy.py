from collections import Counter

import numpy as np
import pandas as pd
from brute import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.llm import toxicity
from sparrowdex.llm._heavy import Heavy, merged


@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=8), st.integers(1, 12), st.booleans())
@settings(max_examples=200, deadline=None)
def test_no_frequent_item_is_lost(parts, size, apart):
    whole, true = Heavy(size), Counter()
    for p in parts:
        item, n = np.unique(np.array(p, np.uint64), return_counts=True)
        true.update(p)
        target = Heavy(size) if apart else whole
        target.add(item, n, lambda at: [f"w{i}" for i in item[at]])
        if apart:
            whole.merge(target.item, target.count, target.word, target.total)
    assert whole.total == true.total() and len(whole.item) <= size
    kept = dict(zip(whole.item.tolist(), whole.count.tolist()))
    lost = (whole.total - sum(kept.values())) / (size + 1)
    for i, n in true.items():
        assert n - lost <= kept.get(i, 0) <= n
    assert whole.word.tolist() == [f"w{i}" for i in whole.item]


def test_levels_merge_everything(spark):
    parts = spark.range(500).select((F.col("id") % 3).alias("k"), F.lit(1).cast("long").alias("v"), (F.col("id") * 0).alias("z")).drop("z").repartition(300)
    add = lambda pdf: pd.DataFrame({"k": pdf["k"].iloc[:1], "v": [pdf["v"].sum()]})
    got = merged(parts, "k", "k long, v long", add, 300)
    assert sorted(map(tuple, got.collect())) == [(0, 167), (1, 167), (2, 166)]
    got = merged(parts, "k", "k long, v long", add, 3)  # more tasks than thought: still one row for each key
    assert sorted(map(tuple, got.collect())) == [(0, 167), (1, 167), (2, 166)]


def test_candidates_hold_every_frequent_word(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 5000) for _ in range(400)]
    docs = documents(spark, list(enumerate(texts))).repartition(5).select("text", "lang")
    df = Counter(w for t in texts for w in set(words(t)))
    want = {w for w, n in df.items() if n >= 0.02 * len(texts)}
    for counters in (20, 3000, 1 << 15):  # the first is too few: the pass is repeated
        n, found = toxicity.candidates(docs, 0.02, counters)
        assert n == {"en": 400} and want <= set(found["en"])
