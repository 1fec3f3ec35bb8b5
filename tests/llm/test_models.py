import random

import numpy as np
import pyarrow as pa
import pytest
from brute import documents, loaded, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.llm import langid, quality_model, quality_rules, toxicity
from sparrowdex.llm._tokens import CASED, RUNS, Tokens, chunks

LABELS = "doc_id long, quality int, toxic int"


def labels_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def halves(spark, sf_dir):
    """(all documents, labels to fit on, labels held out)"""
    labels = labels_of(spark, sf_dir)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    return loaded(spark, sf_dir), labels.filter(~held), labels.filter(held)


ODD = [(1, None, "en"), (2, "", "en"), (3, " ", None), (None, "the and of to", "en"), (4, "some words here", "xx"), (4, "some words here", "xx"), (5, "the of " * 100_000, "en"), (6, "?!", "en")]

# Quality classifier


def test_word_table_is_the_sum_of_context_vectors(spark):
    texts = ["a b, c a", "b", "", None, "b c B é"]
    table = quality_model.word_table(documents(spark, list(enumerate(texts))).repartition(3), buckets=64, dim=8, nonzero=2, window=2)
    place, sign = quality_model.index_vectors(64, 8, 2)
    want = np.zeros((64, 8))
    for t in texts:
        data = (t or "").encode()
        b = quality_model._bucket(Tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), RUNS, CASED), 64)
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    for k in range(2):
                        want[b[i], place[b[j], k]] += sign[b[j], k]
    norm = np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(table[:, :8], want / norm, atol=1e-6)


def test_quality_on_held_out_documents(spark):
    docs, fit_on, held = halves(spark, "/root/testdata/sf0.01")
    got = quality_model.scores(docs, quality_model.fit(docs, fit_on)).join(held, "doc_id").filter("probability is not null").toPandas()
    assert len(got) > 80 and ((got.probability > 0.5) == (got.quality == 1)).mean() > 0.93
    assert got[got.quality == 1].keep.mean() > 0.98
    # calibration: mean probability near the share of good ones
    assert abs(got.probability.mean() - got.quality.mean()) < 0.1


def test_quality_odd_rows(spark):
    docs, labels = loaded(spark, "/root/testdata/sf0.01"), labels_of(spark, "/root/testdata/sf0.01")
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (0, None, 0), (10**9, 1, 0)], LABELS))
    model = quality_model.fit(docs, odd_labels)
    odd = documents(spark, ODD, clashing=True)
    rows = quality_model.scores(odd, model).collect()
    assert len(rows) == len(ODD) and all((r["probability"] is None) == (r["doc_id"] in (1, 2, 3)) for r in rows)
    kept = quality_model.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 6}  # too little evidence to reject
    unknown = quality_model.fit(odd, labels.filter("false"))
    assert all(r["probability"] is None and r["keep"] for r in quality_model.scores(odd, unknown).collect())
    empty = documents(spark, [])
    assert quality_model.scores(empty, quality_model.fit(empty, labels)).count() == 0


# Language ID


def test_languages_on_held_out_documents(spark):
    docs = loaded(spark, "/root/testdata/sf0.01")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = langid.fit(docs.filter(~held))
    got = langid.identify(docs.filter(held), model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars >= 50").toPandas()
    assert len(got) > 200 and (got.predicted == got.lang).mean() > 0.98
    assert (got.family == got.predicted.map(langid.FAMILIES)).all()


def test_languages_in_one_family():
    rng = np.random.default_rng(1)
    names = np.array(["a", "b", "c", "d"] * 50, dtype=object)
    x = rng.normal(0, 0.1, (200, 16)).astype(np.float32)
    x[np.arange(200), [{"a": 0, "b": 1, "c": 2, "d": 3}[n] for n in names]] += 1
    model = langid.LanguageModel(x, names, {"a": "one", "b": "one", "c": "one", "d": "two"})
    assert model.family.names == ["one", "two"] and len(model.within[0].pairs) == 3
    best, _ = model.within[0].predict(x[:3])
    assert best.tolist() == [0, 1, 2]


def slow_features(text, dim):
    """Counts of byte runs in a dictionary, their hashes in plain integers."""
    low = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    folded = [b + 1 if b >= 128 or chr(b).isalnum() else 0 for b in low]
    mask, counts = (1 << 64) - 1, {}
    for size in (1, 2, 3):
        for k in range(len(folded) - size + 1):
            run = folded[k : k + size]
            if run[0] or run[-1]:
                x = size
                for b in run:
                    x = (x * 257 + b) & mask
                x = x * 0x9E3779B97F4A7C15 & mask
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
                key = ((x ^ x >> 31) >> 20) % dim
                counts[key] = counts.get(key, 0) + 1
    norm = sum(counts.values()) ** 0.5
    return {k: n**0.5 / norm for k, n in counts.items()} if any(folded) else None


def slow_vote(x, machines):
    names, k = machines.names, len(machines.names)
    votes, margin = [0] * k, [0.0] * k
    for j, (a, b) in enumerate(machines.pairs):
        m = sum(v * machines.w[i, j] for i, v in x.items()) + machines.w[-1, j]
        votes[a if m >= 0 else b] += 1
        margin[a] += m
        margin[b] -= m
    best = max(range(k), key=lambda i: (votes[i], margin[i], -i))
    return best, names[best], margin[best] / max(1, k - 1)


def test_languages_match_plain_features_and_votes(spark):
    docs = loaded(spark).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    model = langid.fit(docs)
    assert model.family.names == ["germanic", "romance", "xx"]  # a language of no family is its own
    odd = documents(spark, ODD).select("doc_id", "text").union(docs.select("doc_id", "text"))
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    want = []
    for i, text in rows:
        if (x := slow_features(text, langid.DIM)) is None:
            want.append((i, None, None, None))
        else:
            k, family, _ = slow_vote(x, model.family)
            want.append((i, family, *slow_vote(x, model.within[k])[1:]))
    got = {(r["doc_id"], r["family"], r["predicted"], r["margin"] and round(r["margin"], 4)) for r in langid.identify(odd.distinct(), model).collect()}
    assert sorted(got, key=str) == sorted({(i, f, p, m and round(m, 4)) for i, f, p, m in want}, key=str)


def test_languages_are_learned_from_few_rows_of_repeated_ids(spark):
    rows = [(1, f"le la les {k}", "fr") for k in range(300)] + [(10 + k, "the of and to", "en") for k in range(5)] + [(20 + k, "der die das", "de") for k in range(4)]
    docs = documents(spark, rows)
    model = langid.fit(docs, max_train=8)
    assert [m.names for m in model.within] == [["de", "en"], ["fr"]]
    assert langid.fit(docs, max_languages=2).family.names == ["germanic"]  # en and de have the most ids


def test_languages_odd_rows(spark):
    docs = loaded(spark)
    odd = documents(spark, ODD, clashing=True)
    rows = langid.identify(odd, langid.fit(docs)).collect()
    assert len(rows) == len(ODD) and all((r["predicted"] is None) == (r["doc_id"] in (1, 2, 3, 6)) for r in rows)
    empty = documents(spark, [])
    assert langid.identify(empty, langid.fit(docs)).count() == 0
    assert all(r["predicted"] is None for r in langid.identify(odd, langid.fit(empty)).collect())
    only = langid.fit(docs.filter("lang = 'fr'"))
    assert {r["predicted"] for r in langid.identify(odd, only).collect()} == {None, "fr"}


# Distribution rules


def slow_distances(rows, common):
    """[(chars, words, char distance, word distance)] from plain dictionaries; rows are (text, lang)."""
    from collections import Counter
    from math import log2, sqrt

    def kind(c):
        return "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "space" if c in " \t\n\x0b\f\r" else "other" if ord(c) > 127 else "punct"

    def distance(p, q):
        sp, sq = sum(p.values()), sum(q.values())
        if not sp or not sq:
            return None
        d = 0
        for k in p.keys() | q.keys():
            a, b = p.get(k, 0) / sp, q.get(k, 0) / sq
            d += (a * log2(2 * a / (a + b)) if a else 0) + (b * log2(2 * b / (a + b)) if b else 0)
        return sqrt(max(d / 2, 0))

    chars, uses = {}, {}
    for text, lang in rows:
        chars.setdefault(lang, Counter()).update(map(kind, text or ""))
        uses.setdefault(lang, Counter()).update(words(text))
    known = {x: {w for w, n in c.items() if n >= common * c.total()} for x, c in uses.items()}

    def fold(c, lang):
        out = Counter()
        for w, n in c.items():
            out[w if w in known[lang] else None] += n
        return out

    out = []
    for text, lang in rows:
        c, w = Counter(map(kind, text or "")), Counter(words(text))
        out.append((c.total(), w.total(), distance(c, chars[lang]), distance(fold(w, lang), fold(uses[lang], lang))))
    return out


def test_divergence_matches_brute_force(spark):
    own = documents(spark, ODD)
    docs = loaded(spark).select("doc_id", "text", "lang", "source", "n_chars").union(own)
    got = sorted((str(r["doc_id"]), r["n_chars"], r["n_words"], r["char_distance"], r["word_distance"]) for r in quality_rules.divergence(docs.repartition(5)).collect() if r["word_distance"] is not None)
    rows = [(r["doc_id"], r["text"], r["lang"] or "") for r in docs.collect()]
    want = sorted((str(i), *x) for (i, _, _), x in zip(rows, slow_distances([r[1:] for r in rows], quality_rules.COMMON)) if x[3] is not None)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=2e-6)


def test_many_languages_and_those_without_a_reference(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices([f"w{k % 40}x{j}" for j in range(60)], k=200)), f"l{k % 40}") for k in range(400)] + [(900, "alone " * 60, "rare"), (901, None, "never")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in quality_rules.divergence(docs).collect()}
    plain = slow_distances([r[1:] for r in rows], quality_rules.COMMON)
    assert np.allclose([got[k]["word_distance"] for k in range(400)], [plain[k][3] for k in range(400)], atol=2e-6)
    few = {r["doc_id"]: r for r in quality_rules.divergence(docs, max_languages=40).collect()}
    assert few[900]["word_distance"] is None and few[900]["char_distance"] is None and few[900]["keep"] and few[901]["keep"] and [few[k] for k in range(400)] == [got[k] for k in range(400)]
    # what a piece of texts needs doesn't grow with the languages
    import tracemalloc

    peak = []
    data = " ".join(f"w{j}" for j in range(20)).encode() * 3000
    offs = np.arange(3001) * (len(data) // 3000)
    for n in (4, 400):
        names = [f"l{k:03}" for k in range(n)]
        ref = quality_rules.Reference({x: [1] * 6 for x in names}, dict.fromkeys(names, 10_000), {x: {int(h): 100 for h in np.arange(80, dtype=np.uint64) * np.uint64(7919)} for x in names})
        tracemalloc.start()
        ref.distances(np.frombuffer(data, np.uint8), offs, np.arange(3000) % n)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 1.5 * peak[0]


def test_more_languages_than_are_judged_at_once(spark):
    """Every language has a reference of its own, however many there are."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices([f"w{k % 300}x{j}" for j in range(9)], k=20)), f"l{k % 300}") for k in range(600)] + [(None, "no id " * 9, "l7"), (600, None, "l8"), (601, "", None), (602, "x y", "")]
    got = sorted((str(r["doc_id"]), r["n_chars"], r["n_words"], r["char_distance"] or 0, r["word_distance"] or 0) for r in quality_rules.divergence(documents(spark, rows)).collect())
    plain = slow_distances([(t, x or "") for _, t, x in rows], quality_rules.COMMON)
    want = sorted((str(i), c, w, cd or 0, wd or 0) for (i, _, _), (c, w, cd, wd) in zip(rows, plain))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=2e-6)
    few = quality_rules.divergence(documents(spark, rows[:60]), at_once=25).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, quality_rules.divergence(documents(spark, rows[:60])).collect()))


def test_divergence_odd_rows(spark):
    odd = documents(spark, ODD, clashing=True)
    rows = {r["doc_id"]: r for r in quality_rules.divergence(odd).collect()}
    assert rows[1]["char_distance"] is None and rows[2]["word_distance"] is None and rows[1]["keep"] and rows[2]["keep"] and rows[6]["keep"]
    assert quality_rules.divergence(documents(spark, [])).count() == 0


def test_divergence_drops_junk_only(spark):
    docs = loaded(spark, "/root/testdata/sf0.01")
    got = quality_rules.divergence(docs).join(labels_of(spark, "/root/testdata/sf0.01"), "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.99 and got[got.quality == 0].keep.mean() < 0.5


# Toxicity


def test_cooccurrence_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["aa", "bb", "cc", "dd", "zz"], k=rng.randrange(30))), rng.choice(["en", "de"])) for k in range(40)] + [(99, None, "en")]
    docs = documents(spark, rows).repartition(3).select("text", "lang")
    vocabulary = toxicity.Vocabulary({"de": ["aa", "cc"], "en": ["aa", "bb", "dd"]})
    want = {}
    for _, text, lang in rows:
        w, own = words(text), {"de": ["aa", "cc"], "en": ["aa", "bb", "dd"]}[lang]
        # the window is over all tokens, by distance between vocabulary words
        at = [(i, own.index(x)) for i, x in enumerate(w) if x in own]
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                if at[b][0] - at[a][0] <= 3:
                    x, y = at[a][1], at[b][1]
                    pair = (lang, min(x, y), max(x, y))
                    want[pair] = want.get(pair, 0) + 1
    for cells in (5, 1000):  # several passes, or one
        got = {}
        for lang, (x, y, n) in zip(("de", "en"), toxicity.cooccurrence(docs, vocabulary, 3, cells)):
            got |= {(lang, int(a), int(b)): int(c) for a, b, c in zip(x, y, n)}
        assert got == want


@given(st.lists(st.text(alphabet="ab é", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_words_of_each_document_once(texts):
    column = pa.array(texts, pa.string())
    for lo, hi, data, offs in chunks(column):
        t = Tokens(data, offs)
        assert t.doc.tolist() == (np.searchsorted(offs, t.start, side="right") - 1).tolist()
        order, start = toxicity._once(t)
        assert sorted(order.tolist()) == list(range(len(t.doc)))
        got = [(int(t.doc[k]), int(t.hash[k])) for k in order[start]]
        assert len(got) == len(set(got)) and set(got) == set(zip(t.doc.tolist(), t.hash.tolist()))


def test_walk_and_ppmi():
    edges = (np.array([0, 1, 3]), np.array([1, 2, 3]), np.array([8, 2, 1]))
    x, y, w = toxicity.ppmi(edges, 4, doubt=0)
    total, margin = 21, np.array([8, 10, 2, 1]) / 21  # 8 and 2 in both directions, 1 on the diagonal
    assert (x.tolist(), y.tolist()) == ([0, 1], [1, 2]) and np.allclose(w, [np.log2(8 / total / margin[0] / margin[1]), np.log2(2 / total / margin[1] / margin[2])])
    weights = (np.array([0, 1]), np.array([1, 2]), np.array([3.0, 1.0]))
    p = toxicity.walk(weights, 4, np.array([0]), steps=400)
    m = np.zeros((4, 4))
    m[weights[0], weights[1]] = weights[2]
    m += m.T
    step = np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros((4, 4)), where=m.sum(axis=1, keepdims=True) > 0)
    s = np.array([1.0, 0, 0, 0])
    want = 0.15 * np.linalg.solve(np.eye(4) - 0.85 * step.T, s)
    assert np.allclose(p, want, atol=1e-9) and p[3] == 0


def test_toxic_documents_are_found(spark):
    """Half of the toxic words are never in a labelled document: only the graph ties them to the seeds."""
    rng = random.Random(8)
    clean = [f"word{k}" for k in range(400)]
    bad = [f"vile{k}" for k in range(12)]
    rows, labels = [], []
    for k in range(1500):
        toxic = k % 10 == 0
        labelled = k < 600
        pool = bad[:6] if labelled else bad
        text = rng.choices(clean, k=60)
        if toxic:
            for _ in range(6):
                text.insert(rng.randrange(20, 40), rng.choice(pool))
        rows.append((k, " ".join(text), "en"))
        if labelled:
            labels.append((k, 1, int(toxic)))
    docs = documents(spark, rows)
    lexicon = toxicity.induce(docs, spark.createDataFrame(labels, LABELS))
    assert set(lexicon.entries["en"]) >= set(bad) and len([w for w in lexicon.entries["en"] if w.startswith("word")]) <= 4
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, lexicon).collect()}
    assert np.mean([got[k] for k in range(600, 1500) if k % 10 == 0]) > 0.95
    assert np.mean([got[k] for k in range(1500) if k % 10]) < 0.01
    # seeds are cut into tokens and folded like texts
    given = toxicity.induce(docs, seeds={"en": ([f"{bad[0].upper()}, {bad[1]}", bad[2], "", None, "ÉVIL"], clean[:10]), "xx": (["none"], [])})
    assert set(given.entries["en"]) >= set(bad)


def test_rare_toxic_documents_are_found(spark):
    """One document in a hundred is toxic, and half of the toxic words are never in a labelled one."""
    rng = random.Random(8)
    clean = [f"word{k}" for k in range(400)]
    bad = [f"vile{k}" for k in range(12)]
    rows, labels = [], []
    for k in range(6000):
        toxic = k % 100 == 0
        labelled = k < 2400
        text = rng.choices(clean, k=60) + [f"name{rng.randrange(4000)}" for _ in range(5)]
        rng.shuffle(text)
        if toxic:
            for _ in range(6):
                text.insert(rng.randrange(20, 40), rng.choice(bad[:6] if labelled else bad))
        rows.append((k, " ".join(text), "en"))
        if labelled:
            labels.append((k, 1, int(toxic)))
    docs = documents(spark, rows).repartition(3)
    lexicon = toxicity.induce(docs, spark.createDataFrame(labels, LABELS))
    assert set(lexicon.entries["en"]) >= set(bad) and len([w for w in lexicon.entries["en"] if w not in bad]) <= 4
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, lexicon).collect()}
    assert np.mean([got[k] for k in range(2400, 6000, 100)]) > 0.95
    assert np.mean([got[k] for k in range(6000) if k % 100]) < 0.01
    given = toxicity.induce(docs, seeds={"en": (bad[:3], clean[:10])})
    assert set(given.entries["en"]) >= set(bad)


def test_rare_edges_match_the_dense_counts(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(["aa", "bb", "cc", "dd", "zz"], k=rng.randrange(30))), rng.choice(["en", "de"])) for k in range(40)] + [(99, None, "en")]
    docs = documents(spark, rows).repartition(3).select("text", "lang")
    vocabulary = toxicity.Vocabulary({"de": ["aa", "cc"], "en": ["aa", "bb", "dd"]})
    rare = np.array([False, True, False, True, True])
    want = [{(a, b): c for a, b, c in zip(*(v.tolist() for v in e)) if rare[vocabulary.start[k] + b] or rare[vocabulary.start[k] + a]} for k, e in enumerate(toxicity.cooccurrence(docs, vocabulary, 3))]
    for held in (1, 1000):  # tasks hand on sums in many parts, or in one
        monkeypatch.setattr(toxicity, "HELD", held)
        got = [{(a, b): c for a, b, c in zip(*(v.tolist() for v in e))} for e in toxicity.rare_edges(docs, vocabulary, rare, 3)]
        assert got == want


def test_toxicity_odd_rows(spark):
    odd = documents(spark, ODD, clashing=True)
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 0), (4, None, None), (None, 1, 1)], LABELS)
    rows = toxicity.score(odd, toxicity.induce(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 and not r["toxic"] for r in rows)
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.induce(empty, labels)).count() == 0
    assert toxicity.score(odd, toxicity.induce(empty, labels)).count() == len(ODD)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_toxicity_on_labelled_documents(spark, sf_dir):
    docs, labels = loaded(spark, sf_dir), labels_of(spark, sf_dir)
    got = toxicity.score(docs, toxicity.induce(docs, labels)).withColumnRenamed("toxic", "found").join(labels, "doc_id").toPandas()
    assert got[got.toxic == 1].found.mean() > 0.6 and got[got.toxic == 0].found.mean() < 0.02
