"""Ranked search, for one query or a DataFrame of queries, as one lazy plan."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, similarity, text
from .index import Index

RESULT = "query_id int, site_id int, element_id bigint, score double, rank int"
BROADCAST_ROWS = 100_000  # rows of query tokens or candidates that may be broadcast, at about 100 bytes each
SCAN_TOKENS = 64  # up to so many fuzzy tokens are compared with the dictionary directly
CELL = 512  # queries of the same tokens, on average, and results that make one cell of a batch's answer


def _tokens(queries: DataFrame) -> DataFrame:
    """(query_id, site_id, toks) of the queries that have tokens."""
    toks = text.query_tokens(text.tokenize(F.when(F.col("text") == "0", "").otherwise(F.col("text"))))
    return queries.select("query_id", "site_id", toks.alias("toks")).filter(F.size("toks") > 0)


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _asked(terms: DataFrame, s) -> DataFrame:
    """Distinct (site_id, token) rows with their n-grams, the number of these and the least similarity."""
    asked = terms.select("site_id", "token", text.ngrams(F.col("token"), s.ngram_sizes).alias("asked"), similarity.adaptive_threshold(F.char_length("token"), s.similarity_threshold).alias("least"))
    return asked.withColumn("asked_count", F.size("asked"))


def _fits() -> Column:
    """Similarity of at least t needs t |A| <= |B| <= |A| / t, so n-gram counts filter first without loss."""
    return (F.col("ngram_count") >= F.floor(F.col("asked_count") * F.col("least"))) & (F.col("ngram_count") * F.col("least") <= F.col("asked_count") + 1e-9)


def similar_terms(index: Index, terms: DataFrame, scan: bool) -> DataFrame:
    """(site_id, token, term, doc_freq, similarity) for distinct (site_id, token) rows,
    at or above the token's threshold.

    `scan` compares few tokens with the whole dictionary. Otherwise prefix filtering finds
    the candidates: a match shares at least t |A| n-grams, so it has one of any
    |A| - t |A| + 1 of them. The rarest are looked up in an equi-join on n-gram and site;
    what nearly every term has (single letters) isn't, and only candidates are compared."""
    asked = _asked(terms, index.settings)
    if scan:
        rows = index.term_dict.join(F.broadcast(asked.withColumnRenamed("site_id", "asked_site")), (F.col("site_id") == F.col("asked_site")) & _fits())
    else:
        grams = index.term_dict.select("site_id", "term", "ngram_count", F.explode("ngrams").alias("gram"))
        mine = asked.select("site_id", "token", "least", "asked_count", F.explode("asked").alias("gram"))
        used = grams.groupBy("site_id", "gram").agg(F.count("*").alias("uses"))
        order = Window.partitionBy("site_id", "token").orderBy("uses", "gram")
        needed = F.col("asked_count") - F.ceil(F.col("asked_count") * F.col("least") - 1e-9) + 1
        # a gram that no term has isn't shared, but counts as one of the token's
        rare = mine.join(used, ["site_id", "gram"], "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= needed)
        pairs = grams.join(rare, ["site_id", "gram"]).filter(_fits()).select("site_id", "token", "term").distinct()
        rows = pairs.join(asked, ["site_id", "token"]).join(index.term_dict, ["site_id", "term"])
    found = rows.select("site_id", "token", "term", "doc_freq", "least", similarity.ngram_similarity(F.col("asked"), F.col("ngrams")).alias("similarity"))
    return found.filter("similarity >= least").drop("least")


def close_terms(index: Index, terms: DataFrame, scan: bool) -> DataFrame:
    """(site_id, token, term, doc_freq, similarity, least, ...): terms within the edit distance or
    with the token as a prefix, whether or not their similarity is enough.

    The distance is checked first: few terms pass it, and only these get n-grams, made on the
    fly, so that the stored ones aren't read. `scan` compares few tokens with the whole
    dictionary. Otherwise equi-joins find the candidates: on the term's own prefixes, and on
    what is left when bytes are taken out of either side; for distances above 2, of which
    there would be too many, on n-grams."""
    s = index.settings
    if not scan and s.max_distance > 2:
        return similar_terms(index, terms, False).withColumn("least", F.lit(0.0)).filter(similarity.is_close(F.col("token"), F.col("term"), s.max_distance))
    asked = _asked(terms, s)
    words = index.term_dict.select("site_id", "term", "doc_freq", "ngram_count")
    if scan:
        rows = words.join(F.broadcast(asked.withColumnRenamed("site_id", "asked_site")), (F.col("site_id") == F.col("asked_site")) & _fits() & similarity.is_close(F.col("token"), F.col("term"), s.max_distance))
    else:
        n = F.char_length("term")
        starts = F.when(n > similarity.PREFIX_LENGTH, F.transform(F.sequence(F.lit(similarity.PREFIX_LENGTH), n - 1), lambda i: F.substring("term", F.lit(1), i))).otherwise(F.array().cast("array<string>"))
        longer = words.select("site_id", "term", F.explode(starts).alias("token")).join(asked.select("site_id", "token"), ["site_id", "token"]).select("site_id", "token", "term")
        near = words.select("site_id", "term", F.explode(text.deletions(F.col("term"), s.max_distance)).alias("h")).join(asked.select("site_id", "token", F.explode(text.deletions(F.col("token"), s.max_distance)).alias("h")), ["site_id", "h"]).select("site_id", "token", "term")
        pairs = longer.union(near).distinct().filter(similarity.is_close(F.col("token"), F.col("term"), s.max_distance))
        rows = pairs.join(asked, ["site_id", "token"]).join(words, ["site_id", "term"])
    return _measured(rows, s)


def _measured(rows: DataFrame, s) -> DataFrame:
    """With the similarity of `asked` to the term's n-grams, which are made once."""
    common = F.size(F.array_intersect("asked", text.ngrams(F.col("term"), s.ngram_sizes)))
    return rows.withColumn("common", common).withColumn("similarity", similarity.jaccard(F.col("common"), F.col("asked_count"), F.col("ngram_count")))


def fuzzy_terms(index: Index, terms: DataFrame, scan: bool) -> DataFrame:
    """(site_id, token, term, doc_freq, similarity, confidence, place): the candidates
    that pass the edit-distance check, best first, at most max_candidates per token."""
    s = index.settings
    order = Window.partitionBy("site_id", "token").orderBy(F.desc("similarity"), "term")
    # the least similarity counts after the ranking, which it can't change: before it, the
    # optimizer would move it into the join and make n-grams of every pair
    ranked = close_terms(index, terms, scan).withColumn("place", F.row_number().over(order)).filter((F.col("place") <= s.max_candidates) & (F.col("similarity") >= F.col("least")))
    ranked = ranked.select("site_id", "token", "term", "doc_freq", "similarity", "place")
    return ranked.withColumn("confidence", similarity.confidence(F.col("token"), F.col("term"), F.col("similarity")))


def candidates(index: Index, tokens: DataFrame, small: bool, scan: bool) -> DataFrame:
    """(query_id, site_id, n_tokens, term_index, term, doc_freq, place, confidence): the
    token itself at place 0, similar terms after it."""
    exact = index.term_dict.select("site_id", F.col("term").alias("token"), F.col("doc_freq").alias("exact_freq"))
    if small:  # the dictionary side is reduced to the few tokens first, then joined to them
        exact = F.broadcast(exact.join(F.broadcast(tokens.select("site_id", "token").distinct()), ["site_id", "token"], "left_semi"))
    g = tokens.join(exact, ["site_id", "token"], "left").withColumn("fuzzy", similarity.wants_fuzzy(F.char_length("token"), F.col("exact_freq").isNotNull()))
    keys = ["query_id", "site_id", "n_tokens", "term_index"]
    exact = g.filter("exact_freq is not null").select(*keys, F.col("token").alias("term"), F.col("exact_freq").alias("doc_freq"), F.lit(0).alias("place"), F.lit(1.0).alias("confidence"))
    wanted = g.filter("fuzzy")
    near = fuzzy_terms(index, wanted.select("site_id", "token").distinct(), scan).filter("term <> token")
    more = wanted.join(near, ["site_id", "token"]).select(*keys, "term", "doc_freq", "place", "confidence")
    return exact.unionByName(more)


def score(index: Index, found: DataFrame, small: bool, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, site_id, element_id, score) of elements that match every token.

    For each token an element counts with the first candidate it has, exact first. Lengths
    come with the postings and totals with the index: nothing else is read."""
    s = index.settings
    keys = ["query_id", "site_id", "element_id"]
    hits = index.postings.join(_hint(found, small), ["site_id", "term"])
    if allowed is not None:
        on = [c for c in ("site_id", "element_id") if c in allowed.columns]
        hits = hits.join(allowed.select(on).distinct(), on, "left_semi")
    # one exchange for both aggregates: nearly every hit is its own group in the first
    first = hits.repartition(*keys).groupBy(*keys, "n_tokens", "term_index").agg(F.min(F.struct("place", "term", "confidence", "freq", "doc_freq", "in_title", "doc_len")).alias("m"))
    docs, length = (F.lit(n).cast("long") for n in index.count().counted)
    one = scoring.bm25(F.col("freq"), F.col("doc_freq"), F.greatest(F.lit(1), F.col("doc_len")), scoring.average_length(length, docs), docs, s)
    one = one * F.when(F.col("in_title"), s.title_boost).otherwise(1.0) * F.col("confidence")
    per_doc = first.select(*keys, "n_tokens", "m.*").groupBy(*keys, "n_tokens").agg(F.sum(one).alias("score"), F.count("*").alias("n"), F.sum((F.col("place") == 0).cast("int")).alias("n_exact"))
    boost = F.when((F.col("n_tokens") > 1) & (F.col("n_exact") == F.col("n_tokens")), s.exact_boost).otherwise(1.0)
    return per_doc.filter("n = n_tokens").select(*keys, (F.col("score") * boost).alias("score"))


def by_score() -> list[Column]:
    """Best first. Sums of floats differ in their last bits with the order of their
    parts, so scores that agree to nine decimals tie, and ties go to the least id."""
    return [F.desc(F.round("score", 9)), F.col("element_id")]


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id", "site_id").orderBy(*by_score())
    return scores.withColumn("rank", F.row_number().over(order))


def search_batch(index: Index, queries: DataFrame, allowed: DataFrame | None = None, max_rank: int | None = None, digits: int | None = None) -> DataFrame:
    """Results of queries(query_id, site_id, text) with their ranks, in no particular order.
    `digits` rounds the scores, after the ranking and once for all queries that share an answer.

    Queries of the same tokens on the same site are answered once. The distinct tokens are
    counted first: only a checked, small number is broadcast."""
    every = _tokens(queries)
    asked = every.groupBy("site_id", "toks").agg(F.min("query_id").alias("first"), F.count("*").alias("uses"))
    tokens = asked.select(F.col("first").alias("query_id"), "site_id", F.size("toks").alias("n_tokens"), "uses", F.posexplode("toks").alias("term_index", "token"))
    n, distinct, most = tokens.agg(F.count("*"), F.count_distinct("site_id", "token"), F.max("uses")).first()
    tokens = tokens.drop("uses")
    small = n * (index.settings.max_candidates + 1) <= BROADCAST_ROWS
    scores = score(index, candidates(index, tokens, small, distinct <= SCAN_TOKENS), small, allowed)
    out = ranked(scores)
    out = out if max_rank is None else out.filter(F.col("rank") <= max_rank)
    out = out if digits is None else out.withColumn("score", F.round("score", digits))
    same, out = every.join(asked, ["site_id", "toks"]).select("query_id", "site_id", "first", "uses"), out.withColumnRenamed("query_id", "first")
    if (most or 0) > 1:
        return _spread(same, out)
    return same.join(out, ["site_id", "first"]).select("query_id", "site_id", "element_id", "score", "rank")


def _spread(same: DataFrame, out: DataFrame) -> DataFrame:
    """`same` joined with `out` on (site_id, first), where many queries share an answer.

    The result is as large as the product of the two, which no shuffle's size tells, and has few
    keys: left to a join, a task or two would make it all. So blocks of queries meet blocks of
    results, each pair of blocks is a row, and these rows are dealt out before they are unfolded.
    What is moved is about 1 / CELL of the result."""
    conf, context = same.sparkSession.conf, same.sparkSession.sparkContext
    keys = ["site_id", "first"]
    block = F.pmod(F.xxhash64("query_id"), F.ceil(F.col("uses") / CELL))
    ids = same.groupBy(*keys, block.alias("block")).agg(F.collect_list(F.struct("query_id")).alias("ids")).drop("block")
    found = out.groupBy(*keys, F.floor((F.col("rank") - 1) / CELL).alias("block")).agg(F.collect_list(F.struct("element_id", "score", "rank")).alias("found")).drop("block")
    cells = ids.join(found, keys).repartition(max(int(conf.get("spark.sql.shuffle.partitions")), 4 * context.defaultParallelism))
    return cells.select("site_id", F.explode("ids.query_id").alias("query_id"), "found").select("query_id", "site_id", F.explode("found").alias("r")).select("query_id", "site_id", "r.*")


def _resolved(index: Index, tokens: list[str], site_id: int) -> list[tuple]:
    """(query_id, site_id, n_tokens, term_index, term, doc_freq, place, confidence) of every
    term that can match: at most max_candidates a token, from one scan of the site's dictionary."""
    spark, s = index.postings.sparkSession, index.settings
    asked = _asked(text.local_rows(spark, [(site_id, t) for t in dict.fromkeys(tokens)], "site_id int, token string"), s)
    token, term = F.col("token"), F.col("term")
    near = (F.char_length("token") >= 3) & _fits() & similarity.is_close(token, term, s.max_distance)
    words = index.term_dict.filter(F.col("site_id") == site_id).select("term", "doc_freq", "ngram_count")
    rows = _measured(words.join(F.broadcast(asked), (term == token) | near), s)
    order = Window.partitionBy("token").orderBy(F.desc("similarity"), "term")
    enough = (F.col("place") <= s.max_candidates) & (F.col("similarity") >= F.col("least"))  # after the ranking, as in fuzzy_terms
    rows = rows.withColumn("place", F.row_number().over(order)).filter(enough | (term == token))
    found: dict[str, list] = {}
    for r in rows.select("token", "term", "doc_freq", "place", similarity.confidence(token, term, F.col("similarity")).alias("confidence")).collect():
        found.setdefault(r["token"], []).append(r)
    out = []
    for k, t in enumerate(tokens):
        own = found.get(t, [])
        exact = [r for r in own if r["term"] == t]
        fuzzy = len(t) >= 3 and (not exact or len(t) >= 5)
        out += [(0, site_id, len(tokens), k, t, r["doc_freq"], 0, 1.0) for r in exact]
        out += [(0, site_id, len(tokens), k, r["term"], r["doc_freq"], r["place"], r["confidence"]) for r in own if fuzzy and r["term"] != t]
    return out


def _any_of(column: Column, values: list[str]) -> Column:
    """`isin` in small groups of neighbours: a scan prunes row groups by each group's values, but by the least and greatest of a long list."""
    groups = [column.isin(values[k : k + 10]) for k in range(0, len(values), 10)]
    return reduce(lambda a, b: a | b, groups)


def search(index: Index, query: object, site_id: int = 1, allowed: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(element_id, site_id, score, rank), best first.

    The terms that can match are resolved first, from the dictionary alone: there are at
    most max_candidates per token. The posting scan then gets them as literals, so that
    Parquet skips the row groups of all other terms and sites. A query of more than
    SCAN_TOKENS different tokens (a pasted text) takes the plan of a batch instead.
    `allowed` is any DataFrame with element_id (and site_id): only its elements count,
    before paging. Settings that aren't `enabled` find nothing. With a limit, only so many rows get to the partition that numbers them."""
    spark = index.postings.sparkSession
    nothing = text.local_rows(spark, [(0, 0, 0.0, 0)], "element_id bigint, site_id int, score double, rank int").limit(0)
    if not text.has_query(query) or not index.settings.enabled:
        return nothing
    words = text.query_text(query)
    tokens = text.query_tokens_of(spark, words)
    if len(set(tokens)) > SCAN_TOKENS:
        one = text.local_rows(spark, [(0, site_id, words)], "query_id int, site_id int, text string")
        scores = search_batch(index, one, allowed, None if limit is None else offset + limit).select("element_id", "site_id", "score")
    else:
        rows = _resolved(index, tokens, site_id) if tokens else []
        if len({r[3] for r in rows}) < len(tokens) or not rows:  # a token without any term: nothing has them all
            return nothing
        found = text.local_rows(spark, rows, "query_id int, site_id int, n_tokens int, term_index int, term string, doc_freq bigint, place int, confidence double")
        postings = index.postings.filter((F.col("site_id") == site_id) & _any_of(F.col("term"), sorted({r[4] for r in rows})))
        scores = score(replace(index, postings=postings, counted=index.count().counted), found, True, allowed)
    scores = scores.orderBy(*by_score())
    if limit is not None:
        scores = scores.limit(offset + limit)
    out = scores.withColumn("rank", F.row_number().over(Window.orderBy(*by_score())))
    out = out.filter(F.col("rank") > offset) if offset else out
    return out.select("element_id", "site_id", "score", "rank").orderBy("rank")


def search_sites(index: Index, query: object, site_ids: list[int], allowed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One search on several sites: (site_id, element_id, score, rank), ranked within each."""
    asked = index.postings.sparkSession.createDataFrame([(0, s, text.query_text(query)) for s in dict.fromkeys(site_ids)], "query_id int, site_id int, text string")
    return search_batch(index, asked, allowed, limit).select("site_id", "element_id", "score", "rank")


def count_results(index: Index, query: object, site_id: int = 1, allowed: DataFrame | None = None) -> DataFrame:
    """One row: n_results."""
    return search(index, query, site_id, allowed).agg(F.count("*").alias("n_results"))
