"""Registered queries of the search engine, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring, similarity, text
from .operators import maintain, stats
from .operators import search as s
from .operators.index import bm25_postings, postings_of, trace
from .plans import corpus, oracle
from .settings import DEFAULT
from .sources import elements as el
from .sources.store import ParquetStore, shared_folder
from .streaming.incremental import apply_batch, index_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
EN, DE, ES, FR = 2, 1, 3, 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with_index(select: str, kind: str = "document", more: str = "") -> str:
    return f"WITH {oracle.index(kind)}{', ' + more if more else ''}\n{select}"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# Tokens and terms


@query(f"SELECT doc_id, term_index, term FROM (SELECT doc_id, unnest(range(len(t))) AS term_index, unnest(t) AS term FROM (SELECT doc_id, {oracle.tokens('text')} AS t FROM documents))")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.tokenize(F.col("text"))).alias("term_index", "term")).withColumn("term_index", F.col("term_index").cast("long"))


def _counted(tokens: Column, spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


_FILTERED = "SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, list_filter({}, lambda t: t {} ({})) AS t FROM documents)"


@query(_FILTERED.format(oracle.tokens("text"), "NOT IN", oracle.STOP))
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.remove_stop_words(text.tokenize(F.col("text"))), spark, sf_dir)


@query(_FILTERED.format(oracle.tokens("text"), "IN", oracle.STOP))
def stopword_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(text.only_stop_words(text.tokenize(F.col("text"))), spark, sf_dir)


@query(
    f"SELECT doc_id, array_to_string(CASE WHEN len(g) > 0 THEN g ELSE t END, ' ') AS tokens FROM (SELECT doc_id, t, list_filter(t, lambda x: x NOT IN ({oracle.STOP})) AS g FROM "
    rf"(SELECT doc_id, {oracle.tokens(chr(39) + 'The ' + chr(39) + ' || text')} AS t FROM documents))"
)
def query_token_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("The "), "text")
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.query_tokens(text.tokenize(asked)), " ").alias("tokens"))


# The index


@query(_with_index("SELECT site_id, element_id, term, freq FROM postings"))
def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_of(corpus.document_elements(spark, sf_dir)).select("site_id", "element_id", "term", "freq")


@query(_with_index("SELECT site_id, element_id, doc_len FROM doc_stats"))
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).doc_stats


@query(_with_index("SELECT site_id, term, doc_freq FROM dict"))
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).term_dict.select("site_id", "term", "doc_freq")


@query(_with_index("SELECT total_docs, total_length, round(greatest(1, total_length)::DOUBLE / greatest(1, total_docs), 6) AS avg_length FROM totals"))
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = corpus.index_of(spark, sf_dir).totals()
    return _rounded(totals.withColumn("avg_length", scoring.average_length(F.col("total_length"), F.col("total_docs"))), "avg_length")


@query(_with_index("SELECT site_id, element_id, term FROM titles"))
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).title_terms()


@query(_with_index("SELECT site_id, element_id, freq FROM postings WHERE term = 'thanedble'"))
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).term_documents("thanedble")


@query(_with_index("SELECT term, freq FROM postings WHERE site_id = 2 AND element_id = (SELECT min(element_id) FROM postings WHERE site_id = 2)"))
def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.index_of(spark, sf_dir)
    return index.document_terms(EN, index.documents(EN).agg(F.min("element_id")).first()[0])


@query(_with_index("SELECT site_id, element_id, count(*) AS n_terms, element_id || '-' || site_id AS doc_key FROM postings GROUP BY ALL"))
def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by the keys that results are known by, rendered and parsed again."""
    key = scoring.doc_key(F.col("element_id"), F.col("site_id"))
    rows = corpus.index_of(spark, sf_dir).postings.groupBy(key.alias("doc_key")).agg(F.count("*").alias("n_terms"))
    return rows.select(scoring.parse_doc_key(F.col("doc_key")).alias("k"), "n_terms", "doc_key").select("k.site_id", "k.element_id", "n_terms", "doc_key")


@query(_with_index("SELECT DISTINCT term FROM dict"))
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).terms()


@query(_with_index("SELECT site_id, term, ngram, length(ngram) AS ngram_type FROM (SELECT site_id, term, unnest(grams) AS ngram FROM dict_grams)", more=oracle.dict_grams()))
def term_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).term_ngrams().withColumn("ngram_type", F.col("ngram_type").cast("long"))


@query(_with_index("SELECT site_id, term, len(grams) AS ngram_count FROM dict_grams", more=oracle.dict_grams()))
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index_of(spark, sf_dir).term_dict.select("site_id", "term", *_long("ngram_count"))


@query(_with_index(f"SELECT site_id, element_id, term, round({oracle.bm25()} * CASE WHEN in_title THEN {DEFAULT.title_boost}::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM postings JOIN doc_stats USING (site_id, element_id) JOIN dict USING (site_id, term) CROSS JOIN totals"))
def bm25_all_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(bm25_postings(corpus.index_of(spark, sf_dir)), "score")


# Similar terms

_TYPOS = [(EN, "thandble"), (EN, "thanedbl"), (EN, "attoin"), (ES, "cionas"), (FR, "oumnt"), (DE, "enhiet"), (EN, "thtio"), (EN, "whi")]
_ASKED = "asked AS (SELECT * FROM (VALUES {}) AS v(site_id, token))".format(", ".join(f"({a}, '{b}')" for a, b in _TYPOS))


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_TYPOS, "site_id int, token string")


_SIMILAR = f"{oracle.dict_grams()}, {_ASKED}, {oracle.similar()}"


@query(_with_index("SELECT site_id, token, term, round(similarity, 6) AS similarity FROM near_terms", more=_SIMILAR))
def jaccard_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(s.similar_terms(corpus.index_of(spark, sf_dir), _asked(spark), True).select("site_id", "token", "term", "similarity"), "similarity")


@query(_with_index("SELECT site_id, token, term, round(similarity, 6) AS similarity FROM near_terms", more=_SIMILAR))
def jaccard_candidates_by_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(s.similar_terms(corpus.index_of(spark, sf_dir), _asked(spark), False).select("site_id", "token", "term", "similarity"), "similarity")


@query(_with_index("SELECT site_id, token, term, place, round(confidence, 6) AS confidence FROM fuzzy", more=_SIMILAR))
def fuzzy_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for many tokens: equi-joins on prefixes and on what deletions leave."""
    rows = s.fuzzy_terms(corpus.index_of(spark, sf_dir), _asked(spark), False)
    return _rounded(rows.select("site_id", "token", "term", *_long("place"), "confidence"), "confidence")


@query(_with_index(f"SELECT site_id, token, term, levenshtein(token, term) AS distance FROM near_terms WHERE {oracle.CLOSE}", more=_SIMILAR))
def edit_distance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.similar_terms(corpus.index_of(spark, sf_dir), _asked(spark), True)
    t, c = F.col("token"), F.col("term")
    return rows.filter(similarity.is_close(t, c, DEFAULT.max_distance)).select("site_id", "token", "term", similarity.byte_distance(t, c).cast("long").alias("distance"))


@query(_with_index("SELECT site_id, token, term, place, round(confidence, 6) AS confidence FROM fuzzy", more=_SIMILAR))
def fuzzy_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.fuzzy_terms(corpus.index_of(spark, sf_dir), _asked(spark), True)
    return _rounded(rows.select("site_id", "token", "term", *_long("place"), "confidence"), "confidence")


# Search


def _search(name: str, words: str, site: int, kind: str = "document", **page) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(s.search(corpus.index_of(spark, sf_dir, kind), words, site, **page), "score").withColumn("rank", F.col("rank").cast("long"))

    run.__name__ = name
    query(oracle.search(words, site, kind, **page))(run)


_search("search_exact_single", "thanedble", EN)
_search("search_multi_and", "thanedble attion", EN)
_search("search_all_terms_boost", "thtion attion of", EN)
_search("search_duplicate_token", "thanedble thanedble", EN)
_search("search_fuzzy_typo", "thandble", EN)
_search("search_fuzzy_and", "thandble atton", EN)
_search("search_prefix", "thaned", EN)
_search("search_non_ascii", "cionas", ES)
_search("search_stopword_only_query", "The that", EN)
_search("search_site_isolation", "oument", FR)
_search("search_other_site", "oument", DE)
_search("search_no_result", "zzzzzzzzzzzz", EN)
_search("search_empty_query", " .,! ", EN)
_search("search_paginated", "attion", EN, limit=10, offset=20)
_search("search_parts", "smal widgt", 1, "part")
_search("search_parts_prefix", "widg", 1, "part", limit=50)
_search("search_pages_title", "thanedble", 1, "page")


@query(oracle.search("thtion", EN, allowed="SELECT doc_id FROM labels WHERE quality = 1"))
def search_criteria_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = corpus.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("element_id"))
    return _rounded(s.search(corpus.index_of(spark, sf_dir), "thtion", EN, good), "score").withColumn("rank", F.col("rank").cast("long"))


_RAW = [("",), ("0",), (" ",), (None,), ("00",), ("thtion",), ("0 thtion",), (" the 0 ",)]
_RAW_SQL = "SELECT (row_number() OVER ())::INTEGER AS query_id, 2 AS site_id, text FROM (VALUES {}) AS v(text)".format(", ".join("(NULL)" if q is None else f"('{q}')" for (q,) in _RAW))


@query(f"{oracle.ranked(_RAW_SQL)}\nSELECT q.query_id, count(r.element_id) AS n_results FROM q LEFT JOIN ranked r ON r.query_id = q.query_id GROUP BY q.query_id")
def query_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings that are no query, or have no tokens, find nothing."""
    asked = spark.createDataFrame([(k + 1, EN, q) for k, (q,) in enumerate(_RAW)], "query_id int, site_id int, text string")
    found = s.search_batch(corpus.index_of(spark, sf_dir), asked).groupBy("query_id").agg(F.count("*").alias("n"))
    return asked.join(found, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_results"))


@query(f"{oracle.ranked('SELECT 0 AS query_id, site_id, text FROM (VALUES (1), (2), (3), (4)) AS v(site_id), (SELECT ' + chr(39) + 'oument thtion' + chr(39) + ' AS text)')}\nSELECT site_id, element_id, round(score, 6) AS score, rank FROM ranked")
def search_several_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(s.search_sites(corpus.index_of(spark, sf_dir), "oument thtion", [DE, EN, ES, FR, EN]), "score").withColumn("rank", F.col("rank").cast("long"))


@query(oracle.count("thandble attion", EN))
def search_result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.count_results(corpus.index_of(spark, sf_dir), "thandble attion", EN)


_BATCH = "SELECT p_partkey::INTEGER AS query_id, 1 AS site_id, p_name AS text FROM part"


@query(f"{oracle.ranked(_BATCH, 'part')}\nSELECT query_id, site_id, element_id, round(score, 6) AS score, rank FROM ranked")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name as a query: more tokens than a dictionary scan is used for."""
    asked = corpus.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("query_id"), F.lit(1).alias("site_id"), F.col("p_name").alias("text"))
    return s.search_batch(corpus.index_of(spark, sf_dir, "part"), asked, digits=6).withColumn("rank", F.col("rank").cast("long"))


# Elements


_ALL = r"""SELECT 'document' AS element_type, doc_id AS element_id, CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 0 END AS site_id,
  coalesce(toxic, 0) <> 1 AND regexp_extract(text, '^[^.\n]*', 0) NOT IN ('', '0') AND doc_id <> 0 AND lang IN ('de', 'en', 'es', 'fr') AS indexable FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'page', page_id, 1, regexp_extract(html, '<title>([^<]*)</title>', 1) NOT IN ('', '0') AND page_id <> 0 FROM pages
UNION ALL SELECT 'part', p_partkey, 1, p_name NOT IN ('', '0') AND p_partkey <> 0 FROM part
UNION ALL SELECT 'message', conv_id * 1000 + turn, 1, conv_id * 1000 + turn <> 0 FROM conversations"""


@query(f"SELECT element_type, element_id, site_id FROM ({_ALL}) WHERE indexable")
def indexable_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_elements(spark, sf_dir).filter(el.indexable()).select("element_type", "element_id", "site_id")


@query(f"SELECT element_type, count(*) AS n FROM ({_ALL}) GROUP BY element_type")
def index_union_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_elements(spark, sf_dir).groupBy("element_type").agg(F.count("*").alias("n"))


# titles: null, "", "0", " ", "00" or a name, by part; a draft now and then; brand and type as fields, one of them not searchable for some
_ODD_TITLE = "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN ' ' WHEN 4 THEN '00' ELSE p_name END"
_ODD_SIZE = "CASE p_partkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE cast(p_size AS {}) END"


def _odd_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = el.elements(
        corpus.table(spark, sf_dir, "part"), "odd", F.col("p_partkey"), F.expr("CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END"), F.expr(_ODD_TITLE), {"brand": F.col("p_brand"), "type": F.col("p_type")}, {"size": F.expr(_ODD_SIZE.format("string"))},
        is_draft=F.col("p_partkey") % 13 == 0, is_revision=F.col("p_partkey") % 17 == 0, is_provisional=F.col("p_partkey") % 19 == 0, enabled_for_site=F.col("p_partkey") % 23 != 0, has_titles=F.col("p_partkey") % 3 != 0,
    )
    # the type of every fourth part isn't searchable
    hidden = F.transform("fields", lambda x: x.withField("searchable", (x["handle"] != "type") | (F.col("element_id") % 4 != 0)))
    return rows.withColumn("fields", hidden)


@query(f"""SELECT p_partkey AS element_id FROM part WHERE p_partkey <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 AND p_partkey % 19 <> 0 AND p_partkey % 23 <> 0
  AND (p_partkey % 3 = 0 OR coalesce({_ODD_TITLE}, '') NOT IN ('', '0'))""")
def indexable_odd_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_parts(spark, sf_dir).filter(el.indexable()).select("element_id")


_TEXT = "concat_ws(' ', nullif(nullif({}, ''), '0'), CASE WHEN {} THEN p_brand END, CASE WHEN {} THEN p_type END)"
_SEARCHABLE = f"""SELECT p_partkey AS element_id, {_TEXT.format(_ODD_SIZE.format('VARCHAR'), 'true', 'p_partkey % 4 <> 0')} AS every_field,
  {_TEXT.format(_ODD_SIZE.format('VARCHAR'), 'false', 'p_partkey % 4 <> 0')} AS one_field, {_TEXT.format(_ODD_SIZE.format('VARCHAR'), 'false', 'false')} AS no_field FROM part"""


@query(_SEARCHABLE)
def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes and fields; those that are searchable, those asked for, and none."""
    return _odd_parts(spark, sf_dir).select("element_id", el.searchable_text().alias("every_field"), el.searchable_text(["type", "unknown"]).alias("one_field"), el.searchable_text([]).alias("no_field"))


@query(f"""SELECT element_id, every_field AS text, len(list_filter({oracle.tokens('every_field')}, lambda t: t NOT IN ({oracle.STOP})))::BIGINT AS n_tokens FROM ({_SEARCHABLE}) WHERE element_id <> 0""")
def index_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of indexing, of elements whatever becomes of them."""
    rows = _odd_parts(spark, sf_dir).withColumn("site_id", F.lit(1))
    return trace(rows).select("element_id", "text", *_long("n_tokens"))


@query("SELECT p_partkey AS element_id FROM part ORDER BY p_partkey LIMIT 100 OFFSET 200")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return el.batch(corpus.part_elements(spark, sf_dir), 200, 100).select("element_id")


# Statistics


@query(_with_index("SELECT term, sum(doc_freq)::BIGINT AS doc_freq FROM dict GROUP BY term ORDER BY doc_freq DESC, term LIMIT 10"))
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_terms(corpus.index_of(spark, sf_dir))


def _format(n: str) -> str:
    value = f"regexp_replace(printf('%.2f', round({n} / pow(1024.0::DOUBLE, p), 2)), '\\.?0+$', '')"
    return f"{value} || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1]"


_POWER = "(CASE WHEN {0} >= 1099511627776 THEN 4 WHEN {0} >= 1073741824 THEN 3 WHEN {0} >= 1048576 THEN 2 WHEN {0} >= 1024 THEN 1 ELSE 0 END)"


@query(
    _with_index(
        f"""SELECT total_docs, total_terms, total_length, round(total_length / total_docs, 2) AS avg_length, bytes AS storage_bytes, {_format('bytes')} AS storage, ratio AS term_doc_ratio,
    CASE WHEN ratio > 5 THEN 'green' WHEN ratio > 2 THEN 'yellow' ELSE 'red' END AS health
    FROM (SELECT *, {_POWER.format('bytes')} AS p FROM (SELECT *, 20 * total_terms + 50 * total_docs + 12 * total_length AS bytes, round(total_terms / total_docs, 2) AS ratio FROM totals CROSS JOIN (SELECT count(DISTINCT term) AS total_terms FROM dict)))"""
    )
)
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(corpus.index_of(spark, sf_dir))


@query(f"SELECT doc_id, {_format('n')} AS size FROM (SELECT doc_id, n, {_POWER.format('n')} AS p FROM (SELECT doc_id, strlen(text) * 12345 AS n FROM documents))")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text").cast("long") * 12345
    return corpus.table(spark, sf_dir, "documents").select("doc_id", scoring.format_bytes(size).alias("size"))


# Maintenance

GONE = "error"  # an event of this type takes its element out of the index


@query(_with_index("SELECT site_id, element_id FROM doc_stats WHERE site_id = 2 AND element_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def stale_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = corpus.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("element_id"))
    return maintain.stale_documents(corpus.index_of(spark, sf_dir), EN, active)


@query(_with_index("SELECT site_id, element_id, doc_len FROM doc_stats WHERE site_id <> 2 OR element_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def prune_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = corpus.table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("element_id"))
    return maintain.prune(corpus.index_of(spark, sf_dir), EN, active).doc_stats


@query(_with_index("SELECT DISTINCT term FROM dict WHERE term NOT IN (SELECT term FROM dict WHERE site_id <> 2)"))
def orphan_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = corpus.index_of(spark, sf_dir)
    return maintain.orphan_terms(maintain.clear_site(index, EN), index.terms())


@query(_with_index("SELECT site_id, count(*) AS n_docs, sum(doc_len)::BIGINT AS total_length FROM doc_stats WHERE site_id <> 4 GROUP BY site_id"))
def clear_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.clear_site(corpus.index_of(spark, sf_dir), FR).doc_stats.groupBy("site_id").agg(F.count("*").alias("n_docs"), F.sum("doc_len").alias("total_length"))


@query(_with_index("SELECT site_id, term, count(*) AS doc_freq FROM postings WHERE element_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY ALL"))
def delete_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = corpus.table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("element_id")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("site_id")))
    return maintain.delete(corpus.index_of(spark, sf_dir), gone).term_dict.select("site_id", "term", "doc_freq")


def _change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = corpus.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.*")
    name = F.concat(F.lit("changed by "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    return el.elements(events, "part", F.col("user_id"), 1, name, enabled=F.col("event_type") != GONE)


_CHANGED = r"""last AS (SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id <> 0) WHERE n = 1),
new AS (SELECT DISTINCT 1 AS site_id, user_id AS element_id, unnest({}) AS term FROM last WHERE event_type <> 'error'),
after AS (SELECT site_id, element_id, term, freq, in_title FROM postings WHERE element_id NOT IN (SELECT user_id FROM last) UNION ALL SELECT site_id, element_id, term, 1, true FROM new)""".format(oracle.tokens("'changed by ' || event_type || ' ' || event_id"))


@query(_with_index("SELECT site_id, element_id, term, freq, in_title FROM after", "part", _CHANGED))
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.upsert(corpus.index_of(spark, sf_dir, "part"), _change_rows(spark, sf_dir)).postings.select("site_id", "element_id", "term", "freq", "in_title")


@query(_with_index("SELECT site_id, element_id, doc_len FROM doc_stats", "part"))
def rolling_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds and publishes a version over a live one, then reads what readers see."""
    store = ParquetStore(spark, shared_folder(spark))
    maintain.rebuild(corpus.page_elements(spark, sf_dir), store)
    return maintain.rebuild(corpus.part_elements(spark, sf_dir), store).doc_stats


@query(_with_index("SELECT site_id, element_id, doc_len FROM doc_stats WHERE site_id <> 2 UNION ALL SELECT 2, element_id, doc_len FROM doc_stats WHERE site_id = 2 AND element_id % 3 <> 0"))
def rebuild_one_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site rebuilt from two thirds of its elements: the rest of it is pruned, other sites stay."""
    store = ParquetStore(spark, shared_folder(spark))
    elements = corpus.document_elements(spark, sf_dir)
    maintain.rebuild(elements, store)
    return maintain.rebuild(elements.filter("site_id <> 2 or element_id % 3 <> 0"), store, site_id=EN).doc_stats


def _event_changes(events: DataFrame) -> DataFrame:
    rows = events.withColumn("seq", F.array(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id").cast("bigint")))
    name = F.concat(F.lit("changed by "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    return el.elements(rows, "part", F.col("user_id"), 1, name, enabled=F.col("event_type") != GONE, keep=["seq"])


@query(_with_index("SELECT site_id, element_id, term, freq, in_title FROM after", "part", _CHANGED))
def stream_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of changes, applied in micro-batches to a stored index."""
    folder = shared_folder(spark)
    store = ParquetStore(spark, f"{folder}/stream")
    maintain.rebuild(corpus.part_elements(spark, sf_dir), store)
    schema = corpus.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    index_stream(_event_changes(events), store, f"{folder}/checkpoint").awaitTermination()
    return store.read().postings.drop("doc_len")


@query(_with_index("SELECT site_id, term, count(*) AS doc_freq FROM after GROUP BY ALL", "part", _CHANGED))
def stream_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest half of the events in a batch before the older half: late changes replace nothing newer."""
    store = ParquetStore(spark, shared_folder(spark))
    maintain.rebuild(corpus.part_elements(spark, sf_dir), store)
    events = corpus.table(spark, sf_dir, "events")
    cut = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    for half in (F.col("event_id") > cut, F.col("event_id") <= cut):
        apply_batch(store, _event_changes(events.filter(half)))
    return store.read().term_dict.select("site_id", "term", "doc_freq")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_fuzzy_and"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
