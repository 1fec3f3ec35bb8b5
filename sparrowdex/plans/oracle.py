"""What each query must return, as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions.text import stop_words
from ..settings import DEFAULT as S

STOP = ", ".join(f"'{w}'" for w in stop_words())


def tokens(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split(regexp_replace({folded}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda t: t NOT IN ('', '0'))"


def grams(term: str, sizes=S.ngram_sizes) -> str:
    one = [f"list_transform(range(1, greatest(1, length({term}) + 2 - {n} + 2)), lambda i: substr(' ' || {term} || ' ', i, {n}))" for n in sizes]
    return f"list_distinct(list_filter(flatten([{', '.join(one)}]), lambda g: trim(g) <> ''))"


ELEMENTS = {
    "document": r"""SELECT CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 WHEN 'fr' THEN 4 ELSE 0 END AS site_id, d.doc_id AS element_id,
        regexp_extract(text, '^[^.\n]*', 0) AS title, text AS body FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) <> 1""",
    "page": r"""SELECT 1 AS site_id, page_id AS element_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages""",
    "part": """SELECT 1 AS site_id, p_partkey AS element_id, p_name AS title, p_brand || ' ' || p_type AS body FROM part""",
}


def index(kind: str = "document") -> str:
    """CTEs: el, body_terms, titles, postings, doc_stats, totals, dict."""
    return rf"""el AS (SELECT * FROM ({ELEMENTS[kind]}) WHERE title NOT IN ('', '0') AND site_id <> 0 AND element_id <> 0),
body_terms AS (SELECT site_id, element_id, term, count(*) AS tf FROM (SELECT site_id, element_id, unnest({tokens('body')}) AS term FROM el) WHERE term NOT IN ({STOP}) GROUP BY ALL),
titles AS (SELECT DISTINCT site_id, element_id, term FROM (SELECT site_id, element_id, unnest({tokens('title')}) AS term FROM el)),
postings AS (
  SELECT coalesce(b.site_id, t.site_id) AS site_id, coalesce(b.element_id, t.element_id) AS element_id, coalesce(b.term, t.term) AS term, coalesce(b.tf, 1) AS freq, t.term IS NOT NULL AS in_title
  FROM body_terms b FULL JOIN titles t ON b.site_id = t.site_id AND b.element_id = t.element_id AND b.term = t.term
),
doc_stats AS (SELECT site_id, element_id, sum(freq)::BIGINT AS doc_len FROM postings GROUP BY ALL),
totals AS (SELECT count(*) AS total_docs, coalesce(sum(doc_len), 0)::BIGINT AS total_length FROM doc_stats),
dict AS (SELECT site_id, term, count(*) AS doc_freq FROM postings GROUP BY ALL)"""


def dict_grams() -> str:
    return f"dict_grams AS (SELECT *, {grams('term')} AS grams FROM dict)"


def bm25(freq="freq", df="doc_freq", dl="doc_len") -> str:
    return (
        f"ln(1.0::DOUBLE + (total_docs - {df} + 0.5::DOUBLE) / ({df} + 0.5::DOUBLE)) * ({freq} * {S.bm25_k1 + 1}::DOUBLE) / ({freq} + {S.bm25_k1}::DOUBLE * ({1 - S.bm25_b}::DOUBLE + {S.bm25_b}::DOUBLE * "
        f"({dl} / (greatest(1, total_length)::DOUBLE / greatest(1, total_docs)))))"
    )


def threshold(n: str) -> str:
    t = S.similarity_threshold
    return f"(CASE WHEN {n} <= 2 THEN {max(0.10, t * 0.4)}::DOUBLE WHEN {n} = 3 THEN {max(0.15, t * 0.6)}::DOUBLE WHEN {n} = 4 THEN {max(0.20, t * 0.8)}::DOUBLE WHEN {n} <= 6 THEN {max(0.25, t * 0.8)}::DOUBLE ELSE {t}::DOUBLE END)"


PREFIX = "(length(token) >= 4 AND length(token) < length(term) AND starts_with(term, token))"
CLOSE = f"({PREFIX} OR levenshtein(token, term) <= CASE WHEN length(token) <= 3 THEN {min(1, S.max_distance)} ELSE {S.max_distance} END)"
CONFIDENCE = (
    f"CASE WHEN token = term THEN 1.0::DOUBLE WHEN {PREFIX} THEN greatest(0.25::DOUBLE, least(0.45::DOUBLE, 0.5::DOUBLE * (length(token) / length(term)) + 0.5::DOUBLE * similarity)) "
    "ELSE greatest(0.25::DOUBLE, least(0.6::DOUBLE, 0.6::DOUBLE * (1.0::DOUBLE - levenshtein(token, term) / greatest(length(token), length(term))) + 0.4::DOUBLE * similarity)) END"
)


def similar() -> str:
    """CTEs from asked(site_id, token): near_terms(site_id, token, term, doc_freq, similarity) and fuzzy with confidence and place."""
    return f"""asked_grams AS (SELECT site_id, token, {grams('token')} AS asked, {threshold('length(token)')} AS least FROM asked),
near_terms AS (
  SELECT site_id, token, term, doc_freq, similarity FROM (
    SELECT a.site_id, token, term, doc_freq, least, len(list_intersect(asked, grams))::DOUBLE / (len(asked) + len(grams) - len(list_intersect(asked, grams))) AS similarity
    FROM asked_grams a JOIN dict_grams d ON a.site_id = d.site_id AND len(grams) >= floor(len(asked) * least) AND len(grams) * least <= len(asked) + 1e-9
  ) WHERE similarity >= least
),
fuzzy AS (
  SELECT *, {CONFIDENCE} AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, token ORDER BY similarity DESC, term) AS place FROM near_terms WHERE {CLOSE}
  ) WHERE place <= {S.max_candidates}
)"""


def ranked(queries: str, kind: str = "document", allowed: str | None = None) -> str:
    """CTEs ending in ranked(query_id, site_id, element_id, score, rank) for a query source (query_id, site_id, text)."""
    return f"""WITH {index(kind)}, {dict_grams()},
q AS ({queries}),
raw AS (SELECT query_id, site_id, {tokens("CASE WHEN text = '0' THEN '' ELSE text END")} AS toks FROM q),
kept AS (SELECT *, list_filter(toks, lambda t: t NOT IN ({STOP})) AS good FROM raw),
chosen AS (SELECT query_id, site_id, CASE WHEN len(good) > 0 THEN good ELSE toks END AS toks FROM kept),
query_tokens AS (SELECT query_id, site_id, len(toks) AS n_tokens, unnest(range(len(toks))) AS term_index, unnest(toks) AS token FROM chosen),
gate AS (SELECT t.*, d.doc_freq AS exact_freq, length(token) >= 3 AND (d.doc_freq IS NULL OR length(token) >= 5) AS fuzzy FROM query_tokens t LEFT JOIN dict d ON d.site_id = t.site_id AND d.term = t.token),
asked AS (SELECT DISTINCT site_id, token FROM gate WHERE fuzzy),
{similar()},
candidates AS (
  SELECT query_id, site_id, n_tokens, term_index, token AS term, exact_freq AS doc_freq, 0 AS place, 1.0::DOUBLE AS confidence FROM gate WHERE exact_freq IS NOT NULL
  UNION ALL
  SELECT g.query_id, g.site_id, g.n_tokens, g.term_index, f.term, f.doc_freq, f.place, f.confidence FROM gate g JOIN fuzzy f ON g.site_id = f.site_id AND g.token = f.token WHERE g.fuzzy AND f.term <> g.token
),
hits AS (
  SELECT c.*, p.element_id, p.freq, p.in_title, row_number() OVER (PARTITION BY query_id, c.site_id, term_index, element_id ORDER BY place) AS n
  FROM candidates c JOIN postings p ON p.site_id = c.site_id AND p.term = c.term {f'WHERE p.element_id IN ({allowed})' if allowed else ''}
),
scored AS (
  SELECT query_id, h.site_id, h.element_id, n_tokens, sum({bm25()} * CASE WHEN in_title THEN {S.title_boost}::DOUBLE ELSE 1.0::DOUBLE END * confidence) AS score, count(*) AS matched, sum(CASE WHEN place = 0 THEN 1 ELSE 0 END) AS exact
  FROM hits h JOIN doc_stats s ON s.site_id = h.site_id AND s.element_id = h.element_id CROSS JOIN totals WHERE n = 1 GROUP BY ALL
),
boosted AS (SELECT query_id, site_id, element_id, score * CASE WHEN n_tokens > 1 AND exact = n_tokens THEN {S.exact_boost}::DOUBLE ELSE 1.0::DOUBLE END AS score FROM scored WHERE matched = n_tokens),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, site_id ORDER BY round(score, 9) DESC, element_id) AS rank FROM boosted)"""


def search(text: str, site_id: int, kind: str = "document", allowed: str | None = None, limit: int | None = None, offset: int = 0) -> str:
    quoted = text.replace("'", "''")
    page = f" WHERE rank > {offset}" + (f" AND rank <= {offset + limit}" if limit is not None else "")
    return f"{ranked(f'SELECT 0 AS query_id, {site_id} AS site_id, ' + chr(39) + quoted + chr(39) + ' AS text', kind, allowed)}\nSELECT element_id, site_id, round(score, 6) AS score, rank FROM ranked{page}"


def count(text: str, site_id: int) -> str:
    return search(text, site_id).replace("SELECT element_id, site_id, round(score, 6) AS score, rank FROM ranked", "SELECT count(*) AS n_results FROM ranked")
