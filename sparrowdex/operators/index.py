"""The inverted index as columnar tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..settings import DEFAULT, Settings
from ..sources.elements import identified, indexable, searchable_text

TABLES = {
    "postings": "site_id int, element_id bigint, term string, freq bigint, in_title boolean, doc_len bigint",
    "doc_stats": "site_id int, element_id bigint, doc_len bigint",
    "term_dict": "site_id int, term string, doc_freq bigint, ngrams array<string>, ngram_count int",
}


_BODY, _TITLE = "\x01", "\x02"


@dataclass(frozen=True)
class Index:
    """postings: one row per site, element and term, holding the forward and the
    inverted index, the title terms and the element's length; doc_stats: element lengths;
    term_dict: the sites' terms with their document frequencies and n-grams. `counted` is
    (number of documents, their length) over all sites, where a store knows them; `grouped` the
    postings by element, where they were made that way."""

    postings: DataFrame
    doc_stats: DataFrame
    term_dict: DataFrame
    settings: Settings = DEFAULT
    counted: tuple[int, int] | None = None
    grouped: DataFrame | None = None

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Index:
        return replace(self, **{n: getattr(self, n).persist(level) for n in TABLES})

    def unpersist(self) -> None:
        for n in TABLES:
            getattr(self, n).unpersist()

    def totals(self) -> DataFrame:
        """(total_docs, total_length), over all sites; one row even when empty."""
        if self.counted is not None:
            docs, length = (F.lit(n).cast("long") for n in self.counted)
            return self.postings.sparkSession.range(1).select(docs.alias("total_docs"), length.alias("total_length"))
        return self.doc_stats.agg(F.count("*").alias("total_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_length"))

    def count(self) -> Index:
        """With its totals known, so that no search has to add them up again."""
        return self if self.counted is not None else replace(self, counted=tuple(self.totals().first()))

    def title_terms(self) -> DataFrame:
        return self.postings.filter("in_title").select("site_id", "element_id", "term")

    def document_terms(self, site_id: int, element_id: int) -> DataFrame:
        return self.postings.filter((F.col("site_id") == site_id) & (F.col("element_id") == element_id)).select("term", "freq")

    def term_documents(self, term: str, site_id: int | None = None) -> DataFrame:
        rows = self.postings.filter(F.col("term") == term)
        return (rows if site_id is None else rows.filter(F.col("site_id") == site_id)).select("site_id", "element_id", "freq")

    def terms(self) -> DataFrame:
        return self.term_dict.select("term").distinct()

    def documents(self, site_id: int) -> DataFrame:
        return self.doc_stats.filter(F.col("site_id") == site_id)

    def term_ngrams(self) -> DataFrame:
        grams = self.term_dict.select("site_id", "term", F.explode("ngrams").alias("ngram"))
        return grams.withColumn("ngram_type", F.char_length("ngram"))


def grouped_of(elements: DataFrame, handles: list[str] | None = None) -> DataFrame:
    """(site_id, element_id, doc_len, found): an indexable element with its terms, as one row.

    Text without stop words, title terms with them, once each; a term that only the title has
    counts once. The one shuffle moves texts, not words: an element's words are sorted and
    counted in its row, so that nothing of a corpus's words is held or spilled by a task. Rows
    of the same element are one; all its text has to fit a row."""
    rows = elements.filter(indexable()).select("site_id", "element_id", F.struct("title", searchable_text(handles).alias("body")).alias("part"))
    rows = rows.groupBy("site_id", "element_id").agg(F.collect_list("part").alias("parts"))
    keys = ["site_id", "element_id"]
    # a mark behind each word, below all letters and digits, tells and sorts those of the title
    body = F.transform(F.flatten(F.transform("parts", lambda p: text.remove_stop_words(text.tokenize(p["body"])))), lambda t: F.concat(t, F.lit(_BODY)))
    title = F.transform(F.array_distinct(F.flatten(F.transform("parts", lambda p: text.tokenize(p["title"])))), lambda t: F.concat(t, F.lit(_TITLE)))
    rows = rows.select(*keys, F.sort_array(F.concat(body, title)).alias("marked"))
    rows = rows.select(*keys, "marked", F.transform("marked", lambda t: F.substring(t, F.lit(1), F.char_length(t) - 1)).alias("words"))
    places = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    rows = rows.select(*keys, "marked", "words", starts.alias("starts"))

    def one(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("words"))
        in_title = F.get("marked", end - 1).endswith(_TITLE)
        return F.struct(F.get("words", start).alias("term"), F.greatest(end - start - in_title.cast("int"), F.lit(1)).cast("long").alias("freq"), in_title.alias("in_title"))

    rows = rows.select(*keys, F.transform("starts", one).alias("found"))
    return rows.select(*keys, F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + x["freq"]).alias("doc_len"), "found")


def group(postings: DataFrame) -> DataFrame:
    """Postings as `grouped_of` gives them."""
    return postings.groupBy("site_id", "element_id").agg(F.max("doc_len").alias("doc_len"), F.collect_list(F.struct("term", "freq", "in_title")).alias("found"))


def ungroup(grouped: DataFrame) -> DataFrame:
    """A row for each term; outer, as the optimizer would count the words twice to drop empty rows first."""
    rows = grouped.select("site_id", "element_id", "doc_len", F.explode_outer("found").alias("t")).filter("t is not null")
    return rows.select("site_id", "element_id", "t.term", "t.freq", "t.in_title", "doc_len")


def postings_of(elements: DataFrame, handles: list[str] | None = None) -> DataFrame:
    """Term frequencies, a row for each element and term."""
    return ungroup(grouped_of(elements, handles))


def trace(elements: DataFrame, handles: list[str] | None = None) -> DataFrame:
    """What indexing makes of each element: (element_type, site_id, element_id, indexed, title_tokens, n_tokens, text)."""
    text_of = searchable_text(handles)
    return elements.filter(identified()).select("element_type", "site_id", "element_id", indexable().alias("indexed"), text.tokenize(F.col("title")).alias("title_tokens"), F.size(text.remove_stop_words(text.tokenize(text_of))).alias("n_tokens"), text_of.alias("text"))


def stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("site_id", "element_id").agg(F.max("doc_len").alias("doc_len"))


def with_ngrams(terms: DataFrame, settings: Settings) -> DataFrame:
    return terms.withColumn("ngrams", text.ngrams(F.col("term"), settings.ngram_sizes)).withColumn("ngram_count", F.size("ngrams"))


def dict_of(postings: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return with_ngrams(postings.groupBy("site_id", "term").agg(F.count("*").alias("doc_freq")), settings)


def from_postings(postings: DataFrame, settings: Settings = DEFAULT) -> Index:
    """Everything else is derived from the postings, so that nothing can disagree with them."""
    return Index(postings, stats_of(postings), dict_of(postings, settings), settings)


def build(elements: DataFrame, settings: Settings = DEFAULT, handles: list[str] | None = None) -> Index:
    grouped = grouped_of(elements, handles)
    return replace(from_postings(ungroup(grouped), settings), grouped=grouped)


def bm25_postings(index: Index) -> DataFrame:
    """Every posting with its BM25 score, title boost included."""
    s = index.settings
    rows = index.postings.join(index.term_dict.select("site_id", "term", "doc_freq"), ["site_id", "term"]).crossJoin(F.broadcast(index.totals()))
    score = scoring.bm25(F.col("freq"), F.col("doc_freq"), F.col("doc_len"), scoring.average_length(F.col("total_length"), F.col("total_docs")), F.col("total_docs"), s)
    return rows.select("site_id", "element_id", "term", (score * F.when(F.col("in_title"), s.title_boost).otherwise(1.0)).alias("score"))
