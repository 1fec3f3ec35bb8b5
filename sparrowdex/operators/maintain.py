"""Changes to an index. Each gives a new Index: tables are never changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULT
from ..sources.elements import identified
from .index import Index, build, from_postings, postings_of

KEYS = ["site_id", "element_id"]


def upsert(index: Index, changed: DataFrame, handles: list[str] | None = None) -> Index:
    """Replaces the postings of the changed elements; those that aren't indexable (any more) only go.

    A new index as a plan over the old one. A stored index takes changes as a segment of their
    own instead: see ParquetStore.upsert."""
    gone = changed.filter(identified()).select(*KEYS).distinct()
    kept = index.postings.join(gone, KEYS, "left_anti")
    return from_postings(kept.unionByName(postings_of(changed, handles)), index.settings)


def delete(index: Index, keys: DataFrame) -> Index:
    return from_postings(index.postings.join(keys.select(*KEYS).distinct(), KEYS, "left_anti"), index.settings)


def clear_site(index: Index, site_id: int) -> Index:
    other = F.col("site_id") != site_id
    return Index(index.postings.filter(other), index.doc_stats.filter(other), index.term_dict.filter(other), index.settings)


def stale_documents(index: Index, site_id: int, active: DataFrame) -> DataFrame:
    """Indexed elements of a site that aren't among the active ids."""
    return index.documents(site_id).select(*KEYS).join(active.select("element_id").distinct(), "element_id", "left_anti").select(*KEYS)


def prune(index: Index, site_id: int, active: DataFrame) -> Index:
    return delete(index, stale_documents(index, site_id, active))


def orphan_terms(index: Index, dictionary: DataFrame) -> DataFrame:
    """Terms of a dictionary (term) that no document on any site has."""
    return dictionary.select("term").distinct().join(index.postings.select("term").distinct(), "term", "left_anti")


def drop_orphans(index: Index) -> Index:
    """A dictionary that holds only terms in use; index tables built here always do."""
    return from_postings(index.postings, index.settings)


def latest(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The last change of each element; equal sequence numbers are settled by the title, then the fields."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc(order), F.desc_nulls_last("title"), F.desc(F.to_json("fields")))
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rebuild(elements: DataFrame, store, settings=None, handles: list[str] | None = None, site_id: int | None = None) -> Index:
    """Builds beside the live index and publishes when done. With a site, only that one is
    rebuilt from its elements and pruned of the rest; the others stay as they are."""
    settings = settings if settings is not None else DEFAULT
    if site_id is None:
        return store.write(build(elements, settings, handles))
    return store.write_site(build(elements.filter(F.col("site_id") == site_id), settings, handles), site_id)
