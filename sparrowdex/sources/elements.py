"""Elements: the rows to index, whatever table they come from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "site_id int, element_id bigint, element_type string, title string, "
    "attributes array<struct<handle:string,value:string>>, fields array<struct<handle:string,value:string,searchable:boolean>>, "
    "enabled boolean, enabled_for_site boolean, is_draft boolean, is_revision boolean, is_provisional boolean, has_titles boolean"
)
_FLAGS = {"enabled": True, "enabled_for_site": True, "is_draft": False, "is_revision": False, "is_provisional": False, "has_titles": True}


def elements(
    df: DataFrame, element_type: str, element_id: Column, site_id: Column | int = 1, title: Column | None = None, fields: dict[str, Column] | None = None, attributes: dict[str, Column] | None = None, keep: tuple[str, ...] | list[str] = (), **flags: Column | bool
) -> DataFrame:
    """Projects any DataFrame onto the element schema; columns named in `keep` come along."""

    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    named = [F.struct(F.lit(h).alias("handle"), v.cast("string").alias("value")) for h, v in (attributes or {}).items()]
    own = [F.struct(F.lit(h).alias("handle"), v.cast("string").alias("value"), F.lit(True).alias("searchable")) for h, v in (fields or {}).items()]
    return df.select(
        lit(site_id).cast("int").alias("site_id"),
        element_id.cast("long").alias("element_id"),
        F.lit(element_type).alias("element_type"),
        (title if title is not None else F.lit(None)).cast("string").alias("title"),
        (F.array(*named) if named else F.array()).cast("array<struct<handle:string,value:string>>").alias("attributes"),
        (F.array(*own) if own else F.array()).cast("array<struct<handle:string,value:string,searchable:boolean>>").alias("fields"),
        *[F.coalesce(lit(flags.get(k, v)).cast("boolean"), F.lit(v)).alias(k) for k, v in _FLAGS.items()],
        *keep,
    )


def union_types(*parts: DataFrame) -> DataFrame:
    """All element types as one scan."""
    return reduce(DataFrame.unionByName, parts)


def batch(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """A slice in id order, for callers that page through elements."""
    return df.orderBy("site_id", "element_id").offset(offset).limit(limit)


def identified() -> Column:
    """Elements without an id or site, or with 0 for one, are left alone: neither indexed nor removed."""
    return (F.coalesce("site_id", F.lit(0)) != 0) & (F.coalesce("element_id", F.lit(0)) != 0)


def indexable() -> Column:
    """Whether an element belongs in the index; an identified one that doesn't is taken out of it.
    A title that is null, empty or "0" is none; one of blanks is a title."""
    titled = ~F.col("has_titles") | ~F.coalesce("title", F.lit("")).isin("", "0")
    return identified() & F.col("enabled") & F.col("enabled_for_site") & ~F.col("is_draft") & ~F.col("is_revision") & ~F.col("is_provisional") & titled


def searchable_text(handles: list[str] | None = None) -> Column:
    """Attributes, then searchable fields, each after a space. "0" and empty values are skipped.

    `handles` names the fields to take; unknown and unsearchable ones are ignored, and an empty
    list takes none. None takes all searchable fields, which is what a save or a rebuild asks for."""

    def filled(x: Column) -> Column:
        return x["value"].isNotNull() & ~x["value"].isin("", "0")

    wanted = F.filter("fields", lambda x: filled(x) & x["searchable"] & (x["handle"].isin(*handles) if handles is not None else F.lit(True)))
    values = F.concat(F.transform(F.filter("attributes", filled), lambda x: x["value"]), F.transform(wanted, lambda x: x["value"]))
    return F.array_join(values, " ")
