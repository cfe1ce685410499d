"""Normalised text, lists and tokens as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"(?U)^\s+|\s+$"


def norm_text(x: Column, default: str | None = "") -> Column:
    """Trimmed (Unicode white space) and lower-cased; missing or blank gives the default."""
    bare = F.lower(F.regexp_replace(x.cast("string"), EDGE_SPACE, ""))
    return F.coalesce(F.when(bare != "", bare), F.lit(default))


def norm_list(x: Column) -> Column:
    """Normalised non-empty elements in order, duplicates kept; null gives an empty list."""
    return F.coalesce(F.filter(F.transform(x, lambda v: norm_text(v)), lambda v: v != ""), F.array().cast("array<string>"))


def loose_list(x: Column) -> Column:
    """A single string as a one-element list: trimmed, case kept, blank gives an empty list."""
    bare = F.regexp_replace(x, EDGE_SPACE, "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(bare))


def tokens(x: Column) -> Column:
    """Distinct runs of [a-z0-9] in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(norm_text(x), F.lit("[a-z0-9]+"), F.lit(0)))


def list_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.array_join(norm_list(x), " "), F.lit("[a-z0-9]+"), F.lit(0)))


def space_tokens(x: Column) -> Column:
    """Distinct white-space separated tokens of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(norm_text(x), r"\s+"), lambda v: v != ""))


def joined(*parts: Column) -> Column:
    """Non-empty normalised parts, joined by one space."""
    return F.array_join(F.filter(F.array(*[norm_text(p) for p in parts]), lambda v: v != ""), " ")


def item_text() -> Column:
    return joined(*[F.col(c) for c in ("title", "sponsor", "description", "eligibility_text", "essay_prompt")])


def profile_text() -> Column:
    lists = [F.array_join(norm_list(F.col(c)), " ") for c in ("interests", "keywords", "extracurriculars")]
    return joined(F.col("major"), *lists, F.col("goals"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)
