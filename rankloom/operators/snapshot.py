"""Normalised records, dedupe, guardrails, snapshots and their differences."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankloom.functions.urls import normalised

TRACKED = ("deadline", "amount", "title", "eligibility_text")


def cleaned_list(x: Column) -> Column:
    """Trimmed non-empty elements; null where none is left."""
    kept = F.filter(F.transform(x, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, kept)


def utc_text(x: Column, default: Column) -> Column:
    """ISO-8601 in UTC with a Z; missing or unreadable gives the default time."""
    return F.date_format(F.coalesce(F.try_to_timestamp(x.cast("string")), default), "yyyy-MM-dd'T'HH:mm:ss'Z'")


LISTS = ("states_allowed", "majors_allowed", "keywords")
NUMBERS = ("amount_min", "amount_max", "min_gpa")
FLAGS = ("is_recurring", "essay_required")
TIMES = ("first_seen_at", "last_seen_at")


def normalise_records(raw: DataFrame, now: Column) -> DataFrame:
    """Numbers, dates, lists, flags and times coerced, bad values to null; columns that are missing are added as nulls (times as now).

    A list column that holds no lists, or a flag that is none, counts as bad throughout.
    """
    kinds = dict(raw.dtypes)
    have = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    number = lambda c: F.nullif(have(c).cast("string").try_cast("double"), F.lit(float("nan")))
    listed = lambda c: cleaned_list(F.col(c).cast("array<string>")) if kinds.get(c, "").startswith("array<") else F.lit(None).cast("array<string>")
    flag = lambda c: F.col(c) if kinds.get(c) == "boolean" else F.lit(None).cast("boolean")
    day = F.to_date(F.try_to_timestamp(have("deadline").cast("string")))
    return raw.withColumns({c: number(c) for c in NUMBERS} | {c: listed(c) for c in LISTS} | {c: flag(c) for c in FLAGS} | {c: utc_text(have(c), now) for c in TIMES} | {"deadline": day})


def dedupe(records: DataFrame, id_col: str = "item_id", url_col: str = "source_url", title_col: str = "title") -> DataFrame:
    """First row of each id by normalised URL, then title."""
    w = Window.partitionBy(id_col).orderBy(F.col("_url").asc_nulls_last(), F.col(title_col).asc_nulls_last())
    return records.withColumn("_url", normalised(F.col(url_col))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_url")


def blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def missing_text() -> Column:
    return blank(F.col("title")) | blank(F.col("source_url"))


def warnings(n_rows: Column, n_missing: Column, prior_rows: int) -> dict[str, Column]:
    """Rows below half of before; over 5 % without title or URL."""
    return {"warn_drop": F.lit(prior_rows > 0) & (n_rows < 0.5 * prior_rows), "warn_missing": (n_rows > 0) & (n_missing > 0.05 * n_rows)}


def guardrails(current: DataFrame, prior_rows: int) -> DataFrame:
    """One row: counts and the two warnings."""
    out = current.agg(F.count("*").alias("n_rows"), F.count_if(missing_text()).alias("n_missing"))
    return out.withColumns(warnings(F.col("n_rows"), F.col("n_missing"), prior_rows))


def observed(current: DataFrame) -> tuple[DataFrame, Observation]:
    """current, and its counts (n_rows, n_missing), known once it has been written: no pass of their own."""
    seen = Observation(f"guardrails-{uuid.uuid4().hex}")
    return current.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(missing_text()).alias("n_missing")), seen


def changes(current: DataFrame, prior: DataFrame, id_col: str, tracked: list[str]) -> DataFrame:
    """(id, change_type, field, old, new): added and removed ids, and null-safe field changes of shared ones.

    One full outer join; ids must be unique on either side (see `duplicate_ids`).
    """
    a = current.select(F.col(id_col).alias("id"), F.struct(*[F.col(t).cast("string").alias(t) for t in tracked]).alias("n"))
    b = prior.select(F.col(id_col).alias("_id"), F.struct(*[F.col(t).cast("string").alias(t) for t in tracked]).alias("o"))
    both = a.join(b, F.col("id") == F.col("_id"), "full_outer")
    fields = F.array(*[F.struct(F.lit(t).alias("field"), F.col(f"o.{t}").alias("old"), F.col(f"n.{t}").alias("new")) for t in tracked])
    none = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    kind = F.when(F.col("_id").isNull(), "added").when(F.col("id").isNull(), "removed").otherwise("changed")
    differ = F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"]))
    rows = both.select(F.coalesce("id", "_id").alias("id"), kind.alias("change_type"), F.when(kind == "changed", differ).otherwise(F.array(none)).alias("f"))
    return rows.select("id", "change_type", F.explode_outer("f").alias("f")).where("f is not null").select("id", "change_type", "f.field", "f.old", "f.new")


def duplicate_ids(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


# The columns of a snapshot, in their order.
SNAPSHOT = (
    "item_id", "source", "source_id", "source_url", "title", "sponsor", "description", "eligibility_text", "deadline", "amount_min", "amount_max",
    "is_recurring", "states_allowed", "majors_allowed", "min_gpa", "citizenship", "education_level", "essay_required", "essay_prompt", "keywords",
    "first_seen_at", "last_seen_at",
)


def prepared(records: DataFrame) -> DataFrame:
    """The snapshot's columns in their order, missing ones as nulls, rows by id with null ids last."""
    lists = ("states_allowed", "majors_allowed", "keywords")
    kinds = {"amount_min": "double", "amount_max": "double", "min_gpa": "double", "is_recurring": "boolean", "essay_required": "boolean", "deadline": "date"}
    column = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("array<string>" if c in lists else kinds.get(c, "string")).alias(c)
    extra = [c for c in records.columns if c == "embedding_key"]
    return records.select(*map(column, SNAPSHOT), *extra).orderBy(F.col("item_id").asc_nulls_last())


def composed(records: DataFrame, prior: DataFrame | None, key: Column, tracked: list[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot with embedding keys, its changes against the prior one; without a prior all rows are added)."""
    rows = prepared(dedupe(records).withColumn("embedding_key", key))
    return rows, changes(rows, rows.limit(0) if prior is None else prior, "item_id", tracked)


def run_status(attempts: DataFrame) -> DataFrame:
    """One row over (source, attempted, succeeded, failed): sources by status, summed counts, and the run's status.

    A source succeeds without failures, fails without successes, else is partial; so does the run over its sources.
    """
    c = F.col
    each = attempts.groupBy("source").agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in ("attempted", "succeeded", "failed")])
    status = F.when((c("failed") == 0) & (c("succeeded") > 0), "success").when(c("succeeded") == 0, "failed").otherwise("partial")
    names = lambda s: F.array_sort(F.collect_list(F.when(c("status") == s, c("source")))).alias(f"{s}_sources")
    out = each.withColumn("status", status).agg(names("success"), names("partial"), names("failed"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("attempted", "succeeded", "failed")])
    bad, fine = F.size("failed_sources") + F.size("partial_sources"), F.size("success_sources") + F.size("partial_sources")
    return out.withColumn("status", F.when((bad == 0) & (fine > 0), "success").when(fine == 0, "failed").otherwise("partial"))
