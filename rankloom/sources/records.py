"""Reading records and payloads, and dated snapshots in and out."""

from __future__ import annotations

import json
import os
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import extract, identity
from rankloom.store import written

POST = "struct<id:string,link:string,slug:string,date:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,content:struct<rendered:string>>"


class Source(Protocol):
    """A named source of records; `records` gives rows with the item columns."""

    name: str

    def records(self, spark: SparkSession) -> DataFrame: ...


_SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    _SOURCES[source.name] = source
    return source


def all_records(spark: SparkSession) -> DataFrame:
    """Rows of every registered source, missing columns as nulls."""
    out = None
    for name in sorted(_SOURCES):
        rows = _SOURCES[name].records(spark)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is registered")
    return out


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records by suffix: .parquet or .json (an array or lines)."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"records are .parquet or .json, not {path}")


def posts(payloads: DataFrame, raw: str = "raw", sponsor: str | None = None) -> DataFrame:
    """Posts of a WordPress-style JSON payload (an object or an array, a leading BOM dropped) as items."""
    text = F.regexp_replace(F.col(raw).cast("string"), "^\\s*\ufeff?\\s*", "")
    many = F.when(text.startswith("["), F.from_json(text, f"array<{POST}>")).otherwise(F.array(F.from_json(text, POST)))
    rows = payloads.select(F.explode(many).alias("p")).where("p is not null").select("p.*")
    title = extract.clean_text(F.col("title.rendered"))
    body = extract.clean_text(F.concat_ws(" ", "excerpt.rendered", "content.rendered"))
    rows = rows.select(
        F.nullif(F.trim("id"), F.lit("")).alias("source_id"),
        F.nullif(F.trim("link"), F.lit("")).alias("source_url"),
        title.alias("title"),
        F.lit(sponsor).cast("string").alias("sponsor"),
        F.nullif(extract.clean_text(F.col("excerpt.rendered")), F.lit("")).alias("description"),
        F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(body, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit("")))).alias("deadline"),
        extract.amounts(body).alias("_a"),
        F.when(F.trim("slug") != "", F.array(F.lower(F.trim("slug")))).alias("keywords"),
    )
    rows = rows.select("*", F.col("_a.low").alias("amount_min"), F.col("_a.high").alias("amount_max")).drop("_a")
    return rows.withColumn("item_id", identity.canonical_id())


def detail_pages(pages: DataFrame, url: str = "url", html: str = "html", sponsor: Column | None = None, states: tuple[str, ...] = (), host: str | None = None) -> DataFrame:
    """Detail pages as items; pages without text, error pages by their titles and (given the host) URLs of no detail page are left out."""
    from rankloom.functions.urls import slug
    from rankloom.sources.fetch import is_detail

    if host is not None:
        pages = pages.where(is_detail(F.col(url), F.lit(""), host))

    rows = pages.select(F.col(url).alias("source_url"), F.col(html).alias("_h"), extract.html_text(F.col(html)).alias("_t"))
    rows = rows.withColumn("title", F.coalesce(F.nullif(extract.title(F.col("_h")), F.lit("")), F.initcap(F.replace(slug(F.col("source_url")), F.lit("-"), F.lit(" ")))))
    rows = rows.where((F.col("_t") != "") & ~F.lower("title").rlike("browse|not found|access denied"))
    rows = rows.withColumns(
        {
            "sponsor": sponsor if sponsor is not None else F.nullif(extract.labelled_field(F.col("_t"), ["sponsor", "provider"], ["deadline", "eligibility", "award", "institution"]), F.lit("")),
            "description": F.nullif(extract.description(F.col("_h")), F.lit("")),
            "eligibility_text": F.nullif(extract.eligibility(F.col("_t")), F.lit("")),
            "deadline": F.to_date(F.try_to_timestamp(extract.deadline(F.col("_t")))),
            "_a": extract.amounts(F.col("_t")),
            "essay_required": extract.essay_required(F.col("_t")),
            "essay_prompt": extract.essay_prompt(F.col("_t")),
            "states_allowed": extract.listed_names(F.col("_t"), list(states)) if states else F.lit(None).cast("array<string>"),
            "keywords": F.array(slug(F.col("source_url"))),
        }
    )
    return rows.select("*", F.col("_a.low").alias("amount_min"), F.col("_a.high").alias("amount_max")).drop("_a", "_h", "_t").withColumn("item_id", identity.canonical_id())


def write_snapshot(rows: DataFrame, path: str, date: str) -> None:
    """rows as the snapshot of a date; Spark's commit makes the partition appear whole or not at all."""
    rows.withColumn("snapshot_date", F.lit(date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def snapshot_dates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("snapshot_date").distinct().orderBy("snapshot_date")


def snapshot(spark: SparkSession, path: str, before: str | None = None, other_than: str | None = None) -> DataFrame:
    """The latest snapshot; or the latest before a date; or, as older tools do, the latest whose date differs."""
    rows = spark.read.parquet(path)
    if before:
        rows = rows.where(F.col("snapshot_date") < F.lit(before).cast("date"))
    if other_than:
        rows = rows.where(F.col("snapshot_date") != F.lit(other_than).cast("date"))
    last = rows.agg(F.max("snapshot_date")).first()[0]
    if last is None:
        raise FileNotFoundError(f"no snapshot in {path}")
    return rows.where(F.col("snapshot_date") == F.lit(last))


def as_json(row: Column) -> Column:
    """A struct as JSON with its nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_json(value: dict, path: str) -> None:
    """A small report, written aside and renamed."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(aside, path)


def crawl(links: DataFrame, roots: DataFrame, rounds: int = 3) -> DataFrame:
    """(url, depth): what can be reached from the roots over (source, target), breadth first.

    Each round joins only the last frontier and drops what was seen before.  Rounds end as
    tables, so the plan of a round does not depend on how many came before.
    """
    frontier = seen = written(roots.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in range(1, rounds + 1):
        found = frontier.select(F.col("url").alias("source")).join(links, "source").select(F.col("target").alias("url")).distinct()
        frontier = written(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = written(seen.unionByName(frontier), "seen")
    return seen
