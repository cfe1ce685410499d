"""One run from sources to a dated snapshot, its changes and a report that is always written."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import snapshot
from rankloom.sources import records
from rankloom.sources.crawl import Crawl
from rankloom.store import write_text, written

Make = Callable[[SparkSession], "DataFrame | Crawl"]


def _taken(spark: SparkSession, name: str, make: Make) -> tuple[DataFrame | None, dict]:
    """(records of a source or None, what came of it); a source that fails stops no other."""
    told = {"source": name, "attempted": 0, "succeeded": 0, "failed": 0, "error": None}
    try:
        got = make(spark)
        rows = written(got.records if isinstance(got, Crawl) else got, "source")
        n = rows.count()
        failed = got.failures.count() if isinstance(got, Crawl) else 0
        stats = got.stats() if isinstance(got, Crawl) else {}
        return rows, told | {"attempted": n + failed, "succeeded": n, "failed": failed, "stats": stats}
    except Exception as e:  # the report says what failed
        return None, told | {"attempted": 1, "failed": 1, "error": f"{type(e).__name__}: {str(e)[:500]}"}


def _prior(spark: SparkSession, path: str, date: str) -> DataFrame | None:
    try:
        return records.snapshot(spark, path, other_than=date).drop("snapshot_date")
    except Exception as e:
        if isinstance(e, FileNotFoundError) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def run_ingest(
    spark: SparkSession, sources: dict[str, Make], path: str, date: str, report: str, key: Column, now: Column, tracked: tuple[str, ...] = ("deadline", "amount_min", "amount_max", "title", "eligibility_text")
) -> dict:
    """Takes every source, normalises and dedupes, writes the snapshot of the date, and gives the report.

    The counts behind the guardrails come from the pass that writes the snapshot, and the
    changes from what was written.  The report is written also where the run fails, with
    the error in it; the error is then raised.
    """
    out = {"run_date": date, "sources": [], "status": "failed", "counts": {}, "warnings": {}, "delta": {}, "error": None}
    try:
        taken = []
        for name in sorted(sources):
            rows, told = _taken(spark, name, sources[name])
            out["sources"].append(told)
            if rows is not None:
                taken.append(rows)
        attempts = spark.createDataFrame([(t["source"], t["attempted"], t["succeeded"], t["failed"]) for t in out["sources"]], "source string, attempted long, succeeded long, failed long")
        out["status"] = snapshot.run_status(attempts).first().status
        if not taken:
            return out
        every = taken[0]
        for rows in taken[1:]:
            every = every.unionByName(rows, allowMissingColumns=True)
        prior = _prior(spark, path, date)
        before = 0 if prior is None else prior.count()
        kept = snapshot.prepared(snapshot.dedupe(snapshot.normalise_records(every, now))).withColumn("embedding_key", key)
        watched, seen = snapshot.observed(kept)
        records.write_snapshot(watched, path, date)
        counts = seen.get
        out["counts"] = {"before_dedupe": sum(t["succeeded"] for t in out["sources"]), "rows": counts["n_rows"], "missing": counts["n_missing"], "prior": before}
        warned = spark.range(1).select(*[c.alias(n) for n, c in snapshot.warnings(F.lit(counts["n_rows"]), F.lit(counts["n_missing"]), before).items()]).first()
        out["warnings"] = warned.asDict()
        current = spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(date).cast("date")).drop("snapshot_date")
        found = snapshot.changes(current, current.limit(0) if prior is None else prior, "item_id", list(tracked))
        out["delta"] = {r.change_type: r.n for r in found.groupBy("change_type").agg(F.count_distinct("id").alias("n")).collect()}
        return out
    except Exception as e:
        out["status"], out["error"] = "failed", f"{type(e).__name__}: {str(e)[:500]}"
        raise
    finally:
        write_text(spark, report, json.dumps(out, indent=2, sort_keys=True, default=str))
