"""A run from sources to a snapshot, with its report."""

import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions import identity
from rankloom.operators import snapshot
from rankloom.sources.run import run_ingest

ROW = "item_id string, source string, source_url string, title string, amount_max string, keywords array<string>, essay_required string"
NOW = lambda: F.lit("2026-01-01 00:00:00").cast("timestamp")  # noqa: E731  needs a session


def source(rows):
    return lambda spark: spark.createDataFrame(rows, ROW)


def broken(spark):
    raise OSError("no answer")


def run(spark, tmp, sources, date):
    report = f"{tmp}/report-{date}.json"
    try:
        return run_ingest(spark, sources, f"{tmp}/snapshots", date, report, identity.embedding_key(), NOW()), report
    except Exception:
        return None, report


def test_a_run_isolates_sources_counts_while_writing_and_reports(spark, tmp_path):
    a = [(f"i{i}", "a", f"https://a.org/{i}", f"T{i}", "10", [" x ", ""], "yes") for i in range(10)]
    b = [("i0", "b", "https://z.org/0", "later copy", "n/a", None, None), ("j1", "b", None, " ", "5.5", [], None)]
    got, report = run(spark, tmp_path, {"a": source(a), "b": source(b), "c": broken}, "2026-01-01")
    assert got["status"] == "partial" and got["counts"] == {"before_dedupe": 12, "rows": 11, "missing": 1, "prior": 0}
    assert got["warnings"] == {"warn_drop": False, "warn_missing": True} and got["delta"] == {"added": 11}
    assert json.load(open(report)) == json.loads(json.dumps(got)) and "no answer" in got["sources"][2]["error"]
    kept = {r.item_id: r for r in spark.read.parquet(f"{tmp_path}/snapshots").collect()}
    assert kept["i0"].title == "T0" and kept["i0"].keywords == ["x"] and kept["i0"].essay_required is None and kept["j1"].amount_max == 5.5 and kept["j1"].first_seen_at == "2026-01-01T00:00:00Z"
    got, _ = run(spark, tmp_path, {"a": source([(i, s, u, t + "!", m, k, e) for i, s, u, t, m, k, e in a[:4]])}, "2026-01-02")
    assert got["status"] == "success" and got["warnings"]["warn_drop"] and got["delta"] == {"removed": 7, "changed": 4}
    again, _ = run(spark, tmp_path, {"a": source(a[:4])}, "2026-01-02")
    assert again["counts"]["prior"] == 11 and again["delta"] == {"removed": 7}


def test_the_report_is_written_also_where_the_run_fails(spark, tmp_path):
    got, report = run(spark, tmp_path, {"c": broken}, "2026-01-01")
    assert got["status"] == "failed" and json.load(open(report))["sources"][0]["failed"] == 1
    bad = lambda spark: spark.createDataFrame([("x", 1)], "item_id string, title_of int")
    got, report = run(spark, tmp_path, {"a": bad}, "2026-01-03")
    told = json.load(open(report))
    assert got is None and told["status"] == "failed" and told["error"]


def test_counts_are_observed_in_the_pass_that_writes(spark, tmp_path):
    rows = spark.createDataFrame([("t", "u"), (None, "u"), (" ", None)], "title string, source_url string")
    watched, seen = snapshot.observed(rows)
    watched.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"n_rows": 3, "n_missing": 2}
    plan = watched._jdf.queryExecution().executedPlan().toString()
    assert "CollectMetrics" in plan and "Exchange" not in plan


def test_missing_and_odd_columns_are_normalised(spark):
    raw = spark.createDataFrame([("a", "NaN", "x,y", True), ("b", "7", None, None)], "item_id string, min_gpa string, states_allowed string, is_recurring boolean")
    got = {r.item_id: r for r in snapshot.normalise_records(raw, NOW()).collect()}
    assert got["a"].min_gpa is None and got["b"].min_gpa == 7.0 and got["a"].states_allowed is None and got["a"].is_recurring is True
    assert got["b"].keywords is None and got["b"].deadline is None and got["b"].last_seen_at == "2026-01-01T00:00:00Z"
