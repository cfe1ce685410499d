from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankloom.functions import extract
from rankloom.operators import embeddings, evaluation, ranking, reports, snapshot, winmodel
from rankloom.sources import fetch, records
from rankloom.streaming import ingest


def test_polite_client_waits_and_retries():
    waits, answers = [], [(503, b""), (429, b""), (200, b"body")]
    client = fetch.Polite(lambda url: answers.pop(0), sleep=waits.append, now=lambda: 0.0)
    assert client("u") == b"body" and waits == [0.5, 1.0, 1.0, 1.0]
    for status, calls in ((404, 1), (500, 4)):
        asked = []
        with pytest.raises(OSError):
            fetch.Polite(lambda url: asked.append(url) or (status, b""), sleep=lambda s: None)("u")
        assert len(asked) == calls


def test_resume_takes_the_latest_payload_of_the_day(spark):
    from rankloom.plans.queries import _stand_in

    wanted = spark.createDataFrame([("https://a.org/scholarship/x-1",), ("https://a.org/scholarship/x-2",), ("https://a.org/scholarship/x-7",)], "url string")
    at = [datetime(2026, 2, 22, h) for h in (1, 9)]
    cache = fetch.cached(wanted.limit(1).withColumn("payload", F.lit(b"x")), "s", F.lit(at[0])).unionByName(fetch.cached(wanted.limit(1).withColumn("payload", F.lit(b"new")), "s", F.lit(at[1])))
    got = {r.url[-1]: (r.payload and bytes(r.payload), r.error, r.from_cache) for r in fetch.resumed(wanted, cache, F.lit(at[0]).cast("date"), _stand_in).collect()}
    assert got["1"][0] == b"new" and got["1"][2] and got["2"] == (b"https://a.org/scholarship/x-2", None, False) and got["7"] == (None, "detail_fetch_failed:OSError", False)
    assert cache.first().stamp.endswith("Z") and fetch.fetched(wanted, _stand_in, most=2).count() == 2
    assert wanted.select(fetch.payload_slug(F.lit(" A b/C! ")), fetch.payload_slug(F.lit("--"))).first() == ("a-b-c", "payload")


def test_entities_quotes_and_attribute_order(spark):
    html = "<meta content='Caf&eacute; &#8217;s &amp;amp; &#x1F600; &bogus;' property='og:title'><a class=x href='/a?b=1&amp;c=2'>T</a>"
    row = spark.range(1).select(extract.title(F.lit(html)).alias("t"), extract.anchors(F.lit(html)).alias("a")).first()
    assert row.t == "Café ’s &amp; \U0001f600 &bogus;" and row.a[0].href == "/a?b=1&c=2"


def test_snapshots_in_and_out(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([("b", "t"), ("a", "u"), (None, "v")], "item_id string, title string")
    ready = snapshot.prepared(rows)
    assert tuple(ready.columns) == snapshot.SNAPSHOT and [r.item_id for r in ready.collect()] == ["a", "b", None]
    records.write_snapshot(rows, path, "2026-01-01")
    records.write_snapshot(rows.limit(1), path, "2026-01-02")
    assert records.snapshot(spark, path).count() == 1 and records.snapshot(spark, path, before="2026-01-02").count() == 3
    assert records.snapshot(spark, path, other_than="2026-01-02").count() == 3 and records.snapshot_dates(spark, path).count() == 2


def test_stream_into_snapshot_is_the_same_when_run_again(spark, tmp_path):
    schema = "item_id string, source_url string, title string"
    for i in range(2):
        spark.createDataFrame([("a", "https://x.org/a", "one"), (f"b{i}", "https://x.org/b", "two")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest.into_snapshot(stream, str(tmp_path / "snap"), "2026-01-01", str(tmp_path / f"check{run}")).awaitTermination()
        assert sorted(r.item_id for r in records.snapshot(spark, str(tmp_path / "snap")).collect()) == ["a", "b0", "b1"]


def test_run_status(spark):
    schema = "source string, attempted int, succeeded int, failed int"
    status = lambda *rows: snapshot.run_status(spark.createDataFrame(list(rows), schema)).first().status
    assert status(("a", 1, 1, 0), ("b", 2, 2, 0)) == "success" and status(("a", 1, 0, 1)) == "failed" and status(("a", 1, 1, 0), ("b", 1, 0, 1)) == "partial"
    assert status() == "failed"


def test_embedding_names_paths_and_lookup(spark):
    assert embeddings.model_name(" ") == "sentence-transformers/all-MiniLM-L6-v2" == embeddings.model_name("all-MiniLM-L6-v2")
    assert embeddings.store_path("/d/", "my model/x") == "/d/embeddings/my_model_x"
    embeddings.register("toy", lambda: lambda texts: [[float(len(t))] for t in texts])
    assert embeddings.encoder("toy")(["ab"]) == [[2.0]] and embeddings.encoder("toy") is embeddings.encoder("toy")
    with pytest.raises(ModuleNotFoundError):
        embeddings.encoder("none")
    items = spark.createDataFrame([("k1",), ("k2",)], "embedding_key string")
    with pytest.raises(Exception, match="no vector for k2"):
        embeddings.looked_up(items, spark.createDataFrame([("k1", [1.0])], "embedding_key string, vector array<double>")).collect()


def test_weight_files_and_pointer(tmp_path):
    best = {"config_id": "c", "stage2_weights": {"text": 0.8, "amount": 0.1}, "stage3_weights": {"score": 0.9, "urgency": 0.1, "ev": 0.0}, "amount_utility_mode": "linear"}
    path, pointer = reports.write_best_weights(str(tmp_path), "blended", best, "2026-03-01T00:00:00", similarity_mode="tfidf")
    score, rank, mode, used = reports.resolved_weights(None, path)
    assert (score.text, score.keyword, rank.score, mode, used) == (0.8, 0.10, 0.9, "linear", path) and '"config_id": "c"' in open(pointer).read()
    assert reports.resolved_weights(None, path, use_best=False)[3] is None and reports.resolved_weights(None, str(tmp_path / "no"))[0].text == 0.70
    with pytest.raises(ValueError):
        reports.write_best_weights(str(tmp_path), "other", best, "t")
    with pytest.raises(FileNotFoundError):
        reports.resolved_weights(None, str(tmp_path / "no"), use_best=True)


def test_thresholds_selection_and_report(spark):
    assert reports.active_threshold({"tfidf": 0.12, "embeddings": 0.3}, "tfidf", 0.2) == {"tfidf": 0.2, "embeddings": 0.3}
    schema = "config_id string, stable boolean, ndcg double, coverage double, ev double, sponsor_diversity double, amount_median double"
    rows = spark.createDataFrame([("a", True, 0.9, 0.1, 0.1, 0.5, 10.0), ("b", True, 0.8, 0.9, 0.9, 0.5, 10.0), ("c", False, 1.0, 0.2, 0.2, 0.5, 10.0)], schema)
    pick = lambda objective: reports.selected(rows, objective, {"ndcg": 0.7, "coverage": 0.2, "ev": 0.1}, ["ndcg", "coverage", "ev"], 10.0)[0].first().config_id
    assert [pick(o) for o in reports.OBJECTIVES] == ["a", "b", "b"]
    delta = {r.config_id: r.ndcg for r in reports.against_baseline(rows, ["ndcg"], "a").collect()}
    assert delta == {"a": "+0.0000", "b": "-0.1000", "c": "+0.1000"}
    assert reports.markdown("T", {"ndcg": 0.5, "x": None}, [{"a": 1}], ["a"]) == "# T\n\n- ndcg: 0.5000\n- x: N/A\n\n| a |\n| --- |\n| 1 |\n"


def test_win_model_is_saved_and_predicts_the_same(spark, tmp_path):
    one = lambda c: F.lit(0.5).alias(c)
    rows = winmodel.labelled(spark.range(400).select(F.col("id").alias("sample_id"), *[(F.col("id") % 7 / 7.0).alias(c) if c in ("gpa", "text_sim", "amount_log") else one(c) for c in winmodel.FEATURES]))
    rows = winmodel.split(rows)
    shares = {(r.y, r.part): r.n for r in rows.groupBy("y", "part").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        total = sum(n for (a, _), n in shares.items() if a == y)
        assert shares[y, "train"] == int(0.6 * total) and abs(shares[y, "test"] - 0.2 * total) <= 1
    model = winmodel.train(rows)
    reports.save_model(model, str(tmp_path), "m1")
    a, b = ({r.sample_id: r.p_win for r in winmodel.predict(rows, m).collect()} for m in (model, reports.load_latest_model(str(tmp_path))))
    assert a == b
    told = reports.training_report(winmodel.predict(rows, model), str(tmp_path / "report.json"))
    assert sum(told["sizes"].values()) == 400 and len(told["preview"]) == 25
    with pytest.raises(FileNotFoundError):
        reports.load_latest_model(str(tmp_path / "none"))


def test_win_probability_can_turn_the_order(spark):
    rows = spark.createDataFrame([("p", "a-id", 0.1), ("p", "b-id", 0.9)], "profile_id string, item_id string, p_win double").selectExpr("*", "1000D AS amount_max", "cast(null AS double) AS amount_min", "date'2026-03-01' AS deadline", "date'2026-02-22' AS p_today", "false AS essay_required", "0.5D AS stage_score")
    order = lambda d: [r.item_id for r in ranking.top_k(ranking.rerank(d, ranking.RankWeights(0.0, 0.0, 1.0))).orderBy("place").collect()]
    assert order(rows) == ["b-id", "a-id"] and order(rows.drop("p_win")) == ["a-id", "b-id"]
    assert evaluation.amount_penalty(F.lit(1.0), 0.0) is not None
