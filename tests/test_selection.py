"""Skylines, exact quantiles, numbering, tuning and frames against brute force."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import evaluation, ranking, skyline
from rankloom.operators.numbering import numbered
from rankloom.operators.quantiles import quantile

COMPONENT = "profile_id string, item_id string, deadline date, urgency double, text_sim double, keyword_overlap double, amount_utility double, effort_penalty double, ev_norm double, relevance int, amount_max double, sponsor string, source string"


def brute_band(rows, k, margin=0.0):
    over = lambda a, b: all(x >= y for x, y in zip(a, b)) and any(x > y + margin for x, y in zip(a, b))
    return {i for i, r in enumerate(rows) if sum(over(o, r) for o in rows) < k}


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("chunk_rows", [10_000, 7])
def test_skyband_equals_brute_force_in_any_chunks(spark, k, chunk_rows):
    rnd = random.Random(k)
    rows = [(g, i, *(rnd.choice([0.0, 0.25, 0.5, 1.0, None]) for _ in range(3))) for g in ("a", "b", None) for i in range(70)]
    table = spark.createDataFrame(rows, "g string, i int, x double, y double, z double").repartition(4)
    got = {(r.g, r.i) for r in skyline.skyband(table, ["g"], ["x", "y", "z"], k, chunk_rows=chunk_rows).collect()}
    want = set()
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want |= {(g, own[i][1]) for i in brute_band([[-np.inf if v is None else v for v in r[2:]] for r in own], k)}
    assert got == want


def test_ties_count_as_one_more_measure(spark):
    rows = [("p", f"i{n}", date(2026, 1, 1 + n % 3) if n % 4 else None, 0.5) for n in range(12)]
    table = spark.createDataFrame(rows, "g string, i string, d date, x double")
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or date.min, r[1]))
    got = {r.i for r in skyline.skyband(table, ["g"], ["x"], 4, ties=[("d", "ascending"), ("i", "ascending")], chunk_rows=5).collect()}
    assert got == {r[1] for r in order[:4]}


def test_pareto_front_of_many_rows_has_no_nested_loop(spark):
    table = spark.range(100_000).select(F.col("id").cast("string").alias("config_id"), *[(F.pmod(F.xxhash64("id", F.lit(m)), F.lit(1 << 20)) / (1 << 20)).alias(m) for m in ("ndcg", "coverage", "ev")])
    front = evaluation.pareto_front(table, ["ndcg", "coverage", "ev"])
    assert "NestedLoop" not in front._jdf.queryExecution().executedPlan().toString()
    x = np.array([[r.ndcg, r.coverage, r.ev] for r in table.collect()])
    got = front.collect()
    assert len({r.config_id for r in got}) == len(got) == len(skyline.loose_front(x[skyline.band(x, 1)], evaluation.EPSILON))
    best = np.array([[r.ndcg, r.coverage, r.ev] for r in got])
    assert not any(((x >= b).all(1) & (x > b).any(1)).any() for b in best)


def test_pareto_front_within_a_margin_equals_its_definition(spark):
    rnd, e = random.Random(5), evaluation.EPSILON
    rows = [(f"c{i}", *(rnd.choice([0.1, 0.1 + 0.7e-9, 0.1 + 1.5e-9, 0.1 - 0.9e-9, 0.2]) for _ in range(3))) for i in range(60)] + [("none", None, 0.1, 0.2)]
    value = lambda r: [v or 0.0 for v in r[1:]]
    over = lambda a, b: all(x >= y - e for x, y in zip(a, b)) and any(x > y + e for x, y in zip(a, b))
    want = {r[0] for r in rows if not any(over(value(o), value(r)) for o in rows)}
    got = evaluation.pareto_front(spark.createDataFrame(rows, "config_id string, ndcg double, coverage double, ev double"), ["ndcg", "coverage", "ev"])
    assert {r.config_id for r in got.collect()} == want


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_are_exact(spark, share):
    rnd = random.Random(1)
    groups = {"ties": [rnd.choice([0.1, 0.2, 0.3]) for _ in range(400)], "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-200, 200) for _ in range(300)], "one": [7.0], "close": [1 + i * 2.0**-52 for i in range(50)], "same": [0.5] * 30}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None), ("one", float("nan"))]
    got = {r.g: r.q for r in quantile(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", share).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(float(np.quantile(vs, share)), rel=1e-12)


def test_numbers_follow_the_order(spark):
    table = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(90)).alias("a"), "id")
    rows = numbered(table, "n", F.col("a").desc(), F.col("id")).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(500)) and [(r.a, r.id) for r in rows] == sorted(((r.a, r.id) for r in rows), key=lambda x: (-x[0], x[1]))


def components(seed, n_profiles=3, n_items=120):
    """Rows with many ties, also by clipping at 0 and 1."""
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    return [
        (f"p{p}", f"i{i:03}", *pick((None, 0.0), (date(2026, 1, 1), 0.9), (date(2026, 2, 1), 0.3)), pick(0.0, 0.0, 0.4, 1.0, rnd.random()), pick(0.0, 0.5, 1.0), pick(0.0, 1.0, rnd.random()), pick(0.0, 1.0), pick(0.0, 0.9), pick(0, 1, 2), pick(None, 10.0, 35.0, 7.5), pick(None, " ", "s1", "s2"), pick("x", "y"))
        for p in range(n_profiles) for i in range(n_items)
    ]


def test_contenders_hold_every_list_and_metrics_equal_brute_force(spark):
    rows = components(2)
    table = spark.createDataFrame(rows, COMPONENT).repartition(3)
    configs = evaluation.grid(spark, 40)
    names = [c.split()[0] for c in COMPONENT.split(", ")]
    few = {(r.profile_id, r.item_id) for r in evaluation.contenders(table).collect()}
    assert len(few) < len(rows)
    got = {r.config_id: r for r in evaluation.tuned(table, configs, eligibility_rate=0.5).collect()}
    for c in configs.collect():
        top = {}
        for p in sorted({r[0] for r in rows}):
            own = [dict(zip(names, r)) for r in rows if r[0] == p]
            for r in own:
                stage = c.text * r["text_sim"] + c.amount * r["amount_utility"] + c.keyword * r["keyword_overlap"] - c.effort * r["effort_penalty"]
                r["score"] = round(c.score * min(max(stage, 0.0), 1.0) + c.urgency * r["urgency"] + c.ev * r["ev_norm"], 10)
            top[p] = sorted(own, key=lambda r: (-r["score"], r["deadline"] is None, r["deadline"] or date.min, r["item_id"]))[:10]
            assert {(p, r["item_id"]) for r in top[p]} <= few
        pooled = [r for t in top.values() for r in t]
        dcg = lambda labels: sum((2**x - 1) / np.log2(i + 2) for i, x in enumerate(labels))
        ndcg = [dcg([r["relevance"] for r in t]) / (dcg(sorted((r["relevance"] for r in t), reverse=True)) or 1) for t in top.values()]
        amounts = [r["amount_max"] for r in pooled if r["amount_max"] is not None]
        sponsors = [r["sponsor"].strip() for r in pooled if r["sponsor"] and r["sponsor"].strip()]
        m = got[c.config_id]
        assert m.stable and m.eligibility_rate == 0.5 and m.n_amounts == len(amounts)
        assert (m.ndcg, m.coverage, m.ev) == pytest.approx((np.mean(ndcg), len({r["item_id"] for r in pooled}) / len(pooled), np.mean([r["ev_norm"] for r in pooled])), abs=1e-7)
        assert (m.amount_mean, m.amount_median, m.amount_most) == pytest.approx((np.mean(amounts), np.median(amounts), max(amounts)), abs=1e-6)
        assert (m.sponsor_diversity, m.source_diversity) == pytest.approx((len(set(sponsors)) / len(sponsors), len({r["source"] for r in pooled}) / len(pooled)))


def test_win_values_are_averaged_per_list(spark):
    rows = spark.createDataFrame(components(3, 2, 30), COMPONENT).withColumn("expected_value_norm", F.col("ev_norm")).withColumn("p_win", F.col("text_sim")).withColumn("expected_value", F.col("text_sim") * 10)
    m = evaluation.tuned(rows, evaluation.grid(spark, 1), value="expected_value_norm").first()
    assert m.avg_expected_value == pytest.approx(10 * m.avg_p_win, abs=1e-7) and m.median_expected_value == pytest.approx(10 * m.median_p_win, abs=1e-7)


def test_objectives_are_read(spark):
    assert evaluation.objective_weights(" NDCG@K=0.7, coverage_at_k=0.2,Expected_Value=0.1", True) == {"ndcg": 0.7, "coverage": 0.2, "ev": 0.1}
    assert evaluation.objective_weights("ndcg=0.9,ev=0.1", False, strict=False) is None
    for bad in ("", "ndcg", "ndcg=0.5", "ndcg=x", "speed=1", "ndcg=nan"):
        with pytest.raises(ValueError):
            evaluation.objective_weights(bad, True)
    with pytest.raises(ValueError):
        evaluation.objective_weights("ndcg=0.9,ev=0.1", False)
    assert evaluation.pareto_metrics("ndcg, ev,NDCG@k,coverage", False) == ["ndcg", "coverage"]
    for bad in ("", "ev", "cost"):
        with pytest.raises(ValueError):
            evaluation.pareto_metrics(bad, False)


def test_ranking_has_no_window_over_a_frame(spark):
    from rankloom.plans import queries

    plan = queries.rank_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert len(windows) == 1 and "row_number" in windows[0] and "WindowGroupLimit" in plan


def test_scoring_drops_stale_outputs_and_takes_empty_frames(spark):
    both = ranking.pairs(spark.createDataFrame([], "item_id string, title string, deadline date, amount_min double, amount_max double, essay_required boolean, states_allowed array<string>, majors_allowed array<string>, education_level string, citizenship string, min_gpa double, keywords array<string>"), spark.createDataFrame([("p", None, None, None, None, None, None, None, None)], "profile_id string, gpa double, state string, major string, education_level string, citizenship string, today date, keywords array<string>, interests array<string>"), 1)
    scored = ranking.score(both)
    assert scored.count() == 0 and {"text_sim", "amount_utility", "keyword_overlap", "effort_penalty", "stage_score"} <= set(scored.columns)
    assert ranking.score(scored).columns.count("stage_score") == 1
