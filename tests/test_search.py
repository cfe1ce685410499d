"""The search that meets what is alike once gives what the whole product gives."""

import datetime
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import item_text, profile_text
from rankloom.operators import evaluation, ranking, search, similarity

ITEM = "item_id string, source string, title string, sponsor string, description string, eligibility_text string, essay_prompt string, deadline date, amount_min double, amount_max double, essay_required boolean, states_allowed array<string>, majors_allowed array<string>, education_level string, citizenship string, min_gpa double, keywords array<string>"
PROFILE = "profile_id string, gpa double, state string, major string, education_level string, citizenship string, today date, keywords array<string>, interests array<string>, extracurriculars array<string>, goals string"


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    day = datetime.date(2026, 3, 1)
    some = lambda *v: draw.choice(v)
    items = [
        (f"i{i}", "s", some("red bolt", "blue ring plate", ""), some("Acme", None), some("hot bolt gear", None), None, None, some(day, day - datetime.timedelta(9), None), some(10.0, None), some(20.0, 30.0, None), some(True, False, None),
         some(["NY ", "ca"], [], None), some(["Art"], None), some("Level", ""), some("US", None), some(2.0, 3.0, float("nan"), None), some(["bolt"], None))
        for i in range(60)
    ]
    profiles = [(f"p{i}", some(1.0, 2.0, 2.5, 2.9, 3.5, float("nan"), None), some("ny", "tx"), some("art", None), some("level", "other"), some("us", None), some(day, None), some(["red"], None), some(["bolt"], []), [], some("gear", "")) for i in range(90)]
    return spark.createDataFrame(items, ITEM), spark.createDataFrame(profiles, PROFILE)


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("own_gpa", [False, True])
def test_what_is_alike_is_met_once_and_every_pair_gets_its_verdict(tables, own_gpa):
    items, profiles = tables
    s = search.search(items, profiles, own_gpa)
    got = s.verdicts(F.array_join(ranking.reasons(), ",").alias("reasons"), ranking.eligible().alias("eligible"))
    both = ranking.pairs(items, profiles).withColumn("reasons", ranking.reasons())
    want = both.select("profile_id", "item_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("eligible"))
    assert rows(got.select(*want.columns)) == rows(want)
    counted = s.kind_pairs().select(ranking.reasons().alias("reasons"), "n")
    assert rows(evaluation.reason_counts(counted, "n")) == rows(evaluation.reason_counts(both))
    assert rows(evaluation.eligibility_precision(counted, "n")) == rows(evaluation.eligibility_precision(both))


def test_alike_profiles_share_one_answer(spark, tables):
    items, profiles = tables
    many = profiles.where("profile_id = 'p0'").crossJoin(spark.range(40)).withColumn("profile_id", F.concat(F.lit("q"), "id")).drop("id")
    s = search.search(items.where("min_gpa > 2 or min_gpa is null"), many.withColumn("gpa", F.lit(2.0) + F.substring("profile_id", 2, 2).cast("double") / 100))
    assert s.n_asked == 1 and s.members.count() == 40
    assert s.eligible.count() == s.eligible.distinct().count() <= s.kinds.count()
    assert search.search(items, many.withColumn("gpa", F.rand(3)), own_gpa=True).n_asked == 40


def test_scores_over_kinds_equal_scores_over_pairs(tables):
    items, profiles = tables
    s = search.search(items, profiles)
    got = s.expanded(ranking.rerank(ranking.score(s.pairs(), frames=s.frames())))
    eligible = ranking.pairs(items, profiles).where(ranking.eligible())
    texts = items.select("item_id", item_text().alias("text"))
    sims = similarity.tfidf(eligible.select("profile_id", "item_id"), texts, profiles.select("profile_id", profile_text().alias("text")))
    want = ranking.rerank(ranking.score(eligible.join(sims, ["profile_id", "item_id"])))
    columns = ["profile_id", "item_id", *[F.round(c, 9).alias(c) for c in ("text_sim", "amount_utility", "keyword_overlap", "stage_score", "urgency", "ev_norm", "final_score")]]
    assert rows(got.select(*columns)) == rows(want.select(*columns)) and want.count() > 100
    assert rows(s.expanded(ranking.top_k(ranking.rerank(ranking.score(s.pairs(), frames=s.frames())))).select("profile_id", "item_id", "place")) == rows(ranking.top_k(want).select("profile_id", "item_id", "place"))
    won = s.items.withColumn("p_win", F.length("item_id") / 10.0)
    with_p = want.drop(*[c for c in want.columns if c.startswith("f_")]).withColumn("p_win", F.length("item_id") / 10.0)
    value = ["profile_id", "item_id", F.round("expected_value_norm", 9).alias("v")]
    assert rows(s.expanded(ranking.rerank(ranking.score(s.pairs(won), frames=s.frames(won)))).select(*value)) == rows(ranking.rerank(ranking.with_frame(with_p)).select(*value))


def test_similarity_equals_brute_force_in_any_number_of_parts(tables, monkeypatch):
    items, profiles = tables
    monkeypatch.setattr(similarity, "TEXTS_A_TASK", 2)  # several tasks a profile
    s = search.search(items, profiles)
    got = {(r.profile_id, r.item_id): r.text_sim for r in s.expanded(s.similarities()).collect()}

    def bag(text):
        words = [w for w in re.findall(r"\w{2,}", text.lower()) if w not in similarity.STOP_WORDS]
        return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])

    texts = {r[0]: bag(r[1]) for r in items.select("item_id", item_text()).collect()}
    own = {r[0]: bag(r[1]) for r in profiles.select("profile_id", profile_text()).collect()}
    pairs = [tuple(r) for r in ranking.pairs(items, profiles).where(ranking.eligible()).select("profile_id", "item_id").collect()]
    assert set(pairs) == set(got) and any(got.values())
    for p in {p for p, _ in pairs}:
        corpus = {i: texts[i] for q, i in pairs if q == p} | {"": own[p]}
        df = Counter(t for b in corpus.values() for t in b)
        w = {i: {t: n * (math.log((1 + len(corpus)) / (1 + df[t])) + 1) for t, n in b.items()} for i, b in corpus.items()}
        length = {i: math.sqrt(sum(x * x for x in b.values())) for i, b in w.items()}
        for i in corpus:
            if i:
                below = length[i] * length[""]
                assert got[p, i] == pytest.approx(sum(x * w[""].get(t, 0) for t, x in w[i].items()) / below if below else 0.0, abs=1e-8)


def test_tuning_counts_every_profile(tables):
    items, profiles = tables
    s = search.search(items, profiles)
    columns = ("profile_id", "item_id", "deadline", "text_sim", "keyword_overlap", "amount_utility", "effort_penalty", "urgency", "ev_norm", "amount_max", "sponsor", "source")
    asked = ranking.rerank(ranking.score(s.pairs(), frames=s.frames())).select(*columns, ranking.relevance().alias("relevance"))
    configs = evaluation.grid(asked.sparkSession, 3)
    assert s.n_asked < s.members.count()
    assert rows(evaluation.tuned(asked, configs, expanded=s.expanded)) == rows(evaluation.tuned(s.expanded(asked), configs))


def test_a_search_of_nothing_finds_nothing(tables):
    items, profiles = tables
    s = search.search(items.limit(0), profiles)
    assert s.verdicts(ranking.eligible().alias("e")).count() == s.expanded(s.pairs()).count() == 0
    assert evaluation.eligibility_precision(s.kind_pairs().select(ranking.reasons().alias("reasons"), "n"), "n").first().n_pairs == 0


def test_the_win_model_is_one_expression_that_equals_its_pipelines(spark):
    from pyspark.ml.functions import vector_to_array

    from rankloom.operators import winmodel

    draw = random.Random(9)
    data = [(i, *[draw.random() for _ in winmodel.FEATURES[:-1]], 1.0, int(draw.random() < 0.4), ("train", "calibration")[i % 2]) for i in range(200)]  # the last feature is constant
    samples = spark.createDataFrame(data, "sample_id long, " + ", ".join(f"{c} double" for c in winmodel.FEATURES) + ", y int, part string")
    model = winmodel.train(samples)
    got = winmodel.predict(samples, model)
    want = model[1].transform(model[0].transform(samples).withColumn("_p", vector_to_array("_prob")[1])).select("sample_id", vector_to_array("_cprob")[1].alias("w"))
    both = got.join(want, "sample_id").collect()
    assert len(both) == 200 and all(r.p_win == pytest.approx(r.w, abs=1e-12) for r in both)
    assert "UDF" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="a feature is missing"):
        winmodel.predict(samples.withColumn("gpa", F.lit(None).cast("double")), model).collect()
