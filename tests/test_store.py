"""The embedding store, ranking by the trained model, and links out of HTML."""

import math
import os
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from rankloom.functions import extract
from rankloom.operators import embeddings, ranking, winmodel

ITEM = "item_id string, title string, sponsor string, description string, eligibility_text string, essay_prompt string"


def items(spark, n, word="x"):
    return spark.createDataFrame([(f"i{i}", f"title {word} {i}", None, "d", None, None) for i in range(n)], ITEM)


def test_only_missing_keys_are_encoded_and_only_their_buckets_written(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)  # driver side only: counts makers

    def make():
        return lambda texts: [[float(len(t)), 0.0, 3.0] if "zero" not in t else [0.0, 0.0, 0.0] for t in texts] if len(texts) <= 4 else 1 / 0

    embeddings.register("counted", make)
    root = str(tmp_path)
    keyed, n = embeddings.ensure_store(items(spark, 30), root, "counted", batch=4)
    assert n == 30 and keyed.columns[-1] == "embedding_key" and calls.value == 0
    path = embeddings.store_path(root, "counted")
    stamp = lambda: {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path) if d.startswith("bucket=")}
    files = lambda: {f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before, had = stamp(), files()
    assert embeddings.ensure_store(items(spark, 30), root, "counted", batch=4)[1] == 0 and files() == had
    again = items(spark, 31)
    assert embeddings.ensure_store(again, root, "counted", batch=4)[1] == 1
    touched = embeddings.stored(spark, path).join(again.where("item_id = 'i30'"), "item_id").first().bucket
    assert all(f in files() for d, _, names in os.walk(path) for f in names if f in had) and f"bucket={touched}" in stamp() and len(had - files()) <= 3 and before
    rows = embeddings.stored(spark, path).collect()
    assert len(rows) == len({r.embedding_key for r in rows}) == 31
    assert all(abs(math.fsum(x * x for x in r.vector) - 1) < 1e-6 for r in rows)
    new = spark.createDataFrame([(rows[0].embedding_key, "other", [1.0, 0.0, 0.0])], "embedding_key string, item_id string, vector array<float>")
    assert embeddings.upsert(spark, path, new) == 1
    now = {r.embedding_key: r for r in embeddings.stored(spark, path).collect()}
    assert len(now) == 31 and now[rows[0].embedding_key].item_id == "other"
    zero, _ = embeddings.ensure_store(items(spark, 1, "zero"), root, "counted")
    assert list(embeddings.looked_up(zero, embeddings.stored(spark, path)).first().vector) == [0.0, 0.0, 0.0]
    assert embeddings.ensure_store(items(spark, 0), root, "counted")[0].count() == 0
    with pytest.raises(ModuleNotFoundError):
        embeddings.ensure_store(items(spark, 1), root, "unknown")


def test_the_model_branch_ranks_by_what_the_model_says(spark):
    from rankloom.plans import queries

    sf_dir = "/root/testdata/sf0.001"
    model = winmodel.train(queries._samples(spark, sf_dir, 600))
    scored = ranking.score(queries._eligible(spark, sf_dir))
    rows = ranking.rerank(ranking.with_frame(winmodel.with_p_win(scored, model))).select("*", *[x.alias(f"x_{c}") for c, x in ranking.pair_features().items()]).collect()
    base, calibrator = model
    scaler, lr, cal = base.stages[1], base.stages[2], calibrator.stages[1]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    value = {}
    for r in rows:
        x = [r[f"x_{c}"] for c in winmodel.FEATURES]
        z = [(v - m) / s if s else 0.0 for v, m, s in zip(x, scaler.mean, scaler.std)]
        p = sigmoid(cal.coefficients[0] * sigmoid(lr.intercept + sum(a * b for a, b in zip(lr.coefficients, z))) + cal.intercept)
        assert r.p_win == pytest.approx(p, abs=1e-9)
        value[r.profile_id, r.item_id] = p * (r.amount_max if r.amount_max is not None else r.amount_min or 0.0)
    for r in rows:
        own = [v for (q, _), v in value.items() if q == r.profile_id]
        norm = (value[r.profile_id, r.item_id] - min(own)) / (max(own) - min(own)) if max(own) > min(own) else 0.0
        assert r.final_score == pytest.approx(0.8 * r.stage_score + 0.15 * r.urgency + 0.05 * norm, abs=1e-9)


class _Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.href, self.text = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and self.href is None and dict(attrs).get("href") is not None:
            self.href, self.text = dict(attrs)["href"], []

    def handle_data(self, data):
        if self.href is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.out.append((self.href.strip(), " ".join(" ".join(self.text).split())))
            self.href = None


ODD = [
    "<a href=/bare>Bare</a><a\nclass='x' HREF = '/q?a=1&amp;b=2'>A &amp; B</a>", '<a href="/n"><b>one</b><i> two</i></a><a name=z>no</a>', "<a data-href='/no'>no</a>",
    '<a title="a > b" href="/gt">gt</a>', "<!-- <a href='/c'>c</a> --><A HREF=/up>UP</A>", "<abbr href='/x'>x</abbr>", '<a href="">empty</a>', "no links", "",
]


def test_links_equal_a_parser_on_pages_and_odd_html(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()] + ODD
    table = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, h string").select("i", extract.anchors(F.col("h")).alias("a"))
    got = {r.i: [(a.href, a.text) for a in r.a] for r in table.collect()}
    for i, html in enumerate(pages):
        parser = _Links()
        parser.feed(html)
        assert got[i] == parser.out, html[:200]


def test_essay_prompts_and_detail_urls(spark):
    from rankloom.sources import records

    rows = [("https://a.org/scholarship/x", "<h1>X</h1><p>Essay Prompt: Why you?; </p>"), ("https://a.org/about", "<h1>About</h1>us"), ("https://a.org/scholarship/y.pdf", "<h1>Y</h1>z")]
    got = {r.source_url: r.essay_prompt for r in records.detail_pages(spark.createDataFrame(rows, "url string, html string"), host="a.org").collect()}
    assert got == {"https://a.org/scholarship/x": "Why you?"}
