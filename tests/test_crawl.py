"""Crawls, polite fetching and JSON walks."""

import json
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.sources import crawl, fetch, walk

ROOT = "https://www.site.org/students/browse-scholarships"


def link(path, text="x"):
    return f'<a class="c" href="{path}">{text}</a>'


WEB = {
    "https://site.org/students/browse-scholarships": link("/students/scholarships/b") + link("/students/scholarships/a") + link("/scholarship/one") + '<script>FWP_JSON = {"preload_data": {"settings": {"pager": {"total_pages": 3}}}}</script>',
    "https://site.org/students/browse-scholarships?_paged=2": link("/scholarship/two") + link("https://other.org/scholarship/no"),
    "https://site.org/students/scholarships/a": link("../scholarships/c") + link("/scholarship/one#top") + ' "https://site.org/wp-json/x"',
    "https://site.org/students/scholarships/b": link("/scholarship/three/"),
    "https://site.org/students/scholarships/c": link("/students/scholarships/a") + link("/scholarship/four.pdf"),
    "https://site.org/wp-json/x": json.dumps({"https://site.org/scholarship/key": [{"deep": {"er": ["https:\\/\\/site.org\\/scholarship\\/json".replace("\\", "")]}}, 7, None, True]}),
    "https://site.org/scholarship/one": "<h1>One award</h1><p>Some text of one.</p>",
    "https://site.org/scholarship/two": "<h1>Page not found</h1>",
    "https://site.org/scholarship/json": "<h1>Json award</h1>Text",
}


def web(spark):
    pages = spark.createDataFrame([(u, h.encode()) for u, h in WEB.items()], "url string, payload binary")
    return lambda wanted: wanted.join(pages, "url", "left").select("url", "payload", F.when(F.col("payload").isNull(), "detail_fetch_failed:OSError").alias("error"))


def site(**over):
    return crawl.Site(ROOT, "site.org", **over)


def test_listings_come_in_the_order_of_a_queue(spark):
    got = crawl.listings(spark, site(listing_pages=None), web(spark))
    rows = sorted((r.depth, r.place, r.url.removeprefix("https://site.org")) for r in got.listings.collect())
    assert [r[2] for r in rows] == ["/students/browse-scholarships", "/students/browse-scholarships?_paged=2", "/students/browse-scholarships?_paged=3", "/students/scholarships/a", "/students/scholarships/b", "/students/scholarships/c"]
    assert {r.url for r in got.failures.collect()} == {"https://site.org/students/browse-scholarships?_paged=3"} and got.caps == []
    assert {(r.url.removeprefix("https://site.org"), r.kind) for r in got.links.collect()} >= {("/scholarship/one", "detail"), ("/scholarship/three", "detail"), ("/wp-json/x", "json")}


@pytest.mark.parametrize("cap,want", [(1, 1), (3, 3), (4, 4)])
def test_caps_count_pages_that_came(spark, cap, want):
    got = crawl.listings(spark, site(listing_pages=cap), web(spark))
    fine = [r.url for r in got.listings.where("error is null").collect()]
    assert len(fine) == len(set(fine)) == want and got.caps == ["max_listing_pages"]


def test_a_whole_crawl_keeps_going_past_failures(spark):
    got = crawl.crawl(spark, site(listing_pages=None), web(spark))
    assert [(r.source_url, r.title) for r in got.records.collect()] == [("https://site.org/scholarship/json", "Json award"), ("https://site.org/scholarship/one", "One award")]
    reasons = {r.url.rsplit("/", 1)[1]: r.reason for r in got.failures.collect()}
    assert reasons["three"] == "detail_fetch_failed:OSError" and reasons["two"] == "invalid_or_non_scholarship_page"
    stats = got.stats()
    assert stats["detail_urls_discovered"] == 4 and stats["detail_urls_succeeded"] == 2 and stats["listing_urls_processed"] == 5
    few = crawl.crawl(spark, site(detail_pages=1), web(spark))
    assert few.details.count() == 1 and "max_detail_pages" in few.caps
    clock = iter(range(100))
    none = crawl.crawl(spark, site(seconds=0.5, now=lambda: next(clock)), web(spark))
    assert none.caps == ["max_runtime_seconds"] and none.records.count() == none.details.count() == none.listings.count() == 0


def test_the_plan_of_a_round_does_not_depend_on_depth(spark):
    chain = {f"https://site.org/students/scholarships/{i:02}": link(f"/students/scholarships/{i + 1:02}") for i in range(7)}
    pages = spark.createDataFrame([(u, h.encode()) for u, h in chain.items()], "url string, payload binary")
    plans = []

    def get(wanted):
        plans.append(len(wanted._jdf.queryExecution().analyzed().toString().split("\n")))
        return wanted.join(pages, "url").select("url", "payload", F.lit(None).cast("string").alias("error"))

    got = crawl.listings(spark, crawl.Site("https://site.org/students/scholarships/00", "site.org", listing_pages=None), get)
    assert got.listings.where("error is null").count() == 7 and len(set(plans[1:])) == 1


def test_links_are_joined_as_browsers_do(spark):
    from urllib.parse import urljoin

    base = "https://a.org/x/y/page.html?q=1#f"
    hrefs = ["/r", "s", "../t", "../../../u", "./", "..", "?z=2", "#top", "", "//b.org/v", "https://c.org", "mailto:x@y.z", "a/./b/../c?d=../e", " /trim "]
    got = {r.h: r.j for r in spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", fetch.joined_url(base, F.col("h")).alias("j")).collect()}
    assert got == {h: urljoin(base, h.strip()) for h in hrefs}


def test_calls_of_eight_tasks_to_a_host_are_a_gap_apart(spark):
    def make():
        return lambda url: (503, b"") if url.endswith("7") and not make_seen.setdefault(url, 0) and not make_seen.update({url: 1}) else (200, repr(time.time()).encode())

    make_seen: dict = {}
    wanted = spark.range(24).select(F.concat(F.lit("https://h"), F.col("id") % 2, F.lit(".org/"), F.col("id")).alias("url"))
    got = fetch.fetched(wanted, make, concurrency=8, per_second=20, max_seconds=60).collect()
    at = defaultdict(list)
    for r in got:
        assert r.error is None
        at[r.url.split("/")[2]].append(float(r.payload))
    for times in at.values():
        times.sort()
        assert len(times) == 12 and min(b - a for a, b in zip(times, times[1:])) > 0.03


def test_turns_never_share_a_slot():
    clock = [100.0]
    calls = []
    tasks = [fetch.Turns(i, 4, 0.5, sleep=lambda s: None, now=lambda: clock[0]) for i in range(4)]
    for t in tasks:
        t.sleep = lambda s: clock.__setitem__(0, clock[0] + s)
    for i in (2, 0, 3, 3, 1, 0, 2):
        tasks[i].wait("h")
        calls.append(round(clock[0] / 0.5))
    assert len(set(calls)) == len(calls)


def test_one_deadline_and_counts(spark):
    wanted = spark.range(6).select(F.concat(F.lit("u"), "id").alias("url"))
    late = fetch.fetched(wanted, lambda: lambda url: b"x", max_seconds=-1)
    assert fetch.fetch_counts(late).first().asDict() == {"attempted": 0, "succeeded": 0, "failed": 0, "left": 6}
    assert fetch.Polite(None, timeout=0.2).timeouts() == {"timeout": (1.0, 1.0)} and fetch.Polite(None, timeout=30).timeouts() == {"timeout": (5.0, 30)}


def test_json_strings_are_values_at_any_depth(spark):
    deep = "x"
    for _ in range(30):
        deep = [deep, {"k": "key/value"}]
    rows = [json.dumps(deep), '"bare"', '﻿{"a": "b\\u002fc", "https://k": 1}', "{broken", None, "[]", "7"]
    got = Counter(r.value for r in walk.json_strings(spark.createDataFrame([(r,) for r in rows], "raw string")).collect())
    assert got == Counter({"x": 1, "key/value": 30, "bare": 1, "b/c": 1})
