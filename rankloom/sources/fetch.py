"""Pages from a web of any kind: classified links, polite bounded fetches, payload caches, resume.

A fetcher is `fetch(url) -> bytes`, made inside the worker by a factory, so that tests
and offline runs read tables in place of a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import extract, urls
from rankloom.sources.walk import json_strings

# What is asked for again, and the limits of the polite client.
RETRIED = (429, 500, 502, 503, 504)
RETRIES, BACKOFF, PER_SECOND = 3, 0.5, 1.0
FETCHED = "url string, payload binary, error string"


def is_detail(url: Column, text: Column, host: str) -> Column:
    """Whether a link leads to one award: an internal path of that kind, or an anchor that names an award."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    other = path.rlike(r"\.(?:jpg|png|pdf|zip)$") | path.contains("browse-scholarships") | (path.startswith("/students/") & path.contains("scholarship"))
    named = F.lower(F.trim(F.coalesce(text, F.lit("")))).contains("scholarship") & (path != "") & (path != "/")
    return urls.is_internal(url, host) & ~other & (path.rlike("/scholarships?/") | named)


def link_kind(url: Column, text: Column, host: str) -> Column:
    """detail, category, or null for a link to neither."""
    return F.when(is_detail(url, text, host), "detail").when(urls.is_internal(url, host) & urls.is_category(url), "category")


def joined_url(base: Column | str, href: Column) -> Column:
    """href against the base: absolute, scheme-relative, rooted, a query or fragment alone, or relative, with `.` and `..` resolved."""
    base = F.lit(base) if isinstance(base, str) else base
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    path = F.substring(page, F.length(root) + 1, F.length(page))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    bare = F.trim(href)
    own = F.regexp_extract(bare, r"^([^?#]*)", 1)
    tail = F.substring(bare, F.length(own) + 1, F.length(bare))
    relative = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    return (
        F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare)
        .when(bare.startswith("//"), F.concat(scheme, F.lit(":"), bare))
        .when(bare == "", base)
        .when(bare.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), bare))
        .when(bare.startswith("?"), F.concat(page, bare))
        .otherwise(F.concat(root, _without_dots(relative), tail))
    )


def _without_dots(path: Column) -> Column:
    """A rooted path with its `.` and `..` parts taken out."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(0)))
    last = F.element_at(parts, -1)
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_ = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")  # a path that ends in dots names a folder
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), open_)).otherwise(path)


def listing_links(pages: DataFrame, base: str, host: str, html: str = "html") -> DataFrame:
    """(url, kind): the different detail, category and json links of listing pages."""
    links = pages.select(F.explode(extract.anchors(F.col(html))).alias("a")).select(urls.normalised(joined_url(base, F.col("a.href"))).alias("url"), F.col("a.text").alias("text"))
    links = links.where(urls.is_http(F.col("url")))
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(https?://[^\"'\s<>]+/wp-json/[^\"'\s<>]*)"), F.lit(1))
    json = pages.select(F.explode(found).alias("u")).select(urls.normalised(F.col("u")).alias("url"), F.lit("json").alias("kind"))
    return links.select("url", link_kind(F.col("url"), F.col("text"), host).alias("kind")).where("kind is not null").unionByName(json).distinct()


def json_detail_urls(payloads: DataFrame, host: str, raw: str = "raw") -> DataFrame:
    """(url): the different string values anywhere in JSON texts that look like detail URLs."""
    found = json_strings(payloads, raw).select(urls.normalised(F.col("value")).alias("url"))
    return found.where(is_detail(F.col("url"), F.lit(""), host)).distinct()


class Turns:
    """When a task may call a host: every `of` slots of the clock the one numbered `turn` is its own.

    Slots are `gap` long and all tasks count them from the same moment, so calls of
    different tasks to one host are a gap apart without a word between them.
    """

    def __init__(self, turn: int = 0, of: int = 1, gap: float = 1.0 / PER_SECOND, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time):
        self.turn, self.of, self.gap, self.sleep, self.now, self.last = turn, max(1, of), gap, sleep, now, {}

    def wait(self, host: str) -> None:
        """Returns at the beginning of the task's next slot for the host, never twice in one slot."""
        cycle = self.gap * self.of
        at = self.now()
        k = max(-(-(at - self.turn * self.gap) // cycle), self.last.get(host, -1) + 1)
        self.last[host] = k
        while (left := k * cycle + self.turn * self.gap - self.now()) > 0:
            self.sleep(left)


class Polite:
    """A client that waits for its turn before each call and retries with growing waits; `get` gives (status, body).

    Connecting may take the time given, within one and five seconds, reading at least as long.
    """

    def __init__(self, get: Callable[..., tuple[int, bytes]], per_second: float = PER_SECOND, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic, turns: Turns | None = None, timeout: float | None = None):
        self.get, self.gap, self.sleep, self.now, self.last, self.turns, self.timeout = get, 1.0 / per_second, sleep, now, None, turns, timeout

    def timeouts(self) -> dict:
        return {} if self.timeout is None else {"timeout": (connect := min(max(self.timeout, 1.0), 5.0), max(self.timeout, connect))}

    def __call__(self, url: str) -> bytes:
        for attempt in range(RETRIES + 1):
            if self.turns is not None:
                self.turns.wait(url.split("/")[2] if "://" in url else url)
            elif self.last is not None:
                self.sleep(max(0.0, self.last + self.gap - self.now()))
            self.last = self.now()
            status, body = self.get(url, **self.timeouts())
            if status < 400:
                return body
            if status not in RETRIED or attempt == RETRIES:
                raise OSError(f"status {status}")
            self.sleep(BACKOFF * 2**attempt)
        raise AssertionError


def fetched(
    wanted: DataFrame, make: Callable[[], Callable[[str], bytes]], concurrency: int = 4, most: int | None = 200, max_seconds: float = 600.0, per_second: float | None = None
) -> DataFrame:
    """(url, payload, error) of the wanted URLs, the first `most` in order; a URL that fails does not stop the others.

    The deadline is one moment for all tasks, set when this is called.  With `per_second`,
    `make` gives get(url) -> (status, body), and all tasks together keep that rate to every
    host, retries included: task i of n has every n-th slot of the clock.
    """
    import pandas as pd

    end, n_tasks = time.time() + max_seconds, concurrency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        fetch = make()
        if per_second:
            fetch = Polite(fetch, turns=Turns(TaskContext.get().partitionId() % n_tasks, n_tasks, 1.0 / per_second))
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows.append((url, fetch(url), None) if time.time() < end else (url, None, "max_runtime_seconds"))
                except Exception as e:  # the row says what failed
                    rows.append((url, None, f"detail_fetch_failed:{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["url", "payload", "error"])

    urls_ = wanted.select("url").distinct().orderBy("url")
    return (urls_.limit(most) if most else urls_).repartition(concurrency, "url").mapInPandas(run, FETCHED)


def fetch_counts(got: DataFrame) -> DataFrame:
    """One row: attempted, succeeded, failed, and left for want of time."""
    late = F.coalesce(F.col("error") == "max_runtime_seconds", F.lit(False))
    return got.agg(F.count_if(~late).alias("attempted"), F.count("payload").alias("succeeded"), F.count_if(F.col("error").isNotNull() & ~late).alias("failed"), F.count_if(late).alias("left"))


def with_cache(wanted: DataFrame, cache: DataFrame, day: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that the cache of the day has: url, payload; URLs that are left to fetch). The latest payload of a slug counts."""
    keyed = wanted.select("url").distinct().withColumn("slug", urls.cache_slug(F.col("url")))
    latest = cache.where(F.to_date("fetched_at") == day).groupBy("slug").agg(F.max_by("payload", "fetched_at").alias("payload"))
    both = keyed.join(latest, "slug", "left")
    return both.where("payload is not null").select("url", "payload"), both.where("payload is null").select("url")


def payload_slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(bare == "", "payload").otherwise(bare)


def cached(payloads: DataFrame, source: str, at: Column) -> DataFrame:
    """Rows of the payload cache: source, slug, stamp, fetched_at, payload; write them partitioned by source and day."""
    return payloads.where("payload is not null").select(F.lit(source).alias("source"), urls.cache_slug(F.col("url")).alias("slug"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), at.alias("fetched_at"), "payload")


def resumed(wanted: DataFrame, cache: DataFrame, day: Column, make: Callable, **limits) -> DataFrame:
    """(url, payload, error, from_cache): what the day's cache has is not fetched again."""
    have, left = with_cache(wanted, cache, day)
    new = fetched(left, make, **limits)
    return have.select("url", "payload", F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache")).unionByName(new.withColumn("from_cache", F.lit(False)))
