"""Crawls of a site in rounds: listings, the JSON that they name, details, records.

Every round is one job over one level of the frontier: its pages are fetched, their links
classified, what was queued before taken out by an anti join, and the next level written.
The plan of a round reads two tables and does not depend on the depth.

Fetching is a function from a table of URLs to (url, payload, error): `fetch.fetched` with
a client in the workers, or a join with a table of pages.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions import extract, urls
from rankloom.operators.numbering import numbered
from rankloom.sources import records
from rankloom.sources.fetch import is_detail, joined_url, link_kind
from rankloom.sources.walk import json_strings
from rankloom.store import written

Fetch = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Site:
    """Where a crawl begins and what it may take; None sets no cap."""

    root: str
    host: str
    listing_pages: int | None = 3
    detail_pages: int | None = 200
    seconds: float | None = 600.0
    page_query: str = "_paged"
    kind: Callable[[Column, Column, str], Column] = link_kind
    now: Callable[[], float] = time.monotonic


@dataclass
class Crawl:
    """What a crawl came to."""

    listings: DataFrame  # place, depth, url, payload, error
    links: DataFrame  # url, kind
    details: DataFrame | None = None  # url, payload, error
    records: DataFrame | None = None
    failures: DataFrame | None = None  # url, reason
    caps: list[str] = field(default_factory=list)

    def stats(self) -> dict:
        """Counts of what was found, tried and lost, and the caps that were reached."""
        count = lambda df, where="true": df.where(where).count() if df is not None else 0
        return {
            "listing_urls_processed": count(self.listings, "error is null"),
            "detail_urls_discovered": count(self.links, "kind = 'detail'"),
            "detail_urls_attempted": count(self.details),
            "detail_urls_succeeded": count(self.records),
            "parse_failures": count(self.failures),
            "caps_reached": list(self.caps),
        }


def page_links(pages: DataFrame, site: Site) -> DataFrame:
    """(place, url, kind) of pages (place, url, payload): links against their own page, JSON addresses anywhere in it."""
    html = F.col("payload").cast("string")
    anchors = pages.select("place", F.col("url").alias("_base"), F.explode(extract.anchors(html)).alias("a"))
    links = anchors.select("place", urls.normalised(joined_url(F.col("_base"), F.col("a.href"))).alias("url"), F.col("a.text").alias("text"))
    links = links.where(urls.is_http(F.col("url"))).select("place", "url", site.kind(F.col("url"), F.col("text"), site.host).alias("kind")).where("kind is not null")
    found = F.regexp_extract_all(html, F.lit(r"(?i)(https?://[^\"'\s<>]+/wp-json/[^\"'\s<>]*)"), F.lit(1))
    json = pages.select("place", F.explode(found).alias("u")).select("place", urls.normalised(F.col("u")).alias("url"), F.lit("json").alias("kind"))
    return links.unionByName(json)


def _more_pages(pages: DataFrame, site: Site) -> DataFrame:
    """(place, number, url): the pages 2 to N that the root's embedded pager tells of."""
    root = pages.where("depth = 0").select("place", extract.total_pages(F.col("payload").cast("string")).alias("n")).where("n > 1")
    each = root.select("place", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("number"))
    sign = "&" if "?" in site.root else "?"
    return each.select("place", "number", urls.normalised(F.concat(F.lit(f"{site.root}{sign}{site.page_query}="), F.col("number").cast("string"))).alias("url"))


def listings(spark: SparkSession, site: Site, fetch: Fetch) -> Crawl:
    """Breadth first from the root: pager pages first, then each page's category links by URL, as a queue would take them.

    Pages that fail take no part of the cap.
    """
    began, caps = site.now(), []
    frontier = spark.range(1).select(F.lit(0).cast("long").alias("place"), urls.normalised(F.lit(site.root)).alias("url"))
    queued = written(frontier.select("url"), "queued")
    seen, links, failed, taken, depth = [], [], [], 0, 0
    while True:
        if site.seconds is not None and site.now() - began >= site.seconds:
            caps.append("max_runtime_seconds")
            break
        left = None if site.listing_pages is None else site.listing_pages - taken
        if left is not None and left <= 0:
            caps.append("max_listing_pages")
            break
        some = frontier if left is None else frontier.orderBy("place").limit(left)
        got = written(some.join(fetch(some.select("url")), "url", "left").select("place", F.lit(depth).alias("depth"), "url", "payload", F.when(F.col("payload").isNull(), F.coalesce("error", F.lit("missing"))).alias("error")), "listing")
        seen.append(got)
        fine = got.where("error is null")
        taken += fine.count()
        failed.append(got.where("error is not null").select("url", F.concat(F.lit("listing_fetch_failed:"), F.regexp_replace("error", "^.*:", "")).alias("reason")))
        own = written(page_links(fine, site), "links")
        links.append(own.select("url", "kind"))
        rest = frontier.join(some.select("url"), "url", "left_anti") if left is not None else None
        next_ = own.where("kind = 'category'").select("place", F.lit(1).alias("turn"), F.lit(0).alias("number"), "url")
        if depth == 0:
            next_ = next_.unionByName(_more_pages(fine, site).select("place", F.lit(0).alias("turn"), "number", "url"))
        first = next_.groupBy("url").agg(F.min(F.struct("place", "turn", "number", "url")).alias("at")).join(queued, "url", "left_anti")
        # Of this level only what the cap left over comes before the next one.
        found = first.select("url", F.lit(1).alias("level"), F.col("at.place").alias("p"), F.col("at.turn").alias("t"), F.col("at.number").alias("n"))
        if rest is not None:
            found = found.unionByName(rest.select("url", F.lit(0).alias("level"), F.col("place").alias("p"), F.lit(0).alias("t"), F.lit(0).alias("n")))
        frontier = written(numbered(found, "place", F.col("level"), F.col("p"), F.col("t"), F.col("n"), F.col("url")).select("place", "url"), "frontier")
        depth += 1
        if not frontier.limit(1).count():
            break
        queued = written(queued.unionByName(frontier.select("url")).distinct(), "queued")
    pages = _all(spark, seen, "place long, depth int, url string, payload binary, error string")
    return Crawl(pages, written(_all(spark, links, "url string, kind string").distinct(), "links"), failures=_all(spark, failed, "url string, reason string"), caps=caps)


def _all(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def crawl(spark: SparkSession, site: Site, fetch: Fetch, fetch_details: Fetch | None = None, **parsing) -> Crawl:
    """Listings, then the JSON they name, then details (by URL, up to the cap), then records by (source_url, item_id).

    A page that fails or is no detail page becomes a failure with its reason and stops nothing.
    """
    began = site.now()
    out = listings(spark, site, fetch)
    late = lambda: site.seconds is not None and site.now() - began >= site.seconds
    json = out.links.where("kind = 'json'").select("url")
    if json.limit(1).count():
        if late():
            out.caps.append("max_runtime_seconds")
        else:
            got = written(fetch(json), "json")
            out.failures = out.failures.unionByName(got.where("payload is null").select("url", F.concat(F.lit("json_fetch_failed:"), F.regexp_replace(F.coalesce("error", F.lit("missing")), "^.*:", "")).alias("reason")))
            told = json_strings(got.where("payload is not null").select(F.col("payload").alias("raw"))).select(urls.normalised(F.col("value")).alias("url"))
            told = told.where(site.kind(F.col("url"), F.lit(""), site.host) == "detail").select("url", F.lit("detail").alias("kind"))
            out.links = written(out.links.unionByName(told).distinct(), "links")
    wanted = out.links.where("kind = 'detail'").select("url").where(site.kind(F.col("url"), F.lit(""), site.host) == "detail")
    if site.detail_pages is not None and wanted.count() > site.detail_pages:
        out.caps.append("max_detail_pages")
        wanted = wanted.orderBy("url").limit(site.detail_pages)
    if late():
        out.caps.append("max_runtime_seconds")
        wanted = wanted.limit(0)
    out.details = written((fetch_details or fetch)(wanted), "details")
    html = out.details.where("payload is not null").select("url", F.col("payload").cast("string").alias("html"))
    parsed = written(records.detail_pages(html, **parsing), "records")
    lost = out.details.where("payload is null").select("url", F.coalesce("error", F.lit("detail_fetch_failed:missing")).alias("reason"))
    odd = html.select("url").join(parsed.select(F.col("source_url").alias("url")), "url", "left_anti").select("url", F.lit("invalid_or_non_scholarship_page").alias("reason"))
    out.failures = out.failures.unionByName(lost).unionByName(odd)
    out.records = parsed.orderBy("source_url", "item_id")
    out.caps = list(dict.fromkeys(out.caps))
    return out
