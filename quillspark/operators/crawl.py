"""Crawling as breadth-first levels over an injected fetch: frontier, robots rules, budget, deduplication."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.html import is_html, parse_html
from quillspark.functions.urls import canonical, canonical_url, host, url_host, url_origin
from quillspark.session import durable

AGENT = "quillspark"

#: frontier(url) -> (url, status, content_type, final_url, body, attempts): one row per URL it could ask for.
Fetch = Callable[[DataFrame], DataFrame]


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = AGENT) -> DataFrame:
    """Adds `verdict` to urls(url): allowed, disallowed or unavailable, by robots(origin, status, body).

    404 allows everything; any other failure, a missing row included, is unavailable and must not be fetched.
    """
    rows = urls.withColumn("origin", url_origin(F.col("url"))).join(robots.select("origin", "status", "body"), "origin", "left")

    @F.pandas_udf("string")
    def judge(url: pd.Series, status: pd.Series, body: pd.Series) -> pd.Series:
        rules: dict[str, RobotFileParser] = {}
        out = []
        for u, s, b in zip(url, status, body, strict=True):
            if s == 404:
                out.append("allowed")
            elif pd.isna(s) or not 200 <= s < 300:
                out.append("unavailable")
            else:
                text = b or ""
                if text not in rules:
                    rules[text] = RobotFileParser()
                    rules[text].parse(text.splitlines())
                out.append("allowed" if rules[text].can_fetch(agent, u) else "disallowed")
        return pd.Series(out)

    return rows.withColumn("verdict", judge("url", F.col("status").cast("int"), "body")).drop("origin", "status", "body")


def fetch_robots(origins: DataFrame, fetch: Fetch) -> DataFrame:
    """(origin, status, body): the robots.txt of origins(origin), asked for like any page; status null where nothing answered."""
    asked = origins.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url"))
    got = fetch(asked.select("url")).select("url", "status", F.make_valid_utf8(F.col("body").cast("string")).alias("body"))
    return asked.join(got, "url", "left").select("origin", "status", "body")


def retryable(status: Column, error: Column) -> Column:
    """Whether an attempt may be repeated: timeouts, 429 and 5xx; all else is final."""
    return F.coalesce(error == "timeout", F.lit(False)) | F.coalesce((status == 429) | status.between(500, 599), F.lit(False))


def paced_fetch(get: Callable[[str], dict], min_delay: float = 0.2, tries: int = 3, base: float = 0.5, cap: float = 8.0, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> Fetch:
    """A Fetch over a live `get(url) -> {status, content_type, final_url, body, retry_after (seconds), error}`.

    A host's URLs meet in one task, which waits `min_delay` between requests to it; different hosts are fetched side by side. Timeouts,
    429 and 5xx are tried again, up to `tries` in all, after a capped exponential delay that respects retry_after. `attempts` holds
    every try. `sleep` and `jitter` can be replaced in tests.
    """
    fields = "url string, status int, content_type string, final_url string, body binary, attempts array<struct<status:int,nbytes:bigint,elapsed:double,error:string,retry_after:double>>"

    def ask(url: str) -> dict:
        made = []
        for n in range(tries):
            began = time.monotonic()
            try:
                r = get(url)
            except TimeoutError:
                r = {"error": "timeout"}
            except Exception as e:
                r = {"error": type(e).__name__}
            body, status = r.get("body") or b"", r.get("status")
            made.append({"status": status, "nbytes": len(body), "elapsed": time.monotonic() - began, "error": r.get("error"), "retry_after": r.get("retry_after")})
            again = r.get("error") == "timeout" or status == 429 or (status is not None and 500 <= status < 600)
            if not again or n + 1 == tries:
                break
            sleep(max(min(cap, base * 2**n) + jitter(), r.get("retry_after") or 0.0))
        return {"url": url, "status": status, "content_type": r.get("content_type"), "final_url": r.get("final_url"), "body": body, "attempts": made}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: set[str] = set()
        for frame in frames:
            for url in frame["url"]:
                if host(url) in asked:
                    sleep(min_delay)
                asked.add(host(url))
                yield pd.DataFrame([ask(url)]).astype({"status": "Int32"})

    return lambda frontier: frontier.select("url").repartition(url_host(F.col("url"))).mapInPandas(run, fields)


def settle_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """(url, tries, status, ok): what a retry loop of up to `most` tries makes of attempts(url, attempt, status, error), attempt from 1."""
    order = W.partitionBy("url").orderBy("attempt")
    again = F.coalesce(F.min(retryable(F.col("status"), F.col("error")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(1))
    made = attempts.withColumn("made", again).filter((F.col("made") == 1) & (F.col("attempt") <= most))
    last = made.groupBy("url").agg(F.max("attempt").alias("tries"), F.max_by("status", "attempt").alias("status"))
    return last.withColumn("ok", F.coalesce(F.col("status").between(200, 299), F.lit(False)))


def crawl(spark: SparkSession, seeds: list[str], fetch: Fetch, robots: DataFrame | None = None, max_pages: int = 500, domains: list[str] | None = None, agent: str = AGENT) -> DataFrame:
    """(url, title, text, fetched_at) of the pages reached from the seeds.

    `robots` holds the answers of all origins; without it each origin's is fetched when a page of it is first due. The budget counts scheduled URLs, denied and failed ones included. Only the seeds' hosts (or `domains`) are followed. URLs are scheduled in
    the order of their parents and of the links on them, each canonical URL once; two URLs that redirect to one page give one page. The schedule is
    bounded by the budget; pages stay distributed.
    """
    start = [u for u in dict.fromkeys(canonical(s) for s in seeds) if u.startswith(("http://", "https://"))]
    allowed = sorted({d.lower() for d in domains} if domains else {host(u) for u in start} - {""})
    start = [u for u in start if host(u) in allowed][:max_pages]
    frontier = spark.createDataFrame([(i, u) for i, u in enumerate(start)], "place bigint, url string")
    seen, scheduled, found = frontier.select("url"), len(start), None
    known = robots
    while scheduled and not frontier.isEmpty():
        if robots is None:
            origins = frontier.select(url_origin(F.col("url")).alias("origin")).distinct()
            fresh = origins if known is None else origins.join(known, "origin", "left_anti")
            answers = durable(fetch_robots(fresh, fetch))
            known = answers if known is None else known.unionByName(answers)
        asked = robots_allowed(frontier, known, agent).filter("verdict = 'allowed'").drop("verdict")
        got = fetch(asked.select("url")).join(asked, "url").filter(F.col("status").between(200, 299))
        got = got.withColumn("final", canonical_url(F.coalesce("final_url", "url")))
        got = got.filter(url_host(F.col("final")).isin(allowed) & is_html(F.col("content_type"), F.col("body")))
        page = parse_html(F.col("final"), F.make_valid_utf8(F.col("body").cast("string")))
        level = got.withColumn("p", page).filter(F.trim("p.text") != "")
        level = durable(level.select("place", F.col("final").alias("url"), "p.title", "p.text", "p.links", F.current_timestamp().alias("fetched_at")))
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("url"))
        links = level.select("place", F.posexplode("links").alias("no", "url")).groupBy("url").agg(F.min(F.struct("place", "no")).alias("at"))
        new = links.filter(url_host(F.col("url")).isin(allowed)).join(seen, "url", "left_anti")
        new = new.orderBy("at").limit(max_pages - scheduled) if max_pages > scheduled else new.limit(0)
        # at most max_pages rows: numbering them in one task is bounded
        frontier = durable(new.select((F.row_number().over(W.orderBy("at")) + scheduled - 1).cast("bigint").alias("place"), "url"))
        scheduled += frontier.count()
        seen = seen.unionByName(frontier.select("url"))  # a union of tables already written
    if found is None:
        return spark.createDataFrame([], "url string, title string, text string, fetched_at timestamp")
    best = found.groupBy("url").agg(F.min_by(F.struct("title", "text", "fetched_at"), "place").alias("x"))
    return best.select("url", "x.title", "x.text", "x.fetched_at")


def crawl_counters(pages: DataFrame, attempts: DataFrame, seconds: float) -> DataFrame:
    """One row of live counters: pages, errors, pages_per_sec."""
    errors = attempts.agg(F.sum(F.when(F.col("status").between(200, 299), 0).otherwise(1)).alias("errors"))
    n = pages.agg(F.count(F.lit(1)).alias("pages"))
    return n.crossJoin(F.broadcast(errors)).withColumn("pages_per_sec", F.col("pages") / F.lit(float(seconds)))


def page_records(pages: DataFrame) -> DataFrame:
    """The crawl's output rows (id, url, title, text, fetched_at as ISO text), to be written as JSON lines."""
    iso = F.date_format(F.col("fetched_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return pages.select(F.col("url").alias("id"), "url", "title", "text", iso.alias("fetched_at"))
