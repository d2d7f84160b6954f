"""Sitemaps, feeds, robots.txt and archive indexes, from fetched payloads.

All network access goes through a transport, ``fetch(url) -> Response``, so everything here runs on
recorded or synthetic payloads. XML with a document type is refused (no entities are ever expanded), and
damaged XML gives what was read before the damage.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from weftline.functions.text import gunzip_text
from weftline.operators.lens import allow_deny
from weftline.session import cut

#: Fixed values.
CONNECT_SECONDS, TOTAL_SECONDS = 1, 10
CDX_PAGE = 1000
RETRY_AFTER_MS = 5000


@dataclass
class Response:
    status: int
    url: str
    headers: list[tuple[str, str]] = field(default_factory=list)
    body: bytes = b""


Transport = Callable[[str], Response]


def _leaves(text: str | None, wanted: dict[tuple[str, str], int], size: int) -> tuple[list[str], ...]:
    """Texts of elements by (parent, name), names without namespace."""
    found: tuple[list[str], ...] = tuple([] for _ in range(size))
    if not text:
        return found
    parser = expat.ParserCreate()
    stack: list[str] = []
    held: list[str] = []

    def start(name: str, attrs: dict) -> None:
        stack.append(name.rpartition(":")[2])
        held.clear()

    def end(name: str) -> None:
        key = (stack[-2] if len(stack) > 1 else "", stack[-1])
        if key in wanted and (value := "".join(held).strip()):
            found[wanted[key]].append(value)
        stack.pop()
        held.clear()

    def refuse(*_: object) -> None:
        raise ValueError("document types are refused")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = start, end, held.append, refuse
    try:
        parser.Parse(text.lstrip("﻿"), True)
    except (expat.ExpatError, ValueError):
        pass
    return found


_SITEMAP = StructType([StructField("urls", ArrayType(StringType())), StructField("sitemaps", ArrayType(StringType()))])


@F.pandas_udf(_SITEMAP)
def sitemap_links(text: pd.Series) -> pd.DataFrame:
    """Page URLs and nested sitemaps of a sitemap or a sitemap index."""
    return pd.DataFrame([_leaves(t, {("url", "loc"): 0, ("sitemap", "loc"): 1}, 2) for t in text], columns=["urls", "sitemaps"])


@F.pandas_udf(ArrayType(StringType()))
def feed_links(text: pd.Series) -> pd.Series:
    """Links of the items of an RSS channel; any other document has none."""
    return pd.Series([_leaves(t, {("item", "link"): 0}, 1)[0] if t and "<rss" in t or t and "<rdf" in t.lower() else [] for t in text], dtype=object)


@F.pandas_udf(StringType())
def payload_text(url: pd.Series, body: pd.Series) -> pd.Series:
    """Text of a fetched payload: unpacked where the URL ends in .gz, else without byte order marks."""

    def one(u: str, b: bytes) -> str | None:
        if b is None:
            return None
        if u.endswith(".gz"):
            return gunzip_text(bytes(b))
        return bytes(b).decode("utf-8", "replace").replace("﻿", "")

    return pd.Series([one(u, b) for u, b in zip(url, body, strict=True)], dtype=object)


def robots_sitemaps(body: Column) -> Column:
    """Sitemaps that a robots.txt names."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda line: line.rlike(r"(?i)^\s*sitemap\s*:"))
    return F.transform(lines, lambda line: F.trim(F.regexp_replace(line, r"(?i)^\s*sitemap\s*:", "")))


def robots_rules(body: Column, agent: str = "*") -> Column:
    """allow and disallow lines of the groups for an agent, in order, as (rule, path)."""
    groups = F.split(F.regexp_replace(body, r"\r", ""), r"(?im)(?=^\s*user-agent\s*:)")
    own = F.filter(groups, lambda g: F.lower(F.trim(F.regexp_extract(g, r"(?i)^\s*user-agent\s*:([^#\n]*)", 1))) == agent.lower())
    lines = F.filter(F.flatten(F.transform(own, lambda g: F.split(g, "\n"))), lambda line: line.rlike(r"(?i)^\s*(allow|disallow)\s*:"))
    return F.transform(lines, lambda line: F.struct(F.lower(F.regexp_extract(line, r"(?i)^\s*(allow|disallow)", 1)).alias("rule"), F.trim(F.regexp_extract(line, r":([^#]*)", 1)).alias("path")))


def expand_sitemaps(seeds: DataFrame, fetched: Callable[[DataFrame], DataFrame], allowed: list[str], skipped: list[str]) -> DataFrame:
    """URLs of sitemaps and of all that they nest, allowed ones only.

    seeds: sitemap. fetched: gives sitemap and text for a frame of sitemaps. Each round reads only
    sitemaps that no round read before, so cycles end, and goes on until none is left.
    """
    frontier = cut(seeds.select("sitemap").distinct())
    visited = frontier
    found = None
    while True:
        read = cut(fetched(frontier).select("sitemap", sitemap_links("text").alias("links")))
        urls = read.select(F.explode("links.urls").alias("url")).filter(allow_deny(F.col("url"), allowed, skipped))
        found = urls if found is None else found.unionByName(urls)
        frontier = cut(read.select(F.explode("links.sitemaps").alias("sitemap")).distinct().join(visited, "sitemap", "left_anti"))
        if frontier.isEmpty():
            return found.distinct()
        visited = cut(visited.unionByName(frontier))


def feed_items(feeds: DataFrame) -> DataFrame:
    """Item links of feeds (feed_type, text) of the types Atom and RSS; they are not filtered by rules."""
    return feeds.filter(F.col("feed_type").isin("Atom", "Rss")).select(F.explode(feed_links("text")).alias("url"))


def site_info(domains: DataFrame, pages: DataFrame) -> DataFrame:
    """origin, domain, feeds, robots_txt and sitemaps of domains, from fetched pages (url, status,
    text). Where robots.txt names no sitemap, ``sitemap.xml`` at the origin is tried."""
    base = domains.select("domain", F.when(F.col("domain").startswith("http"), F.col("domain")).otherwise(F.concat(F.lit("http://"), "domain")).alias("at"))
    base = base.withColumn("origin", F.concat(F.regexp_extract("at", "^https?://[^/?#]+", 0), F.lit("/"))).distinct()
    good = pages.filter(F.col("status").between(200, 299))

    def text_at(suffix: str, name: str) -> DataFrame:
        return good.filter(F.col("url").endswith(suffix)).select(F.substring("url", F.lit(1), F.length("url") - len(suffix)).alias("origin"), F.col("text").alias(name))

    robots, probe = text_at("robots.txt", "robots_txt"), text_at("sitemap.xml", "probe")
    front = good.select(F.col("url").alias("origin"), F.col("text").alias("front"))
    rows = base.join(robots, "origin", "left").join(probe, "origin", "left").join(front, "origin", "left")
    named = F.coalesce(robots_sitemaps(F.col("robots_txt")), F.array().cast("array<string>"))
    tried = F.when(F.col("probe").isNotNull(), F.array(F.concat("origin", F.lit("sitemap.xml")))).otherwise(F.array().cast("array<string>"))
    links = F.regexp_extract_all(F.coalesce("front", F.lit("")), F.lit(r"(?is)<link\b[^>]*\btype=[\"']application/(?:rss|atom)\+xml[\"'][^>]*>"), F.lit(0))

    def attribute(tag: Column, name: str) -> Column:
        return F.regexp_extract(tag, rf"(?is)\b{name}=[\"']([^\"']*)[\"']", 1)

    feeds = F.transform(links, lambda t: F.struct(attribute(t, "title").alias("title"), F.when(t.rlike("(?i)atom\\+xml"), "Atom").otherwise("Rss").alias("feed_type"), attribute(t, "href").alias("url")))
    return rows.select("origin", "domain", feeds.alias("feeds"), "robots_txt", F.when(F.size(named) > 0, named).otherwise(tried).alias("sitemaps"))


# archive index (CDX)


def cdx_query(prefix: str, year: int, limit: int = CDX_PAGE, resume_key: str | None = None) -> list[tuple[str, str]]:
    """Parameters of an index query; filters, deduplication and limits are pushed to the index."""
    query = [("matchType", "prefix"), ("filter", "statuscode:200"), ("filter", "mimetype:text/html"), ("collapse", "urlkey"), ("showResumeKey", "true"), ("fl", "original"), ("limit", str(limit)), ("from", str(year)), ("url", prefix)]
    return query + ([("resumeKey", resume_key)] if resume_key else [])


def cdx_page(text: str, limit: int = CDX_PAGE) -> tuple[list[str], str | None]:
    """URLs of a page and the key of the next: what follows the first ``limit`` non-blank lines."""
    lines = [line for line in text.split("\n") if line.strip()]
    return lines[:limit], lines[-1] if len(lines) > limit else None


def index_urls(prefixes: DataFrame, transport: Transport, year: int, *, sleep=time.sleep) -> DataFrame:
    """prefix and url of what the archive index has below each prefix since a year, page by page. A prefix is
    one task's, since a page names the next; what was read before an error stays. The rows are kept in
    the shared folder at once, since asking again would be a side effect."""
    from urllib.parse import urlencode

    def work(batches):
        for batch in batches:
            for prefix in batch.column(0).to_pylist():
                key = None
                while True:
                    query = "https://web.archive.org/cdx/search/cdx?" + urlencode(cdx_query(prefix, year, resume_key=key))
                    try:
                        got = with_retries(transport, query, backoff_delays(1000, 3, None), sleep=sleep)
                    except OSError:
                        break
                    if got.status >= 400:
                        break
                    urls, key = cdx_page(got.body.decode("utf-8", "replace"))
                    yield pa.RecordBatch.from_pydict({"prefix": pa.array([prefix] * len(urls), pa.string()), "url": pa.array(urls, pa.string())})
                    if key is None:
                        break

    wanted = prefixes.select("prefix").distinct()
    return cut(wanted.repartition("prefix").mapInArrow(work, "prefix string, url string"))


def cdx_lines(response: Column, limit: int = CDX_PAGE) -> Column:
    """The same as built-in functions: struct of urls and resume_key."""
    lines = F.filter(F.split(response, "\n"), lambda line: F.trim(line) != "")
    return F.struct(F.slice(lines, 1, limit).alias("urls"), F.when(F.size(lines) > limit, F.element_at(lines, -1)).alias("resume_key"))


class _Prefix(InputPartition):
    def __init__(self, prefix: str) -> None:
        self.prefix = prefix


class CdxReader(DataSourceReader):
    """A partition a prefix; pages follow each other by resume key and end at the first error."""

    def __init__(self, prefixes: list[str], folder: str, limit: int) -> None:
        self.prefixes, self.folder, self.limit = prefixes, folder, limit

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("prefix",):
                self.prefixes = [p for p in self.prefixes if p == f.value]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Prefix(p) for p in self.prefixes] or [_Prefix("")]

    def read(self, partition: _Prefix) -> Iterator[tuple]:
        from urllib.parse import quote

        key, number = None, 0
        while partition.prefix:
            try:
                with open(f"{self.folder}/{quote(partition.prefix, safe='')}.{number}", encoding="utf-8") as f:
                    urls, key = cdx_page(f.read(), self.limit)
            except OSError:
                return
            yield from ((partition.prefix, u) for u in urls)
            number += 1
            if key is None:
                return


class CdxSource(DataSource):
    """``format("cdx")`` over recorded pages: option path (a folder), prefixes (one a line), limit."""

    @classmethod
    def name(cls) -> str:
        return "cdx"

    def schema(self) -> str:
        return "prefix string, url string"

    def reader(self, schema) -> DataSourceReader:
        return CdxReader([p for p in self.options.get("prefixes", "").split("\n") if p], self.options["path"], int(self.options.get("limit", CDX_PAGE)))


# retries


def backoff_delays(base_ms: int = 100, retries: int = 3, most_ms: int | None = 5000) -> list[int]:
    """Delays before the retries: powers of the base, capped."""
    return [base_ms**i if most_ms is None else min(base_ms**i, most_ms) for i in range(1, retries + 1)]


def wait_asked_ms(response: Response, unit: str = "seconds") -> int:
    """What a server that answers 429 asks to wait, as ``retry_delay_ms`` reads it; 0 for other answers."""
    if response.status != 429:
        return 0
    asked = next((v.strip() for k, v in response.headers if k.lower() == "retry-after" and isinstance(v, str)), "")
    return int(asked) * (1000 if unit == "seconds" else 1) if re.fullmatch(r"[0-9]{1,12}", asked) else RETRY_AFTER_MS


def with_retries(fetch: Transport, url: str, delays: list[int], retryable=None, sleep=time.sleep, unit: str = "seconds") -> Response:
    """The first answer that is not to be retried, or the last one. Before the next try, what a 429
    asks to wait passes first, and then the delay."""
    retryable = retryable or (lambda r: r.status not in (403, 404) and r.status >= 400)
    for delay in [*delays, None]:
        asked = 0
        try:
            response = fetch(url)
            asked = wait_asked_ms(response, unit)
            if not retryable(response) or delay is None:
                return response
        except OSError:
            if delay is None:
                raise
        sleep((asked + delay) / 1000)
    raise AssertionError


def outcome(status: Column) -> Column:
    return F.when(status.isNull(), "request_error").when(status == 429, "too_many_requests").when(status >= 400, "http_error").otherwise("ok")


def retryable(status: Column) -> Column:
    """HTTP errors but 403 and 404, and requests that got no status."""
    return F.when(status.isNull(), True).otherwise((status >= 400) & ~status.isin(403, 404))


def retry_delay_ms(retry_after: Column, unit: str = "seconds") -> Column:
    factor = 1000 if unit == "seconds" else 1
    value = F.when(retry_after.rlike(r"^\s*\d+\s*$"), F.try_to_number(F.trim(retry_after), F.lit("999999999999")).cast("bigint") * factor)
    return F.coalesce(value, F.lit(RETRY_AFTER_MS).cast("bigint"))
