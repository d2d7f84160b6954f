"""Crawling as a plan: what is still to fetch, when, from where, and the fetch itself."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import urls as U
from weftline.operators.lens import Lens, allow_deny
from weftline.session import cut, prepare
from weftline.sources.web import Response, backoff_delays, with_retries


def still_to_fetch(queue: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Distinct queued URLs that parse and are not yet fetched."""
    named = queue.select(U.whatwg_url(url).alias(url)).filter(F.col(url).isNotNull()).distinct()
    return named.join(done.select(url).distinct(), url, "left_anti")


def schedule(queue: DataFrame, per_second: int = 2, *, url: str = "url", by: str = "url") -> DataFrame:
    """host, slot and the whole second after the start at which each URL may be fetched.

    Positions within a host are counted in two steps, so that one host with a third of all URLs is not
    numbered in one task: by host and part (ranges of ``by``), and by the sizes of earlier parts.
    """
    rows = queue.withColumn("host", U.host(F.col(url))).withColumn("__part", F.substring(F.md5(F.col(by)), 1, 2))
    within = F.row_number().over(Window.partitionBy("host", "__part").orderBy(F.md5(F.col(by)), by))
    sizes = rows.groupBy("host", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("host").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("host", "__part", before.alias("__before"))
    slot = F.col("__before") + within - 1
    return rows.join(sizes, ["host", "__part"]).withColumn("slot", slot).withColumn("second", F.floor(F.col("slot") / per_second)).drop("__part", "__before")


def first_success(rows: DataFrame, origin_first: bool = False) -> DataFrame:
    """url, status and source of rows (url, origin_status, archive_status): the archive's copy, unless
    it failed, or the origin first."""

    def good(status: str) -> Column:
        return F.coalesce(F.col(status).between(200, 299), F.lit(False))

    one, two = ("origin", "archive") if origin_first else ("archive", "origin")
    source = F.when(good(f"{one}_status"), one).when(good(f"{two}_status"), two)
    status = F.when(source == one, F.col(f"{one}_status")).otherwise(F.col(f"{two}_status"))
    return rows.select("url", source.alias("source"), status.alias("status"))


LOG = logging.getLogger(__name__)
#: Fetched URLs of a task between two log lines.
REPORT_EVERY = 100
RECORD = "url string, status int, headers array<struct<name:string,value:string>>, content string, error_kind string"
PAYLOAD = "requested string, url string, status int, body binary, error_kind string"


def fetch_all(queue: DataFrame, transport: Callable[[str], Response], *, as_of: str, origin_first: bool = False, per_second: int = 2, sleep=None, clock=None) -> DataFrame:
    """Fetch URLs host by host and politely, and keep the results: they are written to the shared
    folder at once, since fetching again would be a side effect. Errors are rows.

    All URLs of a host are one task's: that is what the host's limit asks for. A task takes its hosts by
    turns and waits only where the next URL's host was asked less than a turn ago.
    """
    schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("content", pa.string()), ("error_kind", pa.string())])

    def record(row: dict) -> dict:
        body = row.pop("body")
        return row | {"content": None if body is None else body.decode("utf-8", "replace")}

    return _fetch_each(queue, transport, record, RECORD, schema, as_of, origin_first, per_second, sleep, clock)


def fetch_payloads(queue: DataFrame, transport: Callable[[str], Response], *, as_of: str, origin_first: bool = False, per_second: int = 2, sleep=None, clock=None) -> DataFrame:
    """Like ``fetch_all``, with the URL asked for beside the one that redirects led to, and with the
    bytes as they came, which may be packed."""
    schema = pa.schema([("requested", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("error_kind", pa.string())])
    return _fetch_each(queue, transport, lambda row: row, PAYLOAD, schema, as_of, origin_first, per_second, sleep, clock)


def by_turns(hosts: list[str | None]) -> list[int]:
    """Places in an order that takes one of each host, then the next of each, and so on."""
    seen: dict[str | None, int] = {}
    turns = []
    for host in hosts:
        turns.append(seen.setdefault(host, 0))
        seen[host] += 1
    return sorted(range(len(hosts)), key=turns.__getitem__)


def _fetch_each(queue: DataFrame, transport, shape: Callable[[dict], dict], columns: str, schema: pa.Schema, as_of: str, origin_first: bool, per_second: int, sleep, clock) -> DataFrame:
    import time

    prepare(queue.sparkSession)
    rows = queue.withColumn("host", U.host(F.col("url"))).withColumn("copy", U.archive_copy(F.col("url"), F.to_date(F.lit(as_of))))
    pause = time.sleep if sleep is None else sleep
    now = time.monotonic if clock is None else clock

    def work(batches):
        free: dict[str | None, float] = {}  # when a host may be asked again
        done = 0
        for batch in batches:
            out = []
            hosts, urls, copies = (batch[k].to_pylist() for k in ("host", "url", "copy"))
            began = now()
            free = {h: t for h, t in free.items() if t > began}
            for i in by_turns(hosts):
                if (wait := free.get(hosts[i], 0) - now()) > 0:
                    pause(wait)
                free[hosts[i]] = now() + 1 / per_second
                out.append(shape(_fetch(urls[i], [urls[i], copies[i]] if origin_first else [copies[i], urls[i]], transport, pause)))
                done += 1
                if done % REPORT_EVERY == 0:
                    LOG.info("%d URLs fetched", done)
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return cut(rows.repartition("host").select("host", "url", "copy").mapInArrow(work, columns))


def cache_rows(records: DataFrame) -> DataFrame:
    """Rows for the crawl cache: with ``key``, the 64-bit hash of their URL, and ``fetched_at``."""
    return records.withColumn("key", F.xxhash64("url")).withColumn("fetched_at", F.current_timestamp())


def cached(rows: DataFrame, *, by: str = "fetched_at") -> DataFrame:
    """The crawl cache as it is read: of each URL the row that was written last, and of rows of one time
    the first by content. Appending a row thus replaces its URL's; inputs are never deleted."""
    others = [c for c in rows.columns if c not in ("key", by, "url")]
    order = F.struct(F.col(by), -F.xxhash64(*others) if others else F.lit(0))
    return rows.groupBy("key", "url").agg(F.max_by(F.struct(by, *others), order).alias("__row")).select("key", "url", "__row.*")


def _fetch(url: str, sources: list[str], transport, pause) -> dict:
    status, kind = None, "request_error"
    for source in sources:
        try:
            found = with_retries(transport, source, backoff_delays(), sleep=pause)
        except OSError:
            status, kind = None, "request_error"
            continue
        status = found.status
        kind = "too_many_requests" if status == 429 else "http_error" if status >= 400 else None
        if kind is None:
            shown = url if source != url else found.url
            headers = [{"name": k, "value": v} for k, v in found.headers if isinstance(v, str)]
            return {"requested": url, "url": shown, "status": status, "headers": headers, "body": found.body, "error_kind": None}
    return {"requested": url, "url": url, "status": status, "headers": None, "body": None, "error_kind": kind}


def discovered(lens: Lens, sitemap_urls: DataFrame, feed_urls: DataFrame, index_urls: DataFrame, *, filter_feeds: bool = False) -> DataFrame:
    """Distinct URLs of a lens: seeds, feed items (not filtered unless asked), allowed sitemap and
    index URLs; normalised, sanitised, without fragments."""
    spark = sitemap_urls.sparkSession
    allowed, skipped = lens.allowed(), lens.skipped()
    rule = allow_deny(F.col("url"), allowed, skipped)
    seeds = spark.createDataFrame([(u,) for u in lens.seeds()], "url string")
    feeds = feed_urls.select("url").filter(rule) if filter_feeds else feed_urls.select("url")
    every = seeds.unionByName(feeds).unionByName(sitemap_urls.select("url").filter(rule)).unionByName(index_urls.select("url").filter(rule))
    whole = U.defragment(U.whatwg_url("url"))
    return every.select(U.sanitise(whole, lens.sanitise).alias("url")).filter("url is not null").distinct()


def write_url_list(found: DataFrame, path: str) -> None:
    """Sorted URLs, one a line, in files that follow each other by name."""
    found.select("url").distinct().orderBy("url").write.mode("overwrite").text(path)
