"""Commands: check-domain, check-urls, clean, crawl, crawl-folder, parse, preprocess, validate."""

from __future__ import annotations

import argparse
import datetime
import gzip
import http.client
import os
import shutil
import urllib.error
import urllib.request
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import html
from weftline.functions.urls import whatwg_url
from weftline.operators import archive, crawl, lens, parse, validate
from weftline.session import builder, cut, prepare
from weftline.sources import parsed, warc, web


class _Slow(http.client.HTTPConnection):
    """A connection that is refused early and read patiently."""

    def connect(self) -> None:
        self.timeout = web.CONNECT_SECONDS
        super().connect()
        self.sock.settimeout(web.TOTAL_SECONDS)


class _SlowTls(_Slow, http.client.HTTPSConnection):
    pass


class _Opened(urllib.request.HTTPHandler):
    def http_open(self, request):
        return self.do_open(_Slow, request)


class _OpenedTls(urllib.request.HTTPSHandler):
    def https_open(self, request):
        return self.do_open(_SlowTls, request)


def fetch(url: str) -> web.Response:
    """The network transport: gzip on the way, ``CONNECT_SECONDS`` to connect, ``TOTAL_SECONDS`` to read."""
    request = urllib.request.Request(url, headers={"User-Agent": "weftline/0.1", "Accept-Encoding": "gzip"})

    def answer(r, status: int, url: str) -> web.Response:
        body = r.read()
        if r.headers.get("Content-Encoding", "").lower() == "gzip":
            try:
                body = gzip.decompress(body)
            except (OSError, EOFError, zlib.error) as e:
                raise OSError(f"damaged answer from {url}") from e
        return web.Response(status, url, list(r.headers.items()), body)

    try:
        with urllib.request.build_opener(_Opened, _OpenedTls).open(request, timeout=web.TOTAL_SECONDS) as r:
            return answer(r, r.status, r.url)
    except urllib.error.HTTPError as e:
        return answer(e, e.code, url)
    except http.client.HTTPException as e:
        raise OSError(str(e)) from e


class Session:
    """A lens, the folders of its archive, and a transport."""

    def __init__(self, spark: SparkSession, rules: lens.Lens, root: str = ".", transport: web.Transport = fetch) -> None:
        self.spark, self.lens, self.transport = prepare(spark), rules, transport
        self.storage, self.spool = f"{root}/archives/{rules.name}", f"{root}/tmp/{rules.name}"

    def url_list(self) -> str:
        return f"{self.storage}/urls.txt"

    def _fetched(self, urls: DataFrame, name: str) -> DataFrame:
        """name (the URL asked for), status and text of payloads, fetched once and kept."""
        got = crawl.fetch_payloads(urls.select(F.col(name).alias("url")), self.transport, as_of=str(datetime.date.today()), origin_first=True)
        packed = F.when(F.col("url").endswith(".gz"), F.col("url")).otherwise(F.col("requested"))
        return got.select(F.col("requested").alias(name), "status", web.payload_text(packed, "body").alias("text"))

    def sites(self, domains: list[str]) -> DataFrame:
        """Site infos of domains. What was found, or not found, for a domain is kept until ``clean``, so no
        site is asked twice."""
        rows = self.spark.createDataFrame([(d,) for d in domains], "domain string").distinct()
        path = f"{self.spool}-sites"
        new = rows.join(self.spark.read.parquet(path), "domain", "left_anti") if os.path.exists(path) else rows
        origins = new.select(F.when(F.col("domain").startswith("http"), F.regexp_extract("domain", "^https?://[^/?#]+", 0)).otherwise(F.concat(F.lit("http://"), "domain")).alias("o"))
        wanted = origins.select(F.explode(F.array(F.concat("o", F.lit("/")), F.concat("o", F.lit("/robots.txt")), F.concat("o", F.lit("/sitemap.xml")))).alias("url")).distinct()
        cut(web.site_info(new, self._fetched(wanted, "url"))).write.mode("append").parquet(path)
        return self.spark.read.parquet(path).join(rows, "domain", "left_semi")

    def find_urls(self) -> DataFrame:
        info = self.sites([*self.lens.domains, *self.lens.prefixes()]).cache()
        seeds = info.select(F.explode("sitemaps").alias("sitemap"))
        mapped = web.expand_sitemaps(seeds, lambda f: self._fetched(f, "sitemap"), self.lens.allowed(), self.lens.skipped())
        feeds = info.select(F.explode("feeds").alias("f")).select("f.feed_type", F.col("f.url").alias("url"))
        items = web.feed_items(feeds.join(self._fetched(feeds.select("url"), "url"), "url").select("feed_type", "text"))
        none = self.spark.createDataFrame([], "url string")
        found = crawl.discovered(self.lens, mapped, items, none)
        bare = info.filter(F.size("sitemaps") == 0).select(F.col("domain").alias("prefix"))
        thin = lens.thin_prefixes(found, self.spark.createDataFrame([(p,) for p in self.lens.prefixes()], "prefix string")).select("prefix")
        year = (datetime.date.today() - datetime.timedelta(weeks=52)).year
        listed = web.index_urls(bare.unionByName(thin), self.transport, year)
        return crawl.discovered(self.lens, mapped, items, listed.select("url"))

    def crawl(self, origin_first: bool = False, per_second: int = 2) -> archive.ArchiveFiles:
        if os.path.exists(self.url_list()):
            urls = self.spark.read.text(self.url_list()).select(F.col("value").alias("url"))
        else:
            urls = self.find_urls()
            crawl.write_url_list(urls, self.url_list())
        done = self.cache() if os.path.exists(self.spool) else self.spark.createDataFrame([], crawl.RECORD)
        queue = crawl.still_to_fetch(urls, done.filter("error_kind is null"))
        got = crawl.fetch_all(queue, self.transport, as_of=str(datetime.date.today()), origin_first=origin_first, per_second=per_second)
        crawl.cache_rows(got).write.mode("append").parquet(self.spool)
        records = self.cache().filter("error_kind is null").select(*got.columns)
        return archive.create_archives(records.withColumn("seq", F.col("url")), self.storage)

    def cache(self) -> DataFrame:
        """What was fetched in any run, the last answer of each URL."""
        return crawl.cached(self.spark.read.parquet(self.spool))

    def validate(self) -> DataFrame:
        if not os.path.exists(self.url_list()):
            raise FileNotFoundError(f"{self.url_list()} is missing: run check-urls or crawl first")
        urls = self.spark.read.text(self.url_list()).select(F.col("value").alias("url"))
        return validate.report(urls, warc.to_archive_records(warc.read_warc(self.spark, archive_path(self.storage))))


def crawl_folder(spark: SparkSession, base_url: str, output: str, path: str) -> archive.ArchiveFiles:
    """Archive a folder of HTML files, whose names without ``.html`` follow the base URL."""
    rows = prepare(spark).read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.replace("name", F.lit(".html"), F.lit("")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    records = rows.select(F.lit(200).alias("status"), url.alias("url"), none.alias("headers"), "content").withColumn("seq", F.col("url"))
    files = archive.create_archives(records, output)
    listed = [r.url for r in records.select(whatwg_url("url").alias("url")).filter("url is not null").orderBy("url").collect()]
    with open(f"{output}/lens.ron", "w", encoding="utf-8") as f:
        f.write(lens.dump(lens.Lens(os.path.basename(output.rstrip("/")), urls=[f"{u}$" for u in listed])))
    return files


def archive_path(path: str) -> str:
    """The archive in a folder, unless the path names one already."""
    names = ("archive.warc.gz", "archive.warc")
    if os.path.basename(path.rstrip("/")) in names:
        return path
    return next((found for n in names if os.path.exists(found := os.path.join(path, n))), path)


def upload(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder to any store that Hadoop knows, such as an object store."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    a, b = fs.Path(source), fs.Path(target)
    fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def clean(root: str = ".") -> None:
    """Remove what crawls have kept below a root; archives stay."""
    shutil.rmtree(f"{root}/tmp", ignore_errors=True)


def main(argv: list[str] | None = None, *, spark: SparkSession | None = None, root: str = ".", transport: web.Transport = fetch) -> None:
    top = argparse.ArgumentParser(prog="weftline", description=__doc__)
    top.add_argument("-l", "--lens-file")
    top.add_argument("-s", "--s3-bucket", help="also copy archives below this URI")
    commands = top.add_subparsers(dest="command", required=True)
    for name, args in {"check-domain": ["domain"], "check-urls": [], "clean": [], "crawl": ["--origin-first"], "crawl-folder": ["base_url", "output", "folder"], "parse": ["html_file"], "preprocess": ["warc"], "validate": []}.items():
        command = commands.add_parser(name)
        for a in args:
            command.add_argument(a, **({"action": "store_true"} if a.startswith("-") else {}))
    given = top.parse_args(argv)
    if given.command == "parse":
        with open(given.html_file, encoding="utf-8") as f:
            print(html.extract("https://example.com", f.read()))
        return
    if given.command == "clean":
        clean(root)
        return
    spark = spark or builder().getOrCreate()
    if given.command == "preprocess":
        path = archive_path(given.warc)
        parsed.write_parsed(archive.preprocess(spark, path), os.path.join(os.path.dirname(path.rstrip("/")) or ".", "parsed.gz"))
    elif given.command == "crawl-folder":
        print(crawl_folder(spark, given.base_url, given.output, given.folder))
    elif given.command == "check-domain":
        Session(spark, lens.Lens("check"), root, transport).sites([given.domain]).show(truncate=False)
    else:
        if not given.lens_file:
            top.error("a lens file is needed")
        session = Session(spark, lens.read(given.lens_file, lambda u: transport(u).body.decode()), root, transport)
        if given.command == "check-urls":
            found = session.find_urls()
            crawl.write_url_list(found, session.url_list())
            for row in found.orderBy("url").toLocalIterator():
                print(row.url)
        elif given.command == "validate":
            session.validate().show()
        else:
            files = session.crawl(given.origin_first)
            if given.s3_bucket:
                for path in (files.warc, files.parsed):
                    upload(spark, path, f"{given.s3_bucket.rstrip('/')}/{session.lens.name}/{os.path.basename(path)}")


def register_sql(spark: SparkSession, views: dict[str, DataFrame] | None = None) -> None:
    """Make the functions and data sources known to SQL, and views of the given frames."""
    from weftline.functions import text as T
    from weftline.functions import urls as U

    prepare(spark)
    for name, f in {"whatwg_url": U.whatwg_url, "crawl_link": U.crawl_link, "content_hash": T.content_hash, "sitemap_links": web.sitemap_links, "feed_links": web.feed_links, "from_ron": parsed.from_ron}.items():
        spark.udf.register(name, f)
    for source in (warc.WarcSource, web.CdxSource):
        spark.dataSource.register(source)
    for name, frame in (views or {}).items():
        frame.createOrReplaceTempView(name)


__all__ = ["Session", "archive_path", "clean", "crawl_folder", "fetch", "main", "parse", "register_sql", "upload"]

if __name__ == "__main__":
    main()
