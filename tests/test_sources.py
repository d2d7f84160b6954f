import gzip
import io
import tracemalloc
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import archive, crawl, dedupe, lens, parse, validate
from weftline.sources import parsed, ron, warc, web

values = st.recursive(st.none() | st.booleans() | st.integers(-(10**9), 10**9) | st.text(max_size=12), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(max_size=5), v, max_size=3).map(ron.Map), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(values)
def test_ron_round_trip(value):
    assert ron.loads(ron.dumps(value)) == value


def test_ron_lens():
    text = '(version: "1", name: "n", // note\n author: "a", description: Some("d"), domains: ["a.b"], urls: ["https://x.y$", r#"q"#,], )'
    found = lens.load(text)
    assert (found.description, found.domains, found.urls) == ("d", ["a.b"], ["https://x.y$", "q"])
    assert lens.load(lens.dump(found)) == found
    with pytest.raises(ron.RonError):
        ron.loads("(a: 1")
    with pytest.raises(ValueError):
        lens.checked([r"(?=a)b"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["http://a.b/", "http://c.d/e"]), st.text(st.characters(blacklist_categories=["Cs"]), max_size=40)), max_size=5))
def test_warc_round_trip(rows):
    data = warc.to_bytes(rows)
    for raw in (data, gzip.compress(data), b"".join(gzip.compress(warc.to_bytes([r])) for r in rows)):
        for step in (1, 7, 1 << 20):
            pieces = (raw[i : i + step] for i in range(0, len(raw), step))
            assert [(r[2], r[5].decode()) for r in warc.records(warc.inflated(io.BytesIO(raw)) if raw[:2] == warc.GZIP else pieces)] == rows


def test_large_warc_is_read_piece_by_piece(tmp_path):
    path = tmp_path / "large.warc.gz"
    with open(path, "wb") as f:
        for i in range(120):  # members of two records, 240 MB in all
            f.write(gzip.compress(warc.to_bytes([(f"http://a.b/{i}", "x" * 1_000_000), (f"http://a.b/{i}b", "y" * 1_000_000)]), 1))
    tracemalloc.start()
    with open(path, "rb") as f:
        assert sum(len(r[5]) for r in warc.records(warc.inflated(f))) == 240_000_000
        f.seek(0)
        assert [len(x) for x in warc._frames(warc.records(warc.inflated(f)), 5_000_000)] == [5] * 48
    assert tracemalloc.get_traced_memory()[1] < 40_000_000
    tracemalloc.stop()


def test_damaged_places():
    good = warc.to_bytes([("http://a.b/", "one"), ("http://a.b/2", "two" * 3000)])
    packed = gzip.compress(good) + gzip.compress(good)
    assert len(list(warc.records(warc.inflated(io.BytesIO(packed))))) == 4
    cut = list(warc.records(warc.inflated(io.BytesIO(packed[:-40]))))
    assert [r[6] for r in cut[:2]] == [False, False] and len(cut) <= 4 and sum(not r[6] for r in cut) >= 2
    assert [r[6] for r in warc.records([b"junk WARC/1.1 no end"])] == [True]
    assert [r[6] for r in warc.records([b"WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n", good])] == [True, False, False]
    assert [r[6] for r in warc.records([b"WARC/" + b"x" * (2 << 20), b"\n\n", good])] == [True, False, False]
    assert list(warc.records([])) == [] == list(warc.inflated(io.BytesIO(b"")))


def test_damaged_warc(spark, tmp_path):
    good = warc.to_bytes([("http://a.b/", "HTTP/1.1 200 OK\nK: v : w\n\n x \n\ny\n")])
    no_uri = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (tmp_path / "archive.warc.gz").write_bytes(gzip.compress(good + b"WARC/1.1\r\nContent-Length: x\r\n\r\n" + no_uri + warc.record("http://b.c/", b"\xff\xfe")))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [r.corrupt for r in rows] == [False, True, False, False]
    warc.register(spark)
    assert spark.read.format("warc").load(str(tmp_path)).count() == 4
    found = warc.to_archive_records(warc.read_warc(spark, str(tmp_path))).collect()
    assert [(r.status, r.url, [tuple(h) for h in r.headers], r.content) for r in found] == [(200, "http://a.b/", [("K", "v : w")], "xy")]


def test_parsed_archives(spark, tmp_path):
    lines = ['(canonical_url: Some("http://a/"), content: "c", content_hash: "h", description: "d", meta: {"k": "v"}, title: None)', "broken", '(canonical_url: None, content: "e", content_hash: "h", description: "", meta: {}, title: Some("t"))']
    (tmp_path / "parsed.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    assert [r.content for r in parsed.read_parsed(spark, str(tmp_path / "parsed.gz")).collect()] == ["c", "e"]
    assert [r.content for r in parsed.read_parsed(spark, str(tmp_path / "parsed.gz"), stop_at_first_error=True).collect()] == ["c"]
    assert parsed.format_of("x/a.jsonl.gz") == "json" and parsed.format_of("parsed.gz") == "ron"


def test_archives(spark, tmp_path):
    html = "<html><head><link rel=canonical href='{}'></head><body>{}</body></html>"
    rows = [(200, "http://a.b/1", html.format("http://a.b/c", "one"), 1), (200, "http://a.b/2", html.format("http://a.b/c", "two"), 2), (200, "http://a.b/c", html.format("", "three"), 3), (404, "http://a.b/4", "", 4)]
    records = spark.createDataFrame(rows, "status int, url string, content string, seq long").withColumn("headers", F.array().cast("array<struct<name:string,value:string>>"))
    files = archive.create_archives(records, str(tmp_path))
    assert sorted(r.url for r in warc.to_archive_records(warc.read_warc(spark, files.warc)).collect()) == ["http://a.b/1", "http://a.b/2"]
    assert [r.content for r in parsed.read_parsed(spark, files.parsed).collect()] == ["one"]
    assert sorted(r.content for r in archive.preprocess(spark, files.warc).collect()) in (["one"], ["two"])


def fold(rows):
    emitted, out = set(), []
    for i, u, c in rows:
        keep = u not in emitted
        new = keep and c is not None and c not in emitted
        emitted |= {c} if new else set()
        out.append((i, keep, new))
    return out


@pytest.mark.parametrize("span", [5, 30, 1000])
def test_dual_dedupe(spark, span, monkeypatch):
    rng = random.Random(span)
    rows = [(i, f"u{rng.randrange(span)}", rng.choice([None, f"u{rng.randrange(span)}", f"c{rng.randrange(span)}"])) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, url string, canonical_norm string")
    got = sorted((r.seq, r.archived, r.parsed) for r in dedupe.dual_dedupe(df).collect())
    assert got == fold(rows)
    for least in (0.0, 2.0):  # rounds alone, and chains followed in order from the second round on
        monkeypatch.setattr(dedupe, "LEAST_SETTLED", least)
        assert sorted((r.seq, r.archived, r.parsed) for r in dedupe.dual_dedupe(df).collect()) == fold(rows)
    own = [(i, f"u{i % 7}", f"u{i % 7}" if i % 2 else None) for i in range(40)]
    got = sorted((r.seq, r.archived, r.parsed) for r in dedupe.dual_dedupe(spark.createDataFrame(own, "seq long, url string, canonical_norm string")).collect())
    assert got == fold(own)


def test_dual_dedupe_of_a_whole_site(spark):
    """One canonical URL for most rows, a long chain, and URLs that are missing."""
    rng = random.Random(1)
    rows = [(i, f"p{rng.randrange(4000)}", "home") for i in range(5000)] + [(5000 + i, f"c{i}", f"c{i + 1}") for i in range(60)] + [(6000 + i, "home", rng.choice(["home", "x", None])) for i in range(5)] + [(7000, None, "p1"), (7001, "p1", "q")]
    rng.shuffle(rows)
    rows = [(n, u, c) for n, (_, u, c) in enumerate(rows)]
    df = spark.createDataFrame(rows, "seq long, url string, canonical_norm string")
    assert sorted((r.seq, r.archived, r.parsed) for r in dedupe.dual_dedupe(df).collect()) == fold(rows)
    assert dedupe.dual_dedupe(df.limit(0)).collect() == []


def test_cdx(spark, tmp_path):
    (tmp_path / "http%3A%2F%2Fa.b%2F.0").write_text("u1\nu2\n\nkey\n")
    (tmp_path / "http%3A%2F%2Fa.b%2F.1").write_text("u3\n")
    spark.dataSource.register(web.CdxSource)
    rows = spark.read.format("cdx").option("path", str(tmp_path)).option("prefixes", "http://a.b/\nhttp://none/").option("limit", "2").load()
    assert sorted(r.url for r in rows.collect()) == ["u1", "u2", "u3"]
    assert web.cdx_page("u1\nu1\n\nk", 2) == (["u1", "u1"], "k")


def transport(pages):
    def fetch(url):
        found = pages.get(url)
        if isinstance(found, list):
            found = found.pop(0)
        if found is None:
            return web.Response(404, url)
        return found if isinstance(found, web.Response) else web.Response(200, url, [("K", "v")], found.encode() if isinstance(found, str) else found)

    return fetch


def test_retries():
    naps = []
    pages = {"u": [web.Response(503, "u"), web.Response(429, "u"), web.Response(200, "u")], "gone": web.Response(404, "gone")}
    assert web.with_retries(transport(pages), "u", web.backoff_delays(), sleep=naps.append).status == 200 and naps == [0.1, 10.0]  # a 429 asks for 5 s, then comes the delay
    assert web.with_retries(transport(pages), "gone", web.backoff_delays(), sleep=naps.append).status == 404 and len(naps) == 2


def test_what_a_server_asks_to_wait():
    naps = []
    answers = [web.Response(429, "u", [("Retry-After", "7")]), web.Response(429, "u", [("retry-after", "soon")]), web.Response(429, "u"), web.Response(200, "u")]
    assert web.with_retries(transport({"u": answers}), "u", [1, 2, 3], sleep=naps.append).status == 200
    assert naps == [7.001, 5.002, 5.003]
    assert web.wait_asked_ms(web.Response(429, "u", [("Retry-After", "7")]), "ms") == 7 and web.wait_asked_ms(web.Response(503, "u", [("Retry-After", "7")])) == 0


def server():
    """A transport with a clock of its own; the content is the time of the request."""

    class Server:
        time = 0.0

        def sleep(self, seconds):
            self.time += seconds

        def clock(self):
            return self.time

        def fetch(self, url):
            self.time += 0.01
            return web.Response(200, url, [], f"{self.time:.3f}".encode())

    return Server()


def test_hosts_are_asked_by_turns(spark):
    made = server()
    urls = [(f"http://{h}.x/{i}",) for h in "abc" for i in range(5)]
    got = crawl.fetch_all(spark.createDataFrame(urls, "url string").coalesce(1), made.fetch, as_of="2024-01-01", origin_first=True, per_second=2, sleep=made.sleep, clock=made.clock).collect()
    times = {}
    for r in got:
        times.setdefault(r.url.split("/")[2], []).append(float(r.content))
    for found in times.values():
        found.sort()
        assert len(found) == 5 and all(b - a >= 0.5 - 1e-6 for a, b in zip(found, found[1:]))
    assert max(map(max, times.values())) < 2.2  # the hosts of a task wait together, not one after the other
    assert crawl.by_turns(["a", "a", "b", None, "a", "b"]) == [0, 2, 3, 1, 5, 4]


def test_cache_keeps_the_last_row_of_a_url(spark):
    none = F.array().cast("array<struct<name:string,value:string>>")
    rows = spark.createDataFrame([("http://a/", 500, 1), ("http://a/", 200, 2), ("http://b/", 200, 1), ("http://b/", 404, 3)], "url string, status int, fetched_at int").withColumn("headers", none)
    keyed = rows.withColumn("key", F.xxhash64("url"))
    assert sorted((r.url, r.status) for r in crawl.cached(keyed).collect()) == [("http://a/", 200), ("http://b/", 404)]
    assert crawl.cached(keyed.limit(0)).collect() == []


def test_commands(spark, tmp_path, capsys):
    """The commands one after the other, with pages from memory and one that fails at first."""
    root = str(tmp_path)
    pages = {
        "http://a.b/": "<html><head><title>front</title></head><body>front</body></html>",
        "http://a.b/robots.txt": "Sitemap: http://a.b/map.xml\n",
        "http://a.b/sitemap.xml": None,
        "http://a.b/map.xml": "<urlset>" + "".join(f"<url><loc>http://a.b/p{i}</loc></url>" for i in range(1100)) + "<url><loc>http://other.c/x</loc></url></urlset>",
    }
    (tmp_path / "t.ron").write_text(lens.dump(lens.Lens("t", domains=["a.b"])))

    def run(*args, transport):
        cli.main(["-l", f"{root}/t.ron", *args], spark=spark, root=root, transport=transport)
        return capsys.readouterr().out

    listed = run("check-urls", transport=transport(pages))
    assert listed.split() == sorted(["http://a.b/", *(f"http://a.b/p{i}" for i in range(1100))])
    (tmp_path / "archives/t/urls.txt").exists()
    assert "front" not in run("check-domain", "a.b", transport=transport(pages))

    few = [f"http://a.b/p{i}" for i in range(4)]
    spark.createDataFrame([(u,) for u in few], "url string").coalesce(1).write.mode("overwrite").text(f"{root}/archives/t/urls.txt")
    answers = {u: f"<html><head><link rel=canonical href='{u}'></head><body>page {u[-1]}</body></html>" for u in few}
    session = cli.Session(spark, lens.Lens("t", domains=["a.b"]), root, transport(answers | {few[3]: None}))
    session.crawl(origin_first=True, per_second=1000)
    assert sorted(r.url for r in session.cache().filter("error_kind is null").collect()) == few[:3]
    session.transport = transport({few[3]: answers[few[3]]})  # only what is missing is asked for again
    files = session.crawl(origin_first=True, per_second=1000)
    assert sorted(r.url for r in session.cache().filter("error_kind is null").collect()) == few
    assert sorted(r.content for r in parsed.read_parsed(spark, files.parsed).collect()) == [f"page {i}" for i in range(4)]
    assert "true" in run("validate", transport=transport({}))
    assert cli.archive_path(session.storage) == files.warc == cli.archive_path(files.warc)
    before = parsed.read_parsed(spark, files.parsed).count()
    cli.main(["preprocess", session.storage], spark=spark, root=root)
    assert parsed.read_parsed(spark, files.parsed).count() == before
    cli.upload(spark, files.parsed, f"{root}/bucket/parsed.gz")
    assert parsed.read_parsed(spark, f"{root}/bucket/parsed.gz").count() == 4
    cli.clean(root)
    assert not (tmp_path / "tmp").exists() and (tmp_path / "archives").exists()


def test_index_pages(spark):
    from urllib.parse import parse_qs, urlsplit

    def fetch(url):
        asked = parse_qs(urlsplit(url).query)
        key, below = int(asked.get("resumeKey", ["0"])[0]), asked["url"][0]
        if key == 3 or "none" in below:
            raise OSError("gone")
        urls = [f"http://{below}/{key}-{i}" for i in range(1000 if "long" in below else 2)]
        return web.Response(200, url, [], "\n".join([*urls, "", str(key + 1)] if "long" in below else urls).encode())

    prefixes = spark.createDataFrame([("long.x",), ("short.x",), ("none.x",), ("short.x",)], "prefix string")
    got = web.index_urls(prefixes, fetch, 2024, sleep=lambda s: None)
    assert {r["prefix"]: r["count"] for r in got.groupBy("prefix").count().collect()} == {"long.x": 3000, "short.x": 2}
    assert got.select("url").distinct().count() == 3002


def test_unsafe_xml(spark):
    bomb = "<!DOCTYPE x [<!ENTITY a 'b'>]><urlset><url><loc>&a;</loc></url></urlset>"
    rows = spark.createDataFrame([(bomb,), ("<urlset><url><loc>u</loc></url><url",), (None,), ("",)], "t string")
    assert [list(r.l.urls) for r in rows.select(web.sitemap_links("t").alias("l")).collect()] == [[], ["u"], [], []]


def test_deep_sitemaps(spark):
    nested = "<urlset><url><loc>u{0}</loc></url><sitemap><loc>s{1}</loc></sitemap></urlset>"
    known = spark.createDataFrame([(f"s{i}", nested.format(i, (i + 1) % 20)) for i in range(20)], "sitemap string, text string").coalesce(1)
    seeds = spark.createDataFrame([("s0",)], "sitemap string")
    found = web.expand_sitemaps(seeds, lambda frontier: frontier.join(known, "sitemap"), ["u"], [])
    assert sorted(r.url for r in found.collect()) == sorted(f"u{i}" for i in range(20))


def test_session(spark, tmp_path):
    pages = {
        "http://a.b/": "<html><head><link type='application/rss+xml' href='http://a.b/feed'></head><body>front</body></html>",
        "http://a.b/robots.txt": "Sitemap: http://a.b/map.xml.gz\n",
        "http://a.b/map.xml.gz": gzip.compress(b"<x/>"),
        "http://a.b/feed": "<rss><channel><item><link>http://other.c/1</link></item></channel></rss>",
        "http://other.c/1": "<p>item</p>",
    }
    session = cli.Session(spark, lens.Lens("t", domains=["a.b"]), str(tmp_path), transport(pages))
    info = session.sites(["a.b", "none.x"]).orderBy("domain").collect()
    again = cli.Session(spark, session.lens, str(tmp_path), transport({}))  # asks nothing that is known, found or not
    assert again.sites(["none.x", "a.b"]).orderBy("domain").collect() == info
    assert info[0].sitemaps == ["http://a.b/map.xml.gz"] and info[0].feeds[0].feed_type == "Rss" and info[1].sitemaps == []
    queue = spark.createDataFrame([("http://a.b/",), ("http://gone.x/",)], "url string")
    got = {r.url: r for r in crawl.fetch_all(queue, transport(pages), as_of="2024-01-01", sleep=lambda s: None).collect()}
    assert got["http://a.b/"].status == 200 and got["http://gone.x/"].error_kind == "http_error"
    records = spark.createDataFrame([(200, "http://a.b/", "x")], "status int, url string, content string").withColumn("headers", F.array(F.struct(F.lit("a").alias("name"), F.lit("b").alias("value"))))
    assert validate.report(spark.createDataFrame([("http://A.b",)], "url string"), records).first().valid


def test_packed_sitemap(spark, tmp_path):
    packed = gzip.compress("<urlset><url><loc>http://a.b/é</loc></url></urlset>".encode())
    pages = {
        "http://a.b/robots.txt": "Sitemap: http://a.b/map.xml.gz\nSitemap: http://a.b/damaged.xml.gz\n",
        "http://a.b/map.xml.gz": packed,
        "http://a.b/damaged.xml.gz": packed[:12] + bytes(20) + packed[-8:],
    }
    session = cli.Session(spark, lens.Lens("t", domains=["a.b"]), str(tmp_path), transport(pages))
    assert "http://a.b/%C3%A9" in [r.url for r in session.find_urls().collect()]


def test_redirected_payloads(spark, tmp_path):
    whole = {
        "/": b"<link rel='alternate' type='application/rss+xml' href='http://a.b/feed'>",
        "/robots.txt": b"User-agent: *\nSitemap: http://a.b/map.xml\n",
        "/map.xml.gz": gzip.compress(b"<urlset><url><loc>http://a.b/page</loc></url></urlset>"),
        "/feed": b"<rss><channel><item><link>http://other.c/1</link></item></channel></rss>",
    }
    pages = {f"http://a.b{path.removesuffix('.gz')}": web.Response(200, f"https://www.a.b{path}", [], body) for path, body in whole.items()}
    session = cli.Session(spark, lens.Lens("t", domains=["a.b"]), str(tmp_path), transport(pages))
    info = session.sites(["a.b"]).first()
    assert info.robots_txt.startswith("User-agent") and info.sitemaps == ["http://a.b/map.xml"] and len(info.feeds) == 1
    assert {"http://a.b/page", "http://other.c/1"} <= {r.url for r in session.find_urls().collect()}


def test_crawl_folder(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.html").write_text("<p>one")
    (tmp_path / "in" / "sub" / "two.html").write_text("<p>two")
    (tmp_path / "out").mkdir()
    files = cli.crawl_folder(spark, "http://a.b/", str(tmp_path / "out"), str(tmp_path / "in"))
    assert sorted(r.content for r in parsed.read_parsed(spark, files.parsed).collect()) == ["one", "two"]
    assert lens.load((tmp_path / "out" / "lens.ron").read_text()).urls == ["http://a.b/one$", "http://a.b/two$"]


def test_sql(spark):
    pages = spark.createDataFrame([("HTTP://A.b",)], "url string")
    cli.register_sql(spark, {"p": pages})
    assert spark.sql("SELECT whatwg_url(url) AS u, content_hash('abc') AS h FROM p").first()[:] == ("http://a.b/", "508c5e8c327c14e2e1a72ba34eeb452f37458b209ed63a294d999b4c86675982")


def test_lossy_body(spark):
    bodies = ["HTTP/1.1 200 OK\nA: b\n\nx\n", "A:b\r\nno colon\r\n\r\n c \r\n\r\nd", "only: header", "", "\n\n"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(parse.split_body(F.col("b")).alias("m")).collect()
    assert [([tuple(h) for h in r.m.headers], r.m.content) for r in got] == [([("A", "b")], "x"), ([("A", "b")], "cd"), ([("only", "header")], ""), ([], ""), ([], "")]
