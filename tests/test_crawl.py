from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, http
from quillspark.functions.urls import canonical, url_host, url_origin
from quillspark.operators.crawl import crawl, paced_fetch, robots_allowed, settle_attempts


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://Example.COM/A", "http://example.com/A"),
        ("http://a.com:80/x#frag", "http://a.com/x"),
        ("https://a.com:443", "https://a.com/"),
        ("https://a.com:8443/x/", "https://a.com:8443/x"),
        ("http://a.com/?b=1&a=2&c=", "http://a.com/?a=2&b=1&c="),
        ("http://u:p@a.com//x/./y/../z/", "http://a.com/x/z"),
        (" mailto:x@y ", "mailto:x@y"),
        ("http://[bad", "http://[bad"),
    ],
)
def test_canonical(url, expected):
    assert canonical(url) == expected


def test_host_and_origin(spark):
    cases = [
        ("HTTPS://U:p@Quay.Example:8443/x?y@z", "quay.example", "https://U:p@Quay.Example:8443"), ("http://[2001:DB8::1]:80/", "2001:db8::1", "http://[2001:DB8::1]:80"),
        ("http://b.com?x", "b.com", "http://b.com"), ("mailto:x@y", "", "mailto://"), ("/only/path", "", "://"), ("", "", "://"), (None, None, None),
    ]
    df = spark.createDataFrame(cases, "u string, host string, origin string")
    for r in df.withColumns({"h": url_host(F.col("u")), "o": url_origin(F.col("u"))}).collect():
        assert (r.h, r.o) == (r.host, r.origin), r.u


def test_page():
    page = html.parse_page(
        "http://a.com/dir/",
        "<base href='/base/'><title> My  page </title><script>no</script><p>a<b>b</b> <i>c</i></p><td>d</td>"
        "<a href='next'>n</a><area href='http://A.com/x#y'><a href='mailto:z'>m</a><a href='next#2'>",
    )
    assert page == {"title": "My page", "text": "My page\nMy page abcdnm", "links": ["http://a.com/base/next", "http://a.com/x"]}
    assert html.parse_page("http://a.com/", "") == {"title": "http://a.com/", "text": "", "links": []}


def test_is_html(spark):
    cases = [(None, "x", True), ("text/html; charset=x", "x", True), ("text/plain", "  <!DOCTYPE html>", True), ("text/plain", "hello", False), ("application/pdf", "<html>", False)]
    for r in spark.createDataFrame(cases, "t string, b string, want boolean").withColumn("got", html.is_html(F.col("t"), F.col("b"))).collect():
        assert r.got == r.want


def test_retries(spark):
    cases = [(1, None, 0.0, 1.0), (3, None, 0.125, 4.125), (7, None, 0.5, 8.5), (1, "12", 0.0, 12.0), (4, "6", 0.0, 8.0), (1, "-9", 0.0, 1.0), (0, "Wed, 21 Oct 2015 07:28:41 GMT", 0.0, 41.0), (1, "later", 0.0, 1.0)]
    df = spark.createDataFrame(cases, "n int, h string, j double, want double")
    wait = http.retry_after(F.col("h"), F.to_timestamp(F.lit("2015-10-21 07:28:00")))
    for r in df.withColumn("got", http.backoff_seconds(F.col("n"), wait, jitter=F.col("j"))).collect():
        assert r.got == r.want


def test_status_ladder(spark, rows):
    ladder = {"404": [404], "ok": [500, 500, 200], "down": [503, 503, 503], "busy": [429, 200], "timeout": [None, 200], "connect": [None]}
    errors = {"timeout": "timeout", "connect": "connect"}
    data = [(u, i + 1, s, errors.get(u) if s is None else None) for u, x in ladder.items() for i, s in enumerate(x)]
    got = {r.url: (r.tries, r.ok) for r in settle_attempts(spark.createDataFrame(data, "url string, attempt int, status int, error string")).collect()}
    assert got == {"404": (1, False), "ok": (3, True), "down": (3, False), "busy": (2, True), "timeout": (2, True), "connect": (1, False)}


def test_robots_and_site(spark):
    robots = spark.createDataFrame([("http://a.com", 200, "User-agent: *\nDisallow: /secret"), ("http://b.com", 404, None), ("http://c.com", 500, None)], "origin string, status int, body string")
    urls = spark.createDataFrame([(u,) for u in ("http://a.com/x", "http://a.com/secret", "http://b.com/y", "http://c.com/z", "http://d.com/")], "url string")
    got = {r.url: r.verdict for r in robots_allowed(urls, robots).collect()}
    assert got == {"http://a.com/x": "allowed", "http://a.com/secret": "disallowed", "http://b.com/y": "allowed", "http://c.com/z": "unavailable", "http://d.com/": "unavailable"}

    links = {
        "http://b.com/quay": ["/boats?wind=w&tide=low", "/quay#top", "/pier/../quay/", "/lamp", "http://elsewhere.com/", "/rope"],
        "http://b.com/boats?tide=low&wind=w": ["/sail", "/quay"],
        "http://b.com/lamp": ["/oil"],
        "http://b.com/rope": [],
        "http://b.com/sail": [],
        "http://b.com/oil": [],
    }
    site = spark.createDataFrame([(u, 200, "text/html", None, "<title>t</title>x" + "".join(f"<a href='{x}'>l</a>" for x in ls)) for u, ls in links.items()], "url string, status int, content_type string, final_url string, body string")
    fetch = lambda frontier: site.join(frontier, "url", "left_semi")
    pages = crawl(spark, ["http://B.com/quay/#x"], fetch, robots, max_pages=5)
    assert {r.url for r in pages.collect()} == {"http://b.com/quay", "http://b.com/boats?tide=low&wind=w", "http://b.com/lamp", "http://b.com/rope", "http://b.com/sail"}
    closed = robots.filter("origin <> 'http://b.com'").unionByName(spark.createDataFrame([("http://b.com", 200, "User-agent: *\nDisallow: /lamp")], "origin string, status int, body string"))
    pages = crawl(spark, ["http://b.com/quay"], fetch, closed, max_pages=3)  # a denied page has used up its place
    assert {r.url for r in pages.collect()} == {"http://b.com/quay", "http://b.com/boats?tide=low&wind=w"}
    assert crawl(spark, ["ftp://x"], lambda f: site.limit(0), robots).count() == 0


def test_paced_fetch(spark):
    answers = {"http://a.com/ok": [200], "http://a.com/busy": [429, 503, 200], "http://b.com/gone": [404], "http://b.com/down": [500, 500, 500], "http://c.com/slow": ["timeout"] * 3, "http://c.com/odd": ["odd"]}

    def get(url, left={}):  # noqa: B006
        left.setdefault(url, list(answers[url]))
        step = left[url].pop(0)
        if step == "timeout":
            raise TimeoutError
        if step == "odd":
            raise ConnectionError
        return {"status": step, "content_type": "text/html", "body": b"x", "retry_after": 3.0 if step == 429 else None}

    frontier = spark.createDataFrame([(u,) for u in answers], "url string")
    got = {r.url: (r.status, len(r.attempts), r.attempts[-1].error) for r in paced_fetch(get, sleep=lambda s: None, jitter=lambda: 0.0)(frontier).collect()}
    assert got == {
        "http://a.com/ok": (200, 1, None), "http://a.com/busy": (200, 3, None), "http://b.com/gone": (404, 1, None), "http://b.com/down": (500, 3, None),
        "http://c.com/slow": (None, 3, "timeout"), "http://c.com/odd": (None, 1, "ConnectionError"),
    }


def test_crawl_of_a_live_site(tmp_path, spark, capsys):
    """Pages of a server in this process, whose rules are fetched and obeyed."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    from quillspark.__main__ import main

    site = {"/robots.txt": ("text/plain", "User-agent: *\nDisallow: /attic"), "/hall": ("text/html", "<title>Hall</title>a <a href='/attic'>x</a><a href='/cellar'>y</a><a href='/gone'>z</a>"), "/cellar": ("text/html", "<title>Cellar</title>b"), "/attic": ("text/html", "c")}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, body = site.get(self.path, ("text/html", ""))
            self.send_response(200 if self.path in site else 404)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        root = f"http://127.0.0.1:{server.server_port}"
        assert main(["crawl", f"{root}/hall", "--out", str(tmp_path / "pages"), "--min-delay", "0", "--max-pages", "9"]) == 0
        assert {(r.url, r.title) for r in spark.read.json(str(tmp_path / "pages")).collect()} == {(f"{root}/hall", "Hall"), (f"{root}/cellar", "Cellar")}
        assert "2 pages" in capsys.readouterr().out
    finally:
        server.shutdown()
