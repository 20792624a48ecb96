"""Captured list pages as a stream, and discovery that commits each poll whole."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.sources import paged
from paperloom.streaming import discovery


def html(items, onward=None):
    rows = "".join(f'<li class="item x"><a class="t" href="{u}">Title {u}</a><time datetime="2024-01-0{1 + k % 9}">d</time></li>' for k, u in enumerate(items))
    return f'<div id="list"><ul>{rows}</ul>' + (f'<a class="next" href="{onward}">more</a>' if onward else "") + "</div>"


LIST = {"kind": "html_list", "seed": "http://n.org/list", "config": {"list_selector": "#list li.item", "link_selector": "a.t", "date_selector": "time", "pagination": {"mode": "next_link", "next_selector": "a.next"}}}


def put(root, feed, config, *polls):
    folder = root / feed
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "feed.json").write_text(json.dumps(config))
    have = len(list(folder.glob("*.jsonl")))
    for n, pages in enumerate(polls, have + 1):
        (folder / f"{n}.jsonl").write_text("\n".join(json.dumps({"url": u, "body": b}) for u, b in pages.items()))


def rss(items, onward=None):
    body = "".join(f"<item><title>T</title><link>{u}</link><pubDate>{d}</pubDate></item>" for u, d in items)
    more = f'<atom:link xmlns:atom="http://www.w3.org/2005/Atom" rel="next" href="{onward}"/>' if onward else ""
    return f"<rss><channel>{more}{body}</channel></rss>"


def test_pages_of_each_kind():
    items, onward = paged.feed_page("http://a.org/f", rss([("/1", "Tue, 02 Jan 2024 00:00:00 GMT"), ("http://a.org/2", "soon")], "/f?p=2"), {})
    assert [(u, at and at.day) for u, _, at in items] == [("http://a.org/1", 2), ("http://a.org/2", None)] and onward == "http://a.org/f?p=2"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><link rel="self" href="/x"/><entry><title>A</title><link href="/e1"/><updated>2024-03-04T05:06:07Z</updated></entry></feed>'
    assert paged.feed_page("http://a.org/", atom, {})[0][0][2].month == 3
    assert paged.feed_page("http://a.org/", '<!DOCTYPE a [<!ENTITY b "c">]><rss/>', {}) == ([], None)
    api = {"items_path": "data.rows", "url_field": "u", "endpoint": "http://a.org/?n={page}&k=1"}
    items, onward = paged.api_page("http://a.org/?n=9&k=1", json.dumps({"data": {"rows": [{"u": "http://x/1", "title": "t", "date": 86400}, {"no": 1}, 3]}}), api)
    assert len(items) == 1 and items[0][2].day == 2 and onward == "http://a.org/?n=10&k=1"
    assert paged.api_page("http://a.org/?n=10&k=1", '{"data": {"rows": []}}', api) == ([], None)
    assert paged.api_page("u", '{"rows": [], "more": "http://a.org/z"}', {"items_path": "rows", "url_field": "u", "next_url_field": "more"})[1] == "http://a.org/z"
    maps = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://a.org/etch/1</loc></url><url><loc>http://a.org/b</loc></url></urlset>'
    assert [u for u, *_ in paged.sitemap_page("s", maps, {"allowed_paths": ["/etch/"]})[0]] == ["http://a.org/etch/1"]
    assert paged.next_number("http://a.org/l", "p") == "http://a.org/l?p=2" and paged.next_number("http://a.org/l?x=1&p=7&z", "p") == "http://a.org/l?x=1&p=8&z"
    items, onward = paged.html_page("http://n.org/list", html(["/1", "/2#c"], "?p=2"), LIST["config"])
    assert [u for u, *_ in items] == ["http://n.org/1", "http://n.org/2#c"] and onward == "http://n.org/list?p=2"


def test_a_walk_ends_with_the_page_that_meets_the_boundary():
    pages = {"http://n.org/list": html([f"/{i}" for i in (9, 8)], "?p=2"), "http://n.org/list?p=2": html([f"/{i}" for i in (7, 6, 5)], "?p=3"), "http://n.org/list?p=3": html(["/4"])}
    before = {"http://n.org/list": html(["/6#top", "/3"])}
    got = list(paged.walk(LIST, pages, before))
    assert [(n, len(items), done) for n, _, items, done, _ in got] == [(1, 2, False), (2, 3, True)] and got[1][4]  # the whole page, then the end
    assert [n for n, *_ in paged.walk(LIST, pages, {})] == [1, 2, 3]
    assert [n for n, *_ in paged.walk(LIST, pages, {}, most_pages=2)] == [1, 2] and [n for n, *_ in paged.walk(LIST, pages, {}, most_items=2)] == [1]
    del pages["http://n.org/list?p=3"]
    assert list(paged.walk(LIST, pages, {}))[-1][3] is False
    assert [len(x[2]) for x in paged.walk({"kind": "page_monitor", "seed": "http://m.org"}, {}, {})] == [1]


def test_discovery_commits_each_poll_once(spark, tmp_path, monkeypatch):
    root, folder, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    put(root, "list", LIST, {"http://n.org/list": html(["/2", "/1"])})
    put(root, "watch", {"kind": "page_monitor", "seed": "http://m.org/p"}, {})
    put(root, "rss", {"kind": "rss", "seed": "http://f.org/"}, {"http://f.org/": rss([("http://f.org/a?utm_x=1", "Wed, 10 Jan 2024 00:00:00 GMT"), ("http://f.org/a#z", "Wed, 10 Jan 2024 00:00:00 GMT"), ("mailto:x", "")])})
    sink = discovery.DiscoverySink(spark, folder)
    discovery.run(spark, str(root), sink, check)
    urls = lambda: sorted(r["canonical_url"] for r in sink.read("candidates").collect())
    first = ["http://f.org/a", "http://m.org/p", "http://n.org/1", "http://n.org/2"]
    assert urls() == first
    assert {(r["feed_id"], r["outcome"], r["created"], r["invalid"]) for r in sink.read("runs").collect()} == {("list", "success", 2, 0), ("watch", "success", 1, 0), ("rss", "success", 1, 1)}

    put(root, "list", LIST, {"http://n.org/list": html(["/4", "/3"], "?p=2"), "http://n.org/list?p=2": html(["/2", "/1"], "?p=3"), "http://n.org/list?p=3": html(["/0"])})
    put(root, "watch", {"kind": "page_monitor", "seed": "http://m.org/p"}, {})
    put(root, "rss", {"kind": "rss", "seed": "http://f.org/"}, {"http://f.org/": rss([("http://f.org/old", "Fri, 05 Jan 2024 00:00:00 GMT"), ("http://f.org/late", "Mon, 08 Jan 2024 00:00:00 GMT")], "http://f.org/2")})
    whole, calls = discovery.DiscoverySink._write, []

    def dies(self, name, rows, attempt):
        calls.append(name)
        if len(calls) == 3:
            raise RuntimeError("lost")
        whole(self, name, rows, attempt)

    monkeypatch.setattr(discovery.DiscoverySink, "_write", dies)
    with pytest.raises(Exception, match="lost"):
        discovery.run(spark, str(root), sink, check)
    assert urls() == first  # candidates were written, but not committed
    monkeypatch.setattr(discovery.DiscoverySink, "_write", whole)
    sink = discovery.DiscoverySink(spark, folder)
    discovery.run(spark, str(root), sink, check)
    # beyond 72 hours before the boundary an entry is history; the list stops on its second page
    assert urls() == sorted([*first, "http://n.org/3", "http://n.org/4", "http://f.org/late"])
    second = {(r["feed_id"], r["outcome"], r["pages"], r["created"]) for r in sink.read("runs").filter("poll = 2").collect()}
    assert second == {("list", "success", 2, 2), ("watch", "no_change", 1, 0), ("rss", "partial", 2, 1)}
    assert sorted(r["epoch"] for r in sink.read("fetches").filter("feed_id = 'watch'").collect()) == [1, 2]
    assert sink.boundaries().filter("feed_id = 'rss'").select(F.dayofmonth("at")).first()[0] == 8
    again = spark.read.format("captured_lists").option("path", str(root)).load()
    sink.apply(again, 99)  # the polls come again in another batch
    assert sink.read("candidates").count() == 7 and sink.read("runs").count() == 6
