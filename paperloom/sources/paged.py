"""Captured list pages as a Spark data source, ``captured_lists``: every poll of every feed is walked page by page.

Under the path lies a folder for each feed: ``feed.json`` with its kind, seed and configuration, and for each poll a file
``<number>.jsonl`` of captured pages ({"url", "body"}). Batch reads take all polls; as a stream the offset is the number of the last poll, so a
restart reads exactly the polls that were not processed. A partition is one poll of one feed.

Where a walk stops is told from the captures alone: at a page without a next one, at the page that shows a URL of the
front page of the poll before (that page is still given whole, so nothing between is lost), or at the limits.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from paperloom.sources.html import _Builder, _Node

# Fixed values.
FRONT = 20
MOST_PAGES, MOST_ITEMS = 10, 500

SCHEMA = "feed_id string, kind string, poll int, page_no int, page_url string, ordinal int, url string, title string, published timestamp, exhausted boolean, note string"
Item = tuple[str, str | None, datetime | None]


def moment(text: object) -> datetime | None:
    """A date of a feed or an API: epoch seconds, ISO, or the mail format; None if it is none of them."""
    try:
        if isinstance(text, int | float):
            return datetime.fromtimestamp(text, UTC)
        if not isinstance(text, str) or not text.strip():
            return None
        text = text.strip()
        at = datetime.fromisoformat(text) if re.match(r"\d{4}-", text) else parsedate_to_datetime(text)
        return at if at.tzinfo else at.replace(tzinfo=UTC)
    except (ValueError, OverflowError, OSError):
        return None


def _xml(body: str) -> ET.Element | None:
    if "<!ENTITY" in body:  # never expand what a document declares
        return None
    try:
        return ET.fromstring(body.encode())
    except ET.ParseError:
        return None


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _child(node: ET.Element, *names: str) -> str | None:
    return next((c.text.strip() for n in names for c in node if _local(c) == n and c.text), None)


def feed_page(url: str, body: str, config: dict) -> tuple[list[Item], str | None]:
    """Entries of an RSS or Atom document, and its archive's next page."""
    root, items, onward = _xml(body), [], None
    for node in root.iter() if root is not None else ():
        if _local(node) in ("item", "entry"):
            href = next((c.get("href") for c in node if _local(c) == "link" and c.get("href") and c.get("rel", "alternate") == "alternate"), None)
            if link := href or _child(node, "link"):
                items.append((urljoin(url, link), _child(node, "title"), moment(_child(node, "pubDate", "published", "updated", "date"))))
        elif _local(node) == "link" and node.get("rel") in ("next", "prev-archive") and onward is None:
            onward = urljoin(url, node.get("href", ""))
    return items, onward


def dotted(value: object, path: str) -> object:
    for key in filter(None, path.split(".")):
        value = value.get(key) if isinstance(value, dict) else value[int(key)] if isinstance(value, list) and key.isdigit() and int(key) < len(value) else None
    return value


def api_page(url: str, body: str, config: dict) -> tuple[list[Item], str | None]:
    """Items of a JSON response by paths, and the next page: the one that it names, or the next number while there are items."""
    try:
        data = json.loads(body)
    except ValueError:
        return [], None
    found = dotted(data, config["items_path"])
    items = [(link, row.get(config.get("title_field", "title")), moment(row.get(config.get("date_field", "date")))) for row in (found if isinstance(found, list) else ()) if isinstance(row, dict) and isinstance(link := row.get(config["url_field"]), str) and link]
    named = dotted(data, config["next_url_field"]) if config.get("next_url_field") else None
    if isinstance(named, str) and named:
        return items, named
    if not items or "{page}" not in config.get("endpoint", ""):
        return items, None
    before, after = (re.escape(x) for x in config["endpoint"].split("{page}", 1))
    number = re.fullmatch(f"{before}(\\d+){after}", url)
    return items, config["endpoint"].replace("{page}", str(int(number[1]) + 1)) if number else None


def sitemap_page(url: str, body: str, config: dict) -> tuple[list[Item], str | None]:
    """Locations under the allowed paths; an index of sitemaps isn't followed."""
    root = _xml(body)
    if root is None or _local(root) != "urlset":
        return [], None
    allowed = tuple(config.get("allowed_paths") or ("",))
    places = [(_child(node, "loc"), moment(_child(node, "lastmod"))) for node in root if _local(node) == "url"]
    return [(loc, None, at) for loc, at in places if loc and (loc.startswith(allowed) or (urlsplit(loc).path or "/").startswith(allowed))], None


def _matches(node: _Node, step: str) -> bool:
    tag, *marks = re.split(r"(?=[.#])", step)
    own = node.attrs.get("class", "").split()
    return (not tag or node.tag == tag) and all(m[1:] in own if m[0] == "." else node.attrs.get("id") == m[1:] for m in marks)


def select(root: _Node, selector: str) -> Iterator[_Node]:
    """Nodes by a selector of tags, classes and ids, each step anywhere below the one before."""
    steps = selector.split()
    for node in root.walk():
        if node is not root and _matches(node, steps[-1]):
            at, left = node.parent, steps[:-1]
            while left and at is not None:
                if _matches(at, left[-1]):
                    left = left[:-1]
                at = at.parent
            if not left:
                yield node


def html_page(url: str, body: str, config: dict) -> tuple[list[Item], str | None]:
    """Items of an HTML list, and the next page by its link or by the number in the query."""
    tree = _Builder()
    tree.feed(body)
    items: list[Item] = []
    for node in select(tree.root, config["list_selector"]):
        link = next(select(node, config["link_selector"]), None)
        if link is None or not link.attrs.get("href"):
            continue
        date = next(select(node, config["date_selector"]), None) if config.get("date_selector") else None
        items.append((urljoin(url, link.attrs["href"]), link.text() or None, None if date is None else moment(date.attrs.get("datetime") or date.text())))
    paging = config.get("pagination", {})
    if paging.get("mode", "next_link") == "page_param":
        return items, next_number(url, paging["page_param"]) if items else None
    onward = next(select(tree.root, paging["next_selector"]), None) if paging.get("next_selector") else None
    target = urljoin(url, onward.attrs["href"]) if onward is not None and onward.attrs.get("href") else None
    return items, target if target and target.rstrip("/") != url.rstrip("/") else None


def next_number(url: str, name: str) -> str:
    """The URL with the parameter raised by one; without it, page 2."""
    u = urlsplit(url)
    query, n = re.subn(rf"(?<![^&]){re.escape(name)}=(\d*)", lambda m: f"{name}={int(m[1] or 1) + 1}", u.query, count=1)
    return urlunsplit((u.scheme, u.netloc, u.path, query if n else f"{query}&{name}=2" if query else f"{name}=2", ""))


PAGES = {"rss": feed_page, "atom": feed_page, "api": api_page, "sitemap": sitemap_page, "html_list": html_page}


def walk(feed: dict, pages: dict[str, str], front_before: dict[str, str], most_pages: int = MOST_PAGES, most_items: int = MOST_ITEMS) -> Iterator[tuple[int, str, list[Item], bool, str | None]]:
    """(number, url, items, exhausted, note) of a poll's pages, from the seed on. A page that wasn't captured ends the walk unexhausted."""
    kind, config = feed["kind"], feed.get("config", {})
    url = feed["seed"].replace("{page}", str(config.get("page_start", 1)))
    if kind == "page_monitor":  # its one item is given at every poll
        yield 1, url, [(url, None, None)], True, None
        return
    parse, known = PAGES[kind], set()
    if kind == "html_list" and url in front_before:
        known = {urldefrag(u)[0] for u, *_ in parse(url, front_before[url], config)[0][:FRONT]}
    total, seen = 0, set()
    for number in range(1, most_pages + 1):
        if url not in pages:
            yield number, url, [], False, "page not captured"
            return
        seen.add(url)
        items, onward = parse(url, pages[url], config)
        met = any(urldefrag(u)[0] in known for u, *_ in items)
        onward = None if met or onward in seen else onward
        if kind == "sitemap":  # its pages are stretches of one document
            items, rest = items[: most_items - total], items[most_items - total :]
            yield number, url, items, not rest, None
            return
        yield number, url, items, onward is None, "boundary met, page given for dedup" if met else None
        total += len(items)
        if onward is None or total >= most_items:
            return
        url = onward


class _Folder:
    def __init__(self, options: dict):
        self.options = dict(options)

    def open(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def polls(self) -> list[tuple[str, int]]:
        """(feed, poll) of every captured file."""
        files, root = self.open()
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((info.path.split("/")[-2], int(m[1])) for info in found if (m := re.fullmatch(r"(\d+)\.jsonl", info.base_name)))

    def text(self, name: str) -> str | None:
        files, root = self.open()
        if files.get_file_info(f"{root}/{name}").type != fs.FileType.File:
            return None
        with files.open_input_stream(f"{root}/{name}") as f:
            return f.read().decode()

    def pages(self, feed: str, poll: int) -> dict[str, str]:
        return {p["url"]: p["body"] for p in map(json.loads, filter(str.strip, (self.text(f"{feed}/{poll}.jsonl") or "").split("\n")))}

    def rows(self, feed: str, poll: int) -> Iterator[tuple]:
        config = json.loads(self.text(f"{feed}/feed.json") or "{}")
        most = {k: int(self.options[k]) for k in ("most_pages", "most_items") if k in self.options}
        for number, url, items, exhausted, note in walk(config, self.pages(feed, poll), self.pages(feed, poll - 1), **most):
            for k, (link, title, at) in enumerate(items or [(None, None, None)]):  # an empty page is a row without a URL
                yield feed, config["kind"], poll, number, url, k, link, title, at, exhausted, note


class _Poll(InputPartition):
    def __init__(self, feed: str, poll: int):
        super().__init__((feed, poll))


class _Batch(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self):
        return [_Poll(*x) for x in self.folder.polls()]

    def read(self, partition):
        return self.folder.rows(*partition.value)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self):  # noqa: N802
        return {"poll": 0}

    def latestOffset(self):  # noqa: N802
        return {"poll": max((n for _, n in self.folder.polls()), default=0)}

    def partitions(self, start, end):
        return [_Poll(f, n) for f, n in self.folder.polls() if start["poll"] < n <= end["poll"]]

    def read(self, partition):
        return self.folder.rows(*partition.value)


class CapturedLists(DataSource):
    """Options: path; most_pages and most_items, the limits of one poll of one feed."""

    @classmethod
    def name(cls):
        return "captured_lists"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(_Folder(self.options))

    def streamReader(self, schema):  # noqa: N802
        return _Stream(_Folder(self.options))
