"""HTML and plain text to ordered blocks, with the standard library's parser, one document at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

# Fixed values.
BOILERPLATE = ("nav", "header", "footer", "aside", "script", "style", "noscript", "template", "iframe", "svg")
LOGIN = ("sign in", "signin", "log in", "login", "password", "登录", "登陆")
CHALLENGE = ("just a moment", "checking your browser", "verify you are human", "captcha", "cf-challenge", "请完成安全验证")
MOST_LINKS = 200
#: Pages whose parsed rows a task holds at once.
PAGES = 32
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

BLOCK = "struct<block_id:string,kind:string,text:string,section_path:array<string>,locator:string>"
PARSED = (
    f"struct<blocks:array<{BLOCK}>,title:string,author:string,date:string,links:array<string>,text_chars:int,link_chars:int,"
    "boilerplate_ratio:double,structure_hit_rate:double,login:boolean,challenge:boolean,scripts:int>"
)

_BLOCK = pa.struct([("block_id", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("section_path", pa.list_(pa.string())), ("locator", pa.string())])
_PARSED = pa.struct([
    ("blocks", pa.list_(_BLOCK)), ("title", pa.string()), ("author", pa.string()), ("date", pa.string()), ("links", pa.list_(pa.string())), ("text_chars", pa.int32()), ("link_chars", pa.int32()),
    ("boilerplate_ratio", pa.float64()), ("structure_hit_rate", pa.float64()), ("login", pa.bool_()), ("challenge", pa.bool_()), ("scripts", pa.int32()),
])


class _Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    parts.append(" ".join(node.split()))
            else:
                stack += reversed(node.children)
        return " ".join(parts)

    def within(self, tag: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False


class _Builder(HTMLParser):
    """A forgiving tree: a tag that isn't open is ignored when it ends; an open paragraph ends before a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _selector(node: _Node) -> str:
    steps = []
    while node.parent is not None and node.tag not in ("body", "html"):
        same = [c for c in node.parent.children if isinstance(c, _Node) and c.tag == node.tag]
        steps.append(node.tag if len(same) == 1 else f"{node.tag}:nth-of-type({same.index(node) + 1})")
        node = node.parent
    return " > ".join(reversed(steps))


def _rows(table: _Node) -> str:
    """Cells joined by bars, a line for each row with text; rows of nested tables belong to those."""
    lines = []
    for row in (n for n in table.walk() if n.tag == "tr"):
        owner = row.parent
        while owner is not None and owner.tag != "table":
            owner = owner.parent
        if owner is table:
            cells = [c.text() for c in row.children if isinstance(c, _Node) and c.tag in ("td", "th")]
            if any(cells):
                lines.append(" | ".join(cells))
    return "\n".join(lines)


def block_id(position: int, text: str) -> str:
    return f"b{position:03d}-{hashlib.sha256(text.encode()).hexdigest()[:10]}"


def parse(markup: str) -> dict:
    """Blocks, metadata and signals of one page. Login and challenge pages have no blocks."""
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    root = builder.root
    scripts = sum(n.tag == "script" for n in root.walk())
    before, removed = max(len(root.text()), 1), 0
    for node in list(root.walk()):
        if node.tag in BOILERPLATE and node.parent is not None and not any(node.within(t) for t in BOILERPLATE):
            removed += len(node.text())
            node.parent.children.remove(node)
    find = lambda tag: next((n for n in root.walk() if n.tag == tag), None)
    body, title_node = find("body") or root, find("title")
    title = title_node.text() if title_node else ""
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "") for n in root.walk() if n.tag == "meta"}
    heading = find("h1")
    time_node = find("time")
    text = body.text()
    out = {
        "blocks": [], "title": meta.get("og:title") or title or (heading.text() if heading else None) or None,
        "author": meta.get("author") or meta.get("article:author") or None,
        "date": meta.get("article:published_time") or meta.get("date") or (time_node.attrs.get("datetime") if time_node else None) or None,
        "links": [], "text_chars": 0, "link_chars": 0, "boilerplate_ratio": removed / before, "structure_hit_rate": 1.0,
        "login": False, "challenge": False, "scripts": scripts,
    }
    hay = f"{title.lower()} {text.lower()[:1000]}"
    if any(n.tag == "input" and n.attrs.get("type", "").lower() == "password" for n in root.walk()):
        out["login"] = True
    elif any(m in hay for m in CHALLENGE):
        out["challenge"] = True
    elif len(text) < 2000 and sum(m in hay for m in LOGIN) >= 2:
        out["login"] = True
    if out["login"] or out["challenge"]:
        return out
    open_headings: list[tuple[int, str]] = []
    kinds = {"p": "paragraph", "figcaption": "caption", "table": "table"}
    for node in body.walk():
        level = int(node.tag[1]) if len(node.tag) == 2 and node.tag[0] == "h" and node.tag[1] in "123456" else 0
        if not level and node.tag not in kinds or node.within("table"):
            continue
        content = _rows(node) if node.tag == "table" else node.text()
        if not content:
            continue
        out["blocks"].append({
            "block_id": block_id(len(out["blocks"]) + 1, content), "kind": "heading" if level else kinds[node.tag], "text": content,
            "section_path": [t for _, t in open_headings], "locator": _selector(node),
        })
        if level:
            while open_headings and open_headings[-1][0] >= level:
                open_headings.pop()
            open_headings.append((level, content))
    anchors = [n for n in root.walk() if n.tag == "a" and n.attrs.get("href")]
    out["links"] = [n.attrs["href"] for n in anchors][:MOST_LINKS]
    out["link_chars"] = sum(len(n.text()) for n in anchors)
    out["text_chars"] = sum(len(b["text"]) for b in out["blocks"])
    whole = max(len(text), out["text_chars"])
    out["structure_hit_rate"] = out["text_chars"] / whole if whole else 1.0
    return out


def parse_html(df: DataFrame, html_col: str, out_col: str = "parsed") -> DataFrame:
    """df with the parsed struct; a null page parses as an empty one. A task holds the parsed rows of ``PAGES`` pages."""
    at = df.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES):
                part = batch.slice(start, PAGES)
                parsed = pa.array([parse(p.as_py() or "") for p in part.column(at)], _PARSED)
                yield pa.RecordBatch.from_arrays([*part.columns, parsed], [*part.schema.names, out_col])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(out_col, DataType.fromDDL(PARSED)))


def plain_blocks(text: Column) -> Column:
    """array<struct<pos, text, locator>>: a paragraph for each line with text; locator is line[n]:offset."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    step = lambda acc, l: F.struct((acc["at"] + F.char_length(l) + 1).alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(F.struct((acc["n"] + 1).alias("pos"), F.trim(l).alias("text"), F.concat(F.lit("line["), acc["n"].cast("string"), F.lit("]:"), acc["at"].cast("string")).alias("locator")))).alias("out"))  # noqa: E731, E741
    first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<struct<pos:int,text:string,locator:string>>").alias("out"))
    return F.filter(F.aggregate(lines, first, step, lambda acc: acc["out"]), lambda b: b["text"] != "")


def is_table_line(line: Column) -> Column:
    """Two gaps of two blanks at least."""
    return F.size(F.split(F.trim(line), r"\s{2,}")) >= 3
