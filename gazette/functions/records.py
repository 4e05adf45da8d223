"""Records of notices from JSON and HTML documents, as table functions: one document in, many rows out.

HTML is parsed in the tasks, a batch at a time; what follows (links, dates, identities, deduplication, gates) are columns, joins and
windows over the rows (functions.urls, operators.writes, operators.decisions).
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import json_records, urls
from .text import normal_dates, squeeze

#: Elements without visible text.
HIDDEN_TAGS = ("script", "style", "nav", "footer", "header", "aside", "input", "iframe", "meta", "link", "img")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: What a task gives of each record of a document, before links and dates are brought into one form.
RAW = "doc_id bigint, record_index int, title string, author string, link string, external_id string, dates array<string>, base string, source_path string"


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "texts")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.texts = tag, attrs, parent, [], []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self) -> str:
        """Visible text in document order, squeezed."""
        out, stack = [], [(self, 0)]
        while stack:
            item, _ = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in HIDDEN_TAGS:
                stack.extend((x, 0) for x in reversed(item.texts))
        return squeeze(" ".join(out))

    def signature(self) -> tuple:
        return self.tag, tuple(sorted(self.attrs.get("class", "").split()))


class Tree(HTMLParser):
    """A light tree of a document; texts holds text and children in order. Unclosed elements end with their parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.texts.append(node)
        if tag not in VOID_TAGS:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.texts.append(data)


RECORD_TAGS = ("tr", "article", "li", "dl", "div", "a")


def groups(root: Node) -> list[list[Node]]:
    """Groups of two or more like elements of one parent, each with a link or a text of its own."""
    found = []
    for node in root.walk():
        kinds = Counter(c.signature() for c in node.children if c.tag in RECORD_TAGS)
        for kind, n in kinds.items():
            if n >= 2:
                found.append([c for c in node.children if c.signature() == kind])
    return found


def in_navigation(node: Node) -> bool:
    while node is not None:
        if node.tag in ("nav", "header", "footer", "aside") or node.attrs.get("role") == "navigation":
            return True
        node = node.parent
    return False


def anchor_of(record: Node) -> Node | None:
    """The link with the longest text."""
    links = [n for n in record.walk() if n.tag == "a" and n.attrs.get("href")]
    return max(links, key=lambda a: len(a.text()), default=None)


def html_record(record: Node) -> dict | None:
    anchor = anchor_of(record)
    heading = next((n for n in record.walk() if re.fullmatch("h[1-6]|dt", n.tag)), None)
    title = (heading.text() if heading is not None else "") or (anchor.text() if anchor is not None else "")
    if len(title) < 2:
        return None
    times = [n for n in record.walk() if n.tag == "time" or n.attrs.get("datetime") or "date" in n.attrs.get("class", "")]
    dates = [n.attrs.get("datetime") or n.attrs.get("title") or n.text() for n in times]
    author = next((n.text() for n in record.walk() if re.search("author|writer|name", n.attrs.get("class", ""))), "")
    ids = (record.attrs.get(k) for k in ("data-no", "data-id", "data-gno", "data-seq"))
    return {"title": title, "author": author, "link": anchor.attrs["href"] if anchor is not None else None, "external_id": next(filter(None, ids), None), "dates": dates}


def html_notices(text: str | None) -> list[dict]:
    """The records of the best group: by number of records with a title, those with a link or date, and its place."""
    root = Tree(text or "").root
    best, most = [], (0, 0)
    for group in groups(root):
        if in_navigation(group[0]):
            continue
        rows = [(i, r) for i, node in enumerate(group) if (r := html_record(node))]
        score = (sum(bool(r["link"]) + 2 * bool(r["dates"]) + bool(r["external_id"]) for _, r in rows) + min(len(rows), 20), len(rows))
        if len(rows) >= 2 and score > most:
            best, most = [{"record_index": i, "source_path": "/".join(group[0].signature()[1]) or group[0].tag, **r} for i, r in rows], score
    return best


def is_json(body: Column) -> Column:
    """Whether a body begins as JSON or as a callback around it."""
    return F.coalesce(body, F.lit("")).rlike(r"^\s*(?:[{\[]|[A-Za-z_$][\w.$]*\s*\()")


def extract(docs: DataFrame, doc_id: str, body: str, base: str) -> DataFrame:
    """(doc_id, record_index, title, author, detail_url, external_id, published_at, url, source_path) of each document's records.

    JSON is read by json_records; of HTML, tasks give the raw texts of the best group's records, and columns do the rest. Documents without
    records have no rows.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).alias("body"), F.coalesce(F.col(base), F.lit("")).alias("base"))

    def parse(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in RAW.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string(), pa.string()]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            out = [{"doc_id": doc, "base": url, **r} for doc, text, url in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in html_notices(text)]
            yield pa.RecordBatch.from_pylist(out, schema)

    html = rows.filter(~is_json(F.col("body"))).mapInArrow(parse, RAW)
    html = html.select(
        "doc_id", "record_index", "title", "author", urls.canonical(urls.absolute(F.col("base"), F.col("link"))).alias("detail_url"), "external_id",
        F.get(F.filter(F.transform("dates", normal_dates), lambda d: d.isNotNull()), 0).alias("published_at"), F.col("base").alias("url"), "source_path",
    )
    return html.unionByName(json_records.extract(rows.filter(is_json(F.col("body")))))


def visible_text(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    """(doc_id, visible, raw_hash, visible_hash)."""
    @F.pandas_udf("string")
    def visible(column: pd.Series) -> pd.Series:
        return column.map(lambda t: Tree(t or "").root.text())

    rows = docs.select(F.col(doc_id).alias("doc_id"), visible(F.col(body)).alias("visible"), F.sha2(body, 256).alias("raw_hash"))
    return rows.withColumn("visible_hash", F.sha2("visible", 256))


def json_rule(docs: DataFrame, body: str, paths: dict[str, str]) -> DataFrame:
    """A declarative JSON rule as columns: each field is the text at its path, null where there is none."""
    parsed = docs.withColumn("_v", F.try_parse_json(body))
    return parsed.withColumns({name: F.try_variant_get("_v", path, "string") for name, path in paths.items()}).drop("_v")
