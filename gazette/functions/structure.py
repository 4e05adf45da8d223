"""Structure of HTML documents: bounded samples of their record groups, and links that only scripts tell.

Scripts are never run. A handler's call is matched with the function's text, and a target is built only from literals,
arguments, data attributes and encodeURIComponent; anything else gives no link.
"""

from __future__ import annotations

import html
import re
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .records import Node, Tree, groups, in_navigation
from . import urls
from .safety import SECRET
from .text import squeeze

GROUPS, RECORDS, CHARS = 4, 3, 24_000
#: What is left out of kept fragments, and the attributes that stay.
DROPPED = ("script", "style", "svg", "noscript", "template", "iframe")
KEPT_ATTRIBUTES = ("class", "id", "href", "title", "datetime", "itemprop", "role", "aria-label", "name", "content", "value")
#: Parts of the names of functions that lead to a page.
LEADING = ("article", "board", "detail", "go", "job", "move", "notice", "open", "post", "recruit", "show", "view")
CALL = re.compile(r"\s*(?:javascript:)?\s*(?:return\s+)?([A-Za-z_$][\w.$]*)\s*\(([^)]{0,512})\)")
TARGET = re.compile(r"(?:(?:window\.|document\.|self\.|top\.)?location(?:\.href)?\s*=\s*|location\.(?:assign|replace)\s*\(\s*|window\.open\s*\(\s*)([^;\n]+)")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)


def fragment(node: Node, limit: int = 4000) -> str:
    """A record's markup without scripts, pictures of code, handlers and secrets."""
    out: list[str] = []

    def write(n: Node) -> None:
        if n.tag in DROPPED:
            return
        attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items() if (k in KEPT_ATTRIBUTES or k.startswith("data-")) and not SECRET.search(k))
        out.append(f"<{n.tag}{attrs}>")
        for part in n.texts:
            if isinstance(part, str):
                out.append(html.escape(squeeze(part)))
            else:
                write(part)
        out.append(f"</{n.tag}>")

    write(node)
    return "".join(out)[:limit]


def group_score(group: list[Node]) -> int:
    """Records with a link, with text, and how many; navigation far behind."""
    linked = sum(any(n.tag == "a" and n.attrs.get("href") for n in r.walk()) for r in group)
    said = sum(len(r.text()) >= 4 for r in group)
    return 3 * min(linked, 10) + 2 * min(said, 10) + min(len(group), 20) + (-50 if in_navigation(group[0]) else 15)


def best_groups(root: Node) -> list[list[Node]]:
    """The best GROUPS groups, none of which shares half of its records with a better one."""
    chosen, used = [], set()
    for group in sorted(groups(root), key=lambda g: (group_score(g), len(g)), reverse=True):
        if 2 * sum(id(r) in used for r in group) >= len(group) and any(id(r) in used for r in group):
            continue
        if len(chosen) == GROUPS:
            break
        chosen.append(group)
        used |= {id(r) for r in group}
    return chosen


def sample(text: str | None) -> list[dict]:
    """Up to RECORDS fragments of each of the best groups, CHARS in all."""
    out, left = [], CHARS
    for g, group in enumerate(best_groups(Tree(text or "").root)):
        for i, record in enumerate(group[:RECORDS]):
            piece = fragment(record)
            if len(piece) > left:
                return out
            left -= len(piece)
            out.append({"group_index": g, "record_index": i, "group_size": len(group), "fragment": piece})
    return out


def arguments(text: str) -> list[str] | None:
    """Literals of a call; nothing if any argument is something else."""
    found = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        literal = re.fullmatch(r"""['"]([\w./-]{0,128})['"]|(\d{1,128})""", part)
        if not literal:
            return None
        found.append(literal[1] if literal[1] is not None else literal[2])
    return found


def handler_values(handler: str) -> list[str]:
    """The literal arguments of a handler that calls a function which leads somewhere."""
    call = CALL.match(handler or "")
    if not call or not any(h in call[1].lower() for h in LEADING):
        return []
    return arguments(call[2]) or []


def function_text(script: str, name: str) -> tuple[list[str], str] | None:
    """Parameters and body of a function in a script; its end is found by counting braces."""
    short = re.escape(name.split(".")[-1])
    head = re.search(rf"(?:function\s+{short}\s*|{short}\s*[:=]\s*function\s*)\(([^)]*)\)\s*\{{|{short}\s*=\s*\(([^)]*)\)\s*=>\s*\{{", script)
    if not head:
        return None
    depth, at = 1, head.end()
    while at < len(script) and depth:
        depth += {"{": 1, "}": -1}.get(script[at], 0)
        at += 1
    return [p.strip() for p in (head[1] or head[2] or "").split(",") if p.strip()], script[head.end() : at - 1]


def value_of(expression: str, known: dict[str, str]) -> str | None:
    """A sum of literals, known names and encodeURIComponent of these."""
    out = []
    for part in re.findall(r"""(?:'[^']*'|"[^"]*"|[^+'"])+""", expression.strip().rstrip(");, ") + (")" if expression.count("(") > expression.count(")") else "")):
        part = part.strip()
        encoded = re.fullmatch(r"encodeURIComponent\(\s*([\w.]+)\s*\)?", part)
        literal = re.fullmatch(r"""'([^']*)'|"([^"]*)\"""", part)
        if encoded and encoded[1] in known:
            out.append(quote(known[encoded[1]], safe=""))
        elif literal:
            out.append(literal[1] if literal[1] is not None else literal[2])
        elif part in known:
            out.append(known[part])
        else:
            return None
    return "".join(out) or None


def navigation(node: Node, scripts: str) -> str | None:
    """Where an element leads, as it stands there: its link, a data attribute, or its handler."""
    href = node.attrs.get("href", "").strip()
    if href and not href.startswith("#") and not href.lower().startswith("javascript:"):
        return href
    for name in ("data-href", "data-url", "data-link"):
        if node.attrs.get(name):
            return node.attrs[name]
    handler = node.attrs.get("onclick") or (href if href.lower().startswith("javascript:") else "")
    data = {"this.dataset." + re.sub("-(.)", lambda m: m[1].upper(), k[5:]): v for k, v in node.attrs.items() if k.startswith("data-")}
    if direct := TARGET.search(handler):
        return value_of(direct[1], data)
    call = CALL.match(handler)
    values = arguments(call[2]) if call else None
    found = function_text(scripts, call[1]) if values is not None else None
    if found and (target := TARGET.search(found[1])) and len(found[0]) >= len(values):
        return value_of(target[1], dict(zip(found[0], values, strict=False)))
    return None


def links(text: str | None, base: str) -> list[dict]:
    """Every element that leads somewhere, with its text and the literal arguments of its handler."""
    root = Tree(text or "").root
    scripts = "\n".join(t for n in root.walk() if n.tag == "script" for t in n.texts if isinstance(t, str))
    out = []
    for n in root.walk():
        if n.attrs.get("href") or n.attrs.get("onclick") or any(k in n.attrs for k in ("data-href", "data-url", "data-link")):
            if target := navigation(n, scripts):
                out.append({"place": len(out), "label": n.text(), "target": target, "base": base, "argument": (handler_values(n.attrs.get("onclick", "")) or [None])[-1]})
    return out


def rows_per_document(docs: DataFrame, doc_id: str, body: str, base: str, find, schema: str) -> DataFrame:
    """doc_id and the rows that find(body, base) gives for each document."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(body).alias("body"), F.coalesce(F.col(base), F.lit("")).alias("base"))

    def run(batches):
        import pyarrow as pa

        kinds = {"int": pa.int32(), "string": pa.string()}
        arrow = pa.schema([("doc_id", pa.int64()), *[(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "), strict=True)]])
        for batch in batches:
            out = [{"doc_id": doc, **r} for doc, text, url in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in find(text, url)]
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, f"doc_id bigint, {schema}")


def structure_samples(docs: DataFrame, doc_id: str, body: str) -> DataFrame:
    return rows_per_document(docs, doc_id, body, body, lambda text, _: sample(text), "group_index int, record_index int, group_size int, fragment string")


def document_links(docs: DataFrame, doc_id: str, body: str, base: str) -> DataFrame:
    """(doc_id, place, label, target, argument) of the elements that lead to a web page, numbered within their document."""
    rows = rows_per_document(docs, doc_id, body, base, links, "place int, label string, target string, base string, argument string")
    rows = rows.withColumn("target", urls.canonical(urls.absolute(F.col("base"), F.col("target")))).filter("target IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return rows.select("doc_id", place.alias("place"), "label", "target", "argument")


def volatile_ids(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Ids that look generated: of the form of a UUID, or of a numbered family with several members in the group."""
    stem = F.regexp_extract(value, r"^(.*\D)\d+$", 1)
    family = rows.filter(stem != "").groupBy(group, stem.alias("stem")).agg(F.countDistinct(value).alias("n")).filter("n > 1")
    uuid = F.col(value).rlike("(?i)^" + UUID.pattern + "$")
    return rows.withColumn("stem", stem).join(family, [group, "stem"], "left").filter(uuid | F.col("n").isNotNull()).select(group, value).distinct()
