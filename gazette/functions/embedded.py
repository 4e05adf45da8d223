"""JSON that HTML documents carry in scripts: typed data blocks and state that pages assign to variables.

Only strict JSON is read; nothing is evaluated.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import json_records
from .records import Tree

#: Fixed patterns: where a page's state begins.
ASSIGNED = re.compile(r"(?:window|globalThis)(?:\.[A-Za-z_$][\w$]*|\[[\"'][\w$]+[\"']\])\s*=\s*")
PUSHED = re.compile(r"self\.__next_f\.push\(\s*")
PARSED = "JSON.parse("
LARGEST = 5 << 20
BUDGET = 200
DECODER = json.JSONDecoder()


def json_at(source: str, start: int):
    """The JSON value that begins there, if one does."""
    rest = source[start:].lstrip()
    try:
        return DECODER.raw_decode(rest)[0]
    except (ValueError, RecursionError):
        return None


def assigned(source: str):
    """Values assigned to variables, also through JSON.parse of a literal, and arguments pushed by a framework."""
    for found in ASSIGNED.finditer(source):
        at = found.end()
        if source.startswith(PARSED, at):
            literal = json_at(source, at + len(PARSED))
            yield json_at(literal, 0) if isinstance(literal, str) else literal
        else:
            yield json_at(source, at)
    for found in PUSHED.finditer(source):
        yield json_at(source, found.end())


def inner_json(value, budget: list[int], depth: int = 6):
    """JSON inside the strings of a value, BUDGET of them at most."""
    if depth < 0 or budget[0] <= 0:
        return
    if isinstance(value, str):
        start = re.search(r"[\[{]", value)
        if start and (found := json_at(value, start.start())) is not None:
            budget[0] -= 1
            yield found
            yield from inner_json(found, budget, depth - 1)
    elif isinstance(value, (list, dict)):
        for child in value.values() if isinstance(value, dict) else value:
            yield from inner_json(child, budget, depth - 1)


def candidates(html: str):
    """Every value that a document's scripts hold, data blocks first; linked data is left out."""
    scripts = [n for n in Tree(html).root.walk() if n.tag == "script"]
    kind = lambda n: n.attrs.get("type", "").split(";")[0].strip().lower()
    texts = [(kind(n), "".join(t for t in n.texts if isinstance(t, str))) for n in scripts]
    for k, source in texts:
        if k == "application/json" and (value := json_at(source, 0)) is not None:
            yield value
    budget = [BUDGET]
    for k, source in texts:
        if k not in ("application/json", "application/ld+json") and len(source) <= LARGEST:
            for root in filter(None, assigned(source)):
                yield root
                yield from inner_json(root, budget)


def values_of(docs: DataFrame, doc_id: str, body: str, base: str) -> DataFrame:
    """(doc_id, base, bodies): the JSON values of each document's scripts, in their order. Documents without any have no row."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(base), F.lit("")).alias("base"), F.col(body).alias("body"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("bodies", pa.list_(pa.string()))])
        for batch in batches:
            found = [(doc, url, [json.dumps(v, ensure_ascii=False) for v in candidates(text or "")]) for doc, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            found = [f for f in found if f[2]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return rows.mapInArrow(run, "doc_id bigint, base string, bodies array<string>")


def extract_embedded(docs: DataFrame, doc_id: str, body: str, base: str) -> DataFrame:
    """As records.extract, from scripts: of the value with the most records."""
    return json_records.extract_any(values_of(docs, doc_id, body, base)).drop("url", "source_path")
