"""A declarative rule for JSON documents, checked on the driver and compiled to columns.

A rule names the path of an array of records and, for each field, a path within a record or a template of such paths. It
runs as variant lookups after one explode, so that Spark prunes and fuses it like any other query. One run gives every record with what
became of it and the evidence for it; results() sums the runs of whole documents up, those that fail included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text, urls

FIELDS = ("title", "author", "detail_url", "external_id", "published_at")
PATH = re.compile(r"\$(\.[A-Za-z_가-힣][A-Za-z0-9_가-힣-]*|\[\d+\])*")
SLOT = re.compile(r"\{(\w+)\}")
#: Characters of a value and of a record that are kept as evidence.
VALUE_CHARS, RECORD_CHARS = 1000, 1200
#: What stands for a record without any text, and the names of keys whose values are no evidence.
NO_TEXT = "(visible text 없음)"
SECRET_KEY = r'(?i)("[^"\\]*(?:password|passwd|secret|token|authorization|cookie|session|api[_-]?key)[^"\\]*"\s*:\s*)("(?:[^"\\]|\\.)*"|[^\s",{}\[\]]+)'


@dataclass(frozen=True)
class JsonRule:
    records: str
    paths: dict[str, str]
    templates: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)

    def __post_init__(self):
        for path in (self.records, *self.paths.values(), *(p for _, slots in self.templates.values() for p in slots.values())):
            if not PATH.fullmatch(path):
                raise ValueError(f"not a path: {path}")
        for name in (*self.paths, *self.templates):
            if name not in FIELDS:
                raise ValueError(f"no such field: {name}")
        if set(self.paths) & set(self.templates):
            raise ValueError("a field has a path or a template, not both")
        if "title" not in self.paths:
            raise ValueError("a rule needs the title's path")
        for template, slots in self.templates.values():
            if set(SLOT.findall(template)) != set(slots):
                raise ValueError(f"slots don't fit: {template}")


def filled(template: str, slots: dict[str, Column]) -> Column:
    """The template with its slots percent-encoded; null if any is blank."""
    out, missing = F.lit(template), F.lit(False)
    for name, value in slots.items():
        value = F.trim(value)
        missing = missing | value.isNull() | (value == "")
        out = F.replace(out, F.lit("{" + name + "}"), F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")))
    return F.when(~missing, out)


def squeezed_evidence(value: Column, most: int) -> Column:
    return F.nullif(F.substring(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), 1, most), F.lit(""))


def without_secrets(json: Column) -> Column:
    """JSON text with the plain values of secret keys replaced."""
    return F.regexp_replace(json, SECRET_KEY, '$1"[REDACTED]"')


def run(docs: DataFrame, rule: JsonRule, doc_id: str, body: str, base_url: str) -> DataFrame:
    """Every record of every document: (doc_id, record_index, outcome, evidence_id, source_path, FIELDS, field_values, visible_text).

    outcome is rejected without a title, duplicate where an earlier record of the document has the same identity (the external id,
    else the link, else title and date), else notice. field_values has what stood at each field's path before it was changed, visible_text the
    record itself without secrets, both within bounds. Documents that don't parse or lack the array have no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.try_variant_get(F.try_parse_json(body), rule.records, "array<variant>").alias("records"))
    rows = rows.select("doc_id", F.posexplode("records").alias("record_index", "record"))
    rows = rows.filter(F.schema_of_variant("record").startswith("OBJECT"))
    at = lambda path: F.try_variant_get("record", path, "string")
    values = {name: at(path) for name, path in rule.paths.items()}
    values |= {name: filled(t, {slot: at(path) for slot, path in slots.items()}) for name, (t, slots) in rule.templates.items()}
    none = F.lit(None).cast("string")
    rows = rows.select("doc_id", "record_index", F.to_json("record").alias("record"), *[F.nullif(F.trim(values.get(name, none)), F.lit("")).alias(name) for name in FIELDS])
    raw = F.struct(*[squeezed_evidence(F.col(name), VALUE_CHARS).alias(name) for name in FIELDS])
    shown = F.coalesce(squeezed_evidence(without_secrets(F.col("record")), RECORD_CHARS), F.lit(NO_TEXT))
    rows = rows.select("doc_id", "record_index", raw.alias("field_values"), shown.alias("visible_text"), F.nullif(text.squeezed("title"), F.lit("")).alias("title"), "author", "detail_url", "external_id", "published_at")
    rows = rows.withColumns({"detail_url": urls.canonical(urls.absolute(F.lit(base_url), F.col("detail_url"))), "published_at": text.normal_dates("published_at")})
    content = F.concat_ws("\0", F.lower("title"), F.coalesce("published_at", F.lit("")))
    by = F.when(F.col("external_id").isNotNull(), "external_id").when(F.col("detail_url").isNotNull(), "detail_url").otherwise("content")
    identity = F.struct(by.alias("by"), F.coalesce("external_id", "detail_url", content).alias("value"))
    titled = F.col("title").isNotNull()
    first = F.min("record_index").over(Window.partitionBy("doc_id", titled, identity))
    outcome = F.when(~titled, "rejected").when(F.col("record_index") == first, "notice").otherwise("duplicate")
    rows = rows.withColumn("outcome", outcome)
    evidence = F.concat(F.when(titled, "executed").otherwise("rejected"), F.lit("-record-"), "record_index")
    path = F.concat(F.lit(rule.records), F.lit("["), "record_index", F.lit("]"))
    return rows.select("doc_id", "record_index", "outcome", evidence.alias("evidence_id"), path.alias("source_path"), *FIELDS, "field_values", "visible_text")


def execute(docs: DataFrame, rule: JsonRule, doc_id: str, body: str, base_url: str) -> DataFrame:
    """(doc_id, record_index, FIELDS) of the notices of run()."""
    return run(docs, rule, doc_id, body, base_url).filter("outcome = 'notice'").select("doc_id", "record_index", *FIELDS)


def results(docs: DataFrame, rule: JsonRule, doc_id: str, body: str, base_url: str) -> DataFrame:
    """(doc_id, status, source_records, notices, duplicates, rejected) of each document: success, empty, or failed without the array."""
    found = run(docs, rule, doc_id, body, base_url).groupBy("doc_id").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("notice", "notices"), ("duplicate", "duplicates"), ("rejected", "rejected"))])
    there = F.try_variant_get(F.try_parse_json(body), rule.records, "array<variant>").isNotNull()
    rows = docs.select(F.col(doc_id).alias("doc_id"), there.alias("there")).join(found, "doc_id", "left").na.fill(0, ["notices", "duplicates", "rejected"])
    status = F.when(~F.col("there"), "failed").when(F.col("notices") > 0, "success").otherwise("empty")
    return rows.select("doc_id", status.alias("status"), (F.col("notices") + F.col("duplicates") + F.col("rejected")).alias("source_records"), "notices", "duplicates", "rejected")
