"""Requests and responses as columns: payloads, canonical JSON and its hashes, charsets, and what counts as text."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import urls

RAW_CHARS = 1000
#: Fixed pattern: the charset of a content type.
CHARSET = r"(?i)charset\s*=\s*['\"]?([^;'\"\s]+)"
#: Fixed pattern: the beginning of a JSON object.
OBJECT = r"^[ \t\r\n]*\{"
#: The kinds of a request whose responses may hold text, ends of addresses of data, and types of text (one as servers misspell it).
TEXT_KINDS = ("document", "fetch", "xhr", "script")
DATA_ENDS = (".fo", ".do", ".data", ".action", ".ajax")
TEXT_TYPES = (
    "text/html", "application/json", "text/json", "application/xml", "text/xml", "text/plain", "application/javascript", "text/javascript", "application/x-javascript",
    "text/x-javascript", "application/graphql-response+json", "javasciprt",
)
#: Bodies of these shapes are kept as candidates.
KEPT_SHAPES = ("json_object", "json_array", "html", "jsonp_wrapper")
#: Bytes of a response: at most, and by default.
MOST_BYTES, USUAL_BYTES = 64 << 20, 5 << 20


def canonical_json(json: Column) -> Column:
    """JSON with sorted keys, without white space and with all letters as they are; null for what doesn't parse."""
    return F.to_json(F.try_parse_json(json))


def json_hash(json: Column) -> Column:
    """SHA-256 of the canonical form: equal for equal values, however they were written."""
    return F.sha2(canonical_json(json), 256)


def quoted(text: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def form_json(payload: Column) -> Column:
    """A form's fields as a JSON object: a text for one value, a list for a repeated name. Null without fields."""

    def written(items: Column) -> Column:
        names = F.array_distinct(F.transform(items, lambda x: x["name"]))
        values = lambda n: F.transform(F.filter(items, lambda x: x["name"] == n), lambda x: x["value"])
        field = lambda n: urls.let(values(n), lambda v: F.concat(quoted(n), F.lit(":"), F.when(F.size(v) == 1, quoted(F.get(v, 0))).otherwise(F.to_json(v))))
        return F.when(F.size(items) > 0, F.concat(F.lit("{"), F.array_join(F.transform(names, field), ","), F.lit("}")))

    return urls.let(urls.query_items(payload), written)


def parsed_payload(payload: Column) -> Column:
    """(kind, body): query_only without a payload, json for a JSON object, form for fields, else raw with its first RAW_CHARS characters."""
    # what doesn't begin as an object is none and isn't parsed, as each failure to parse costs an exception
    is_object = F.when(payload.rlike(OBJECT), F.try_parse_json(payload).isNotNull()).otherwise(False)

    def told(is_object: Column, form: Column) -> Column:
        kind = F.when(F.coalesce(payload, F.lit("")) == "", "query_only").when(is_object, "json").when(form.isNotNull(), "form").otherwise("raw")
        raw = F.concat(F.lit('{"_raw":'), quoted(F.substring(payload, 1, RAW_CHARS)), F.lit("}"))
        return urls.let(kind, lambda kind: F.struct(kind.alias("kind"), F.when(kind == "json", payload).when(kind == "form", form).when(kind == "raw", raw).alias("body")))

    return urls.let(is_object, lambda is_object: urls.let(F.when(~is_object, form_json(payload)), lambda form: told(is_object, form)))


def request_key(method: Column, url: Column, query: Column, body: Column) -> Column:
    """One text for equal requests; query and body are JSON, null for none."""
    part = lambda name, value: F.concat(quoted(F.lit(name)), F.lit(":"), value)
    nothing = F.lit("{}")
    fields = [part("body", F.coalesce(body, nothing)), part("method", quoted(method)), part("query", F.coalesce(query, nothing)), part("url", quoted(url))]
    return canonical_json(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))


def distinct_requests(requests: DataFrame, order: str) -> DataFrame:
    """requests (method, url, query, payload) with kind, body and key: of equal ones the first in order."""
    from ..operators.writes import latest

    rows = requests.withColumn("_p", parsed_payload(F.col("payload"))).withColumns({"kind": F.col("_p.kind"), "body": F.col("_p.body")}).drop("_p")
    return latest(rows.withColumn("key", request_key(F.col("method"), F.col("url"), F.col("query"), F.col("body"))), ["key"], F.col(order))


def charset_of(content_type: Column) -> Column:
    """A content type's charset, utf-8 if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(content_type, CHARSET, 1), F.lit("")), F.lit("utf-8"))


def decoded_body(body: Column, content_type: Column) -> Column:
    """A body's text by its charset; what isn't valid there becomes U+FFFD, an unknown charset counts as utf-8.

    UTF-8 and Latin-1 are built-in; bodies of other charsets alone go through Python's codecs.
    """

    @F.pandas_udf("string")
    def other(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        def one(data, charset):
            if data is None or charset is None:
                return None
            try:
                codec = codecs.lookup(charset).name
                return bytes(data).decode(codec, errors="replace")
            except LookupError:
                return bytes(data).decode("utf-8", errors="replace")

        return pd.Series([one(d, c) for d, c in zip(bodies, charsets, strict=True)], dtype=object)

    charset = F.lower(charset_of(content_type))
    utf, latin = charset.isin("utf-8", "utf8"), charset.isin("iso-8859-1", "latin-1", "latin1")
    odd = ~(utf | latin)
    return F.when(utf, F.make_valid_utf8(body.cast("string"))).when(latin, F.decode(body, "ISO-8859-1")).otherwise(other(F.when(odd, body), F.when(odd, charset)))


def looks_textual(content_type: Column, resource_type: Column, url: Column) -> Column:
    """Whether a response may hold notices as text: of a kind that can, and by its address, its type or the lack of one."""
    low, given = F.lower(url), F.coalesce(content_type, F.lit(""))
    fits = low.rlike(r"\.(?:" + "|".join(e[1:] for e in DATA_ENDS) + ")$") | low.contains("callback=") | (given == "") | holds_any(given, TEXT_TYPES)
    return F.coalesce(resource_type.isin(*TEXT_KINDS) & fits, F.lit(False))


def holds_any(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def keeps_candidate(url: Column, body: Column, shape: Column, has_callback: Column, hits: Column) -> Column:
    """Whether a captured response stays a candidate: without a body, of a shape of records, from a callback or with words of records."""
    return (F.coalesce(body, F.lit("")) == "") | shape.isin(*KEPT_SHAPES) | F.coalesce(has_callback, F.lit(False)) | (F.size(hits) > 0)


def byte_limit(setting: str | None) -> int:
    """The most bytes of a response that a setting allows: a whole number from 1 to MOST_BYTES, else USUAL_BYTES."""
    try:
        wanted = int(setting)
    except (TypeError, ValueError):
        return USUAL_BYTES
    return wanted if 0 < wanted <= MOST_BYTES else USUAL_BYTES


def limit_kind(declared: Column, body: Column, measured: Column, transfer: int, decoded: int) -> Column:
    """Which limit a response breaks first: transfer_declared, decoded_buffered or transfer_measured; null if none."""
    return F.when(declared > transfer, "transfer_declared").when(F.octet_length(body) > decoded, "decoded_buffered").when(F.coalesce(F.when(measured > 0, measured), declared) > transfer, "transfer_measured")


def bare_words(text: Column) -> Column:
    """A text in lower case without anything but letters, digits and _."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\W+", ""))


def without_null_pairs(text: Column) -> Column:
    """A text without pairs of a name and nothing (null, none, nan, undefined), and without the commas that they leave."""
    bare = F.regexp_replace(F.regexp_replace(text, r"""(?iU)["']?\w+["']?\s*[:=]\s*(?:null|none|nan|undefined),?""", ""), ",+", ",")
    return F.trim(F.replace(F.replace(bare, F.lit(",}"), F.lit("}")), F.lit(",]"), F.lit("]")))
