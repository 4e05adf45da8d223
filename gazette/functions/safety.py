"""Which addresses may be fetched, and what evidence may be kept."""

from __future__ import annotations

import ipaddress
import json
import re
from urllib.parse import urlsplit

from pyspark.sql import Column

from .text import per_value

#: Schemes and ports, and names of secrets.
SCHEMES, PORTS = ("http", "https"), (80, 443)
SECRET = re.compile(r"(?:password|passwd|secret|token|authorization|cookie|session|api[_-]?key)", re.I)
DEPTH, ITEMS, KEYS, CHARS = 6, 10, 100, 500


def public_address(address: str) -> bool:
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    return ip.is_global and not (ip.is_multicast or ip.is_reserved)


def refusal(url: str | None) -> str | None:
    """Why a url may not be fetched, as far as it tells itself; null if it may. Names are to be resolved and checked besides."""
    text = (url or "").strip()
    if not text:
        return "EMPTY"
    if any(ord(c) < 32 for c in url):
        return "CONTROL_CHARACTER"
    try:
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return "MALFORMED"
    host = (parts.hostname or "").rstrip(".")
    if parts.scheme.lower() not in SCHEMES:
        return "SCHEME"
    if parts.username is not None or parts.password is not None:
        return "USERINFO"
    if not host:
        return "HOST"
    if (port or (443 if parts.scheme.lower() == "https" else 80)) not in PORTS:
        return "PORT"
    literal = host.split("%")[0]
    try:
        ipaddress.ip_address(literal)
    except ValueError:
        return None
    return None if public_address(literal) else "ADDRESS"


def redact(value, depth: int = 0):
    """A JSON value within bounds of depth and size, without the values of secrets."""
    if depth > DEPTH:
        return "[DEPTH_LIMIT]"
    if isinstance(value, dict):
        return {k: "[REDACTED]" if SECRET.search(k) else redact(v, depth + 1) for k, v in list(value.items())[:KEYS]}
    if isinstance(value, list):
        return [redact(v, depth + 1) for v in value[:ITEMS]]
    return value[:CHARS] if isinstance(value, str) else value


def without_nulls(value):
    """A JSON value without keys whose value is null; array items stay."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def json_text(function):
    """function of a JSON value as one of JSON texts; what doesn't parse is null."""

    def run(text):
        try:
            return json.dumps(function(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError, RecursionError):
            return None

    return run


def refusals(url: str | Column) -> Column:
    return per_value(refusal)(url)


def redacted_json(body: str | Column) -> Column:
    return per_value(json_text(redact))(body)


def pruned_json(body: str | Column) -> Column:
    return per_value(json_text(without_nulls))(body)
