"""Features of captured responses, as built-in columns: shape, kind, keys, sample, headers, cost and source views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import payloads, urls

#: Words that tell of records, in the order in which they are looked for.
DATA_KEYS = ("title", "subject", "content", "writer", "regdate", "date", "posted", "list", "items", "rows", "total_count", "count", "notice", "board", "zz_title", "zz_end_dt", "zz_jo_num", "article", "post", "job", "recruit", "apply", "deadline")
KEYWORDS = ("공지", "notice", "조회수", "첨부파일", "게시", "board", "title", "subject", "list")
#: Prices of a million tokens in dollars, by provider, and won for a dollar.
PRICES = {"openai": (0.40, 1.60), "gemini": (0.30, 2.50)}
WON = 1350
#: Request headers that a replay leaves out, and headers that no record may keep.
DROPPED_HEADERS = ("cookie", "content-length", "content-encoding", "host", "connection", "accept-encoding", "cache-control")
SENSITIVE_HEADERS = ("authorization", "cookie", "proxy-authorization", "x-api-key", "x-csrf-token", "x-xsrf-token", "csrf-token")
DROPPED_PREFIXES = ("sec-ch-", "sec-fetch-")


def body_shape(body: Column) -> Column:
    """What a body begins with, by its first 120 characters."""
    head = F.trim(F.substring(body, 1, 120))
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "empty")
        .when(head.startswith("{"), "json_object")
        .when(head.startswith("["), "json_array")
        .when(head.startswith("<"), "html")
        .when(head.rlike(r"^[A-Za-z_$][\w.$]*\s*\("), "jsonp_wrapper")
        .when(head.contains("var ") | head.contains("window."), "javascript_bridge")
        .otherwise("textual_other")
    )


def data_key_hits(body: Column, limit: int = 10) -> Column:
    """The first limit words of DATA_KEYS that the body holds."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.slice(F.filter(F.array(*map(F.lit, DATA_KEYS)), lambda k: F.contains(low, k)), 1, limit)


def source_kind(url: Column, resource: Column, method: Column, content_type: Column, shape: Column, hits: Column, has_payload: Column) -> Column:
    """The kind of a response, by the first rule that fits."""
    kind, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(url)
    found, data = F.size(hits) > 0, resource.isin("xhr", "fetch")
    return (
        F.when(low.contains("graphql"), "graphql")
        .when(low.contains("callback=") | (shape == "jsonp_wrapper"), "jsonp_javascript")
        .when((resource == "script") & found, "script_data")
        .when((resource == "document") & (kind.contains("text/html") | (shape == "html")), "document_html")
        .when((shape == "javascript_bridge") & found, "bridge_javascript")
        .when((F.upper(method) == "POST") & has_payload, F.when(kind.contains("json"), "post_json").otherwise("form_post"))
        .when(data, F.when(kind.contains("json"), "xhr_json").when(kind.contains("html"), "xhr_html").otherwise("xhr_other"))
        .otherwise(F.concat(resource, F.lit("_other")))
    )


def informative_sample(body: Column, limit: int = 400, before: int = 120) -> Column:
    """A window of the squeezed body around the first known word of the first kind that it holds, else its start."""
    flat = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))
    low = F.lower(flat)
    place = F.coalesce(*[F.nullif(F.instr(low, k), F.lit(0)) for k in (*KEYWORDS, *DATA_KEYS)], F.lit(1))
    return F.substring(flat, F.greatest(F.lit(1), place - before), F.lit(limit))


def sent_headers(headers: Column) -> Column:
    """A map of headers without those that belong to one connection or browser."""
    def keep(key: Column, _: Column) -> Column:
        k = F.lower(key)
        out = ~k.isin(*DROPPED_HEADERS)
        for p in DROPPED_PREFIXES:
            out = out & ~k.startswith(p)
        return out

    return F.map_filter(headers, keep)


def public_headers(headers: Column) -> Column:
    """A map of headers without credentials."""
    return F.map_filter(headers, lambda key, _: ~F.lower(key).isin(*SENSITIVE_HEADERS))


#: Parts of urls and samples that tell what a candidate isn't, and of urls of old servers.
TELEMETRY_MARKS = ("analytics", "telemetry", "gtm", "google-analytics", "doubleclick", "hotjar", "sentry", "facebook", "pixel", "collect", "beacon", "metrics", "tracking", "hashtag")
OTHER_MARKS = ("airbridge", "/config", "captcha", "/login/", "pcbang-check", "/logos", "/events/web/", "mediacategory", "redirecturl")
ASSET_MARKS = ("jquery", "swiper", "analytics.js", "gtm.js", "ui.common", "language.js", "aos.js")
LEGACY_MARKS = (".fo", ".do", ".data", ".action", ".ajax")


def holds_any(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m))


def noise(c: dict[str, Column]) -> dict[str, Column]:
    """Whether a candidate (api_url, sample, source_kind, data_key_hits, has_repeated_records) looks like telemetry, an asset or no content."""
    records = F.coalesce(c["has_repeated_records"], F.lit(False))
    idle = c["source_kind"].isin("script_other", "document_other") & (F.coalesce(F.size(c["data_key_hits"]), F.lit(0)) <= 0)
    return {
        "looks_like_telemetry": holds_any(c["api_url"], TELEMETRY_MARKS) | (~records & holds_any(c["sample"], TELEMETRY_MARKS)),
        "looks_like_static_asset": F.coalesce(idle, F.lit(False)) | holds_any(c["api_url"], ASSET_MARKS),
        "looks_like_non_content": ~records & holds_any(c["api_url"], OTHER_MARKS),
    }


def features(c: dict[str, Column]) -> Column:
    """The features of a candidate that scoring reads, as a struct.

    c: target_url, api_url, source_kind, resource_type, method, content_type, data_key_hits (array), body_shape, sample, key_count,
    has_callback_param, has_repeated_records, semantic_record_count, title_date_pair_count, has_notice_terms.
    """
    from .text import url_without_query

    authority = lambda url: F.lower(F.coalesce(F.call_function("try_parse_url", url, F.lit("AUTHORITY")), F.lit("")))
    flag = lambda name: F.coalesce(c[name], F.lit(False))
    hits = F.coalesce(c["data_key_hits"], F.array().cast("array<string>"))
    count = lambda key: F.size(F.filter(hits, lambda h: h == key))
    found = {
        "is_exact_target": url_without_query(c["target_url"]) == url_without_query(c["api_url"]),
        "is_same_host": authority(c["target_url"]) == authority(c["api_url"]),
        "is_document_html": c["source_kind"] == "document_html",
        "is_json_like": c["body_shape"].isin("json_object", "json_array") | F.contains(F.lower(c["content_type"]), F.lit("json")),
        "is_jsonp_like": (c["source_kind"] == "jsonp_javascript") | (c["body_shape"] == "jsonp_wrapper"),
        "is_javascript_bridge": c["source_kind"].isin("bridge_javascript", "script_data"),
        "has_callback_param": flag("has_callback_param"),
        "has_title_key": count("title") > 0, "title_key_count": count("title"), "has_date_key": count("date") > 0, "date_key_count": count("date"),
        "has_total_count": count("count") > 0, "has_list_key": count("list") > 0, "data_key_hits_count": F.size(hits),
        **noise(c),
        "legacy_endpoint_hint": holds_any(c["api_url"], LEGACY_MARKS),
        "resource_is_data_channel": c["resource_type"].isin("document", "fetch", "xhr", "script"),
        "is_post": F.upper(F.coalesce(c["method"], F.lit("GET"))) == "POST",
        "sample_length_ok": F.length(F.coalesce(c["sample"], F.lit(""))) >= 80,
        "query_or_body_key_count": F.coalesce(c["key_count"], F.lit(0)),
        "has_repeated_records": flag("has_repeated_records"), "semantic_record_count": F.coalesce(c["semantic_record_count"], F.lit(0)),
        "title_date_pair_count": F.coalesce(c["title_date_pair_count"], F.lit(0)), "has_notice_terms": flag("has_notice_terms"),
    }
    truth = {k: F.coalesce(v, F.lit(False)) if k.startswith(("is_", "has_", "looks_", "legacy_", "resource_", "sample_")) else v for k, v in found.items()}
    return F.struct(*[v.alias(k) for k, v in truth.items()], F.coalesce(c["body_shape"], F.lit("")).alias("body_shape"))


def cost_in_won(provider: str, tokens_in: Column, tokens_out: Column) -> Column:
    a, b = PRICES[provider]
    return (tokens_in * a + tokens_out * b) * (WON / 1e6)


def snake_key(key: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.regexp_replace(key, "(?<=[a-z0-9])(?=[A-Z])", "_")), "-", "_"), "[^a-z0-9_]+", "")


def folded_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^0-9a-z가-힣]+", "")


def evidence_loss(raw: Column, view: Column) -> Column:
    return F.when(raw > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - view) / raw))).otherwise(0.0)


def view_reasons(raw: Column, view: Column, truncated: Column) -> Column:
    """Why a source view must be parsed again: an array, empty if it is ready. raw and view: structs of records, navigation,
    titles and embedded counts."""
    many = raw["records"] >= 2
    severe = F.lit(False)
    for c in ("records", "navigation", "titles"):
        severe = severe | (evidence_loss(raw[c], view[c]) >= 0.5)
    return F.array_compact(F.array(
        F.when(many & (view["records"] == 0), "RECORD_EVIDENCE_LOST"),
        F.when(many & (raw["navigation"] >= 2) & (view["navigation"] == 0), "NAVIGATION_EVIDENCE_LOST"),
        F.when(many & (raw["titles"] >= 2) & (view["titles"] == 0), "FIELD_EVIDENCE_LOST"),
        F.when((raw["embedded"] > 0) & (raw["records"] == 0) & (view["records"] == 0), "EMBEDDED_DATA_NOT_EXPANDED"),
        F.when(truncated & (severe | ((view["records"] == 0) & (view["titles"] == 0))), "VIEW_TRUNCATED"),
    ))


#: Features that are shown to a judge of candidates, and how many keys, hits and characters.
SHOWN = (
    "is_exact_target", "is_same_host", "has_title_key", "has_date_key", "has_list_key", "has_total_count", "has_repeated_records", "semantic_record_count", "title_date_pair_count",
    "has_notice_terms", "looks_like_non_content", "is_json_like", "is_jsonp_like", "legacy_endpoint_hint",
)
SHOWN_KEYS, SHOWN_HITS, SHOWN_CHARS = 10, 8, 240


def compact(payload: Column, features: Column, known: tuple[str, ...], hits: Column, sample: Column) -> Column:
    """What a judge of candidates sees of one: (payload_keys, data_key_hits, feature_summary, sample), all bounded. known: the features' names."""
    keys = F.slice(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), 1, SHOWN_KEYS)
    shown = F.struct(*[(features[n] if n in known else F.lit(None).cast("boolean")).alias(n) for n in SHOWN])
    return F.struct(keys.alias("payload_keys"), F.slice(hits, 1, SHOWN_HITS).alias("data_key_hits"), shown.alias("feature_summary"), F.substring(F.coalesce(sample, F.lit("")), 1, SHOWN_CHARS).alias("sample"))


def in_list_scope(candidates: DataFrame, target_url: Column) -> DataFrame:
    """candidates (api_url, payload, features, ...) limited to the target's recommended posts where it asks for them.

    A changed candidate takes its payload from the new address, loses what described the old response, and is to be stored anew.
    """
    limited = urls.keep_list_filter(target_url, F.coalesce("api_url", F.lit("")))
    rows = candidates.withColumns({"_url": limited, "requested_list_url": F.when(urls.is_recommended_list(target_url), target_url)})
    moved = F.col("_url") != F.coalesce("api_url", F.lit(""))
    stale = [c for c in ("validation_analysis", "features") if c in candidates.columns]
    return rows.withColumns({
        "payload": F.when(moved, payloads.form_json(urls.group(F.col("_url"), 4))).otherwise(F.col("payload")), "api_url": F.when(moved, F.col("_url")).otherwise(F.col("api_url")), "pending_persistence": moved,
        **{c: F.when(~moved, F.col(c)) for c in stale},
    }).drop("_url")
