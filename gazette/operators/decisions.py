"""Decisions on observations, extraction results and source candidates, as columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_RETRIES = 3
POOL = 4
#: The gates of the rule-only choice.
SINGLE_SCORE, WINNER_SCORE, WINNER_GAP, DATA_GAP = 12, 22, 6, 4
#: The hard gate's policy.
POLICY = {
    "min_extracted_records": 1,
    "min_records_for_coverage_gate": 4,
    "min_coverage_ratio": 0.5,
    "max_extraction_ratio": 1.2,
    "max_missing_title_ratio": 0.25,
    "max_invalid_detail_url_ratio": 0.2,
    "max_invalid_date_ratio": 0.5,
    "max_duplicate_ratio": 0.2,
    "min_baseline_field_count": 2,
    "min_baseline_field_coverage": 0.5,
    "max_field_coverage_drop": 0.2,
}
GATED_FIELDS = ("author", "published_at", "detail_url", "external_id")


def observation(as_of: str) -> Column:
    """unchanged, process, backoff or retry_exhausted; a change of content doesn't reset the retries."""
    seen = F.nullif(F.col("observed_hash"), F.lit(""))
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= F.lit(as_of).cast("timestamp_ntz"))
    return (
        F.when(seen == F.nullif(F.col("last_processed_hash"), F.lit("")), "unchanged")
        .when(F.coalesce("processing_status", F.lit("")) != "failed", "process")
        .when(F.coalesce("retry_count", F.lit(0)) >= MAX_RETRIES, "retry_exhausted")
        .when(due, "process")
        .otherwise("backoff")
    )


def upgraded(decision: Column, version: Column, current: int) -> Column:
    """An unchanged source is processed again if its configuration is of an older version."""
    return F.when((decision == "unchanged") & (F.coalesce(version, F.lit(0)) < current), "process").otherwise(decision)


def ranked(candidates: DataFrame, target: str = "target_id") -> DataFrame:
    """candidates with rank by score, then length, within the target; then by index, as the order is stable."""
    order = Window.partitionBy(target).orderBy(F.desc("score"), F.desc("length"), "api_index")
    return candidates.withColumn("rank", F.row_number().over(order))


def diverse_pool(candidates: DataFrame, size: int = POOL, target: str = "target_id") -> DataFrame:
    """The candidates kept for choosing: the best exact target, the best with records and the best of the same host first,
    then by rank up to size. One pass of windows over each target's candidates."""
    whole = Window.partitionBy(target)
    best = lambda c: F.col("rank") == F.min(F.when(c, F.col("rank"))).over(whole)
    rows = ranked(candidates, target)
    first = F.when(best(F.col("is_exact_target")), 0).when(best(F.col("has_repeated_records")), 1).when(best(F.col("is_same_host") & ~F.col("looks_like_non_content")), 2)
    rows = rows.withColumn("priority", F.coalesce(first, F.lit(3)))
    place = Window.partitionBy(target).orderBy("priority", "rank")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= size)


def choices(candidates: DataFrame, target: str = "target_id") -> DataFrame:
    """accept_rule, defer_to_llm or reject_or_observe_more for each target, from its best candidates."""
    rows = ranked(candidates, target)
    sums = rows.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("has_repeated_records").alias("any_records"),
        F.min_by(F.struct("api_index", "score", "has_repeated_records", "looks_like_telemetry", "looks_like_non_content", "has_title_key", "is_json_like", "has_list_key"), "rank").alias("top"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
    )
    top, gap = F.col("top"), F.col("top.score") - F.col("second")
    records = top["has_repeated_records"]
    structured = top["has_title_key"] & top["is_json_like"] & top["has_list_key"]
    decision = (
        F.when(top["looks_like_telemetry"] | top["looks_like_non_content"], "reject_or_observe_more")
        .when((F.col("n") == 1) & records & (top["score"] >= SINGLE_SCORE), "accept_rule")
        .when((F.col("n") == 1) & records, "defer_to_llm")
        .when(F.col("n") == 1, "reject_or_observe_more")
        .when(records & (top["score"] >= WINNER_SCORE) & (gap >= WINNER_GAP), "accept_rule")
        .when(records & structured & (gap >= DATA_GAP), "accept_rule")
        .when(F.col("any_records"), "defer_to_llm")
        .otherwise("reject_or_observe_more")
    )
    return sums.select(target, top["api_index"].alias("api_index"), top["score"].alias("score"), gap.alias("gap"), decision.alias("decision"))


#: What each kind of source adds to a candidate's score.
SOURCE_BONUS = {"jsonp_javascript": 8, "xhr_json": 8, "post_json": 8, "graphql": 8, "form_post": 6, "bridge_javascript": 6, "script_data": 6, "xhr_html": 5, "document_html": 5}


def score(f: Column, source_kind: Column, api_url: Column) -> Column:
    """The additive score of a struct of features: a sum of conditional terms."""
    points = lambda c, n: F.when(c, n).otherwise(0)
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_BONUS.items() for x in kv]), source_kind), F.lit(0))
    # The points of each feature
    flags = {"looks_like_static_asset": -30, "looks_like_telemetry": -35, "looks_like_non_content": -30, "resource_is_data_channel": 2, "is_exact_target": 24, "is_same_host": 8, "is_post": 1, "is_json_like": 3, "is_jsonp_like": 1, "is_javascript_bridge": 2, "has_callback_param": 1, "legacy_endpoint_hint": 2, "has_title_key": 8, "has_date_key": 5, "has_total_count": 2, "has_list_key": 3, "sample_length_ok": 1, "has_notice_terms": 3}
    records = f["has_repeated_records"]
    total = bonus
    for name, n in flags.items():
        total = total + points(f[name], n)
    total = total + points(f["query_or_body_key_count"] >= 3, 1) + points(f["title_date_pair_count"] >= 2, 8)
    total = total + F.when(records, 30 + F.least(f["semantic_record_count"], F.lit(10))).when(~f["is_exact_target"], -8).otherwise(0)
    total = total + points(~f["is_same_host"] & ~records, -4) + points(f["is_document_html"] & ~records, -6)
    return total + points(source_kind == "script_other", -10) + points(F.lower(api_url).rlike("jquery|min\\.js|bundle|chunk") & ~f["has_title_key"], -12)


def gate(records: DataFrame, baseline: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """The hard gate of each group's extracted records: metrics, reasons (they fail it) and diagnostics (they don't).

    records and baseline have kind and identity (see writes.identities) and the fields; sources has one row per group with
    source_records, rejected, semantic_records and failed.
    """
    p = POLICY
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    got = records.groupBy(group).agg(
        F.count(F.lit(1)).alias("extracted"), (F.count(F.lit(1)) - F.countDistinct("kind", "identity")).alias("duplicates"),
        F.count_if(~F.coalesce(F.col("detail_url").rlike("^(?i)https?://[^/?#]"), F.lit(False))).alias("bad_urls"), F.count_if(~filled("published_at")).alias("bad_dates"),
        *[F.avg(filled(c).cast("int")).alias(f"own_{c}") for c in GATED_FIELDS],
    )
    had = baseline.groupBy(group).agg(F.count(F.lit(1)).alias("baseline"), *[F.count_if(filled(c)).alias(f"n_{c}") for c in GATED_FIELDS], *[F.avg(filled(c).cast("int")).alias(f"base_{c}") for c in GATED_FIELDS])
    rows = sources.join(got, group, "left").join(had, group, "left")
    zero = ["extracted", "duplicates", "bad_urls", "bad_dates", "baseline", *[f"{a}_{c}" for a in ("own", "n", "base") for c in GATED_FIELDS]]
    rows = rows.na.fill(0, zero)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.col("extracted")
    reference = F.greatest(F.when(F.col("baseline") > 0, F.col("baseline")).otherwise(F.col("semantic_records")), F.col("source_records"))
    extraction = ratio(n, F.col("semantic_records"))
    many = F.col("semantic_records") >= p["min_records_for_coverage_gate"]
    reasons = [
        F.when(F.col("failed"), "EXECUTION_FAILED"),
        F.when(n < p["min_extracted_records"], "NO_EXTRACTED_RECORDS"),
        F.when(ratio(F.col("rejected"), F.col("source_records")) > p["max_missing_title_ratio"], "MISSING_TITLES"),
        F.when(ratio(F.col("bad_urls"), n) > p["max_invalid_detail_url_ratio"], "INVALID_DETAIL_URLS"),
        F.when(ratio(F.col("bad_dates"), n) > p["max_invalid_date_ratio"], "INVALID_DATES"),
        F.when(ratio(F.col("duplicates"), n) > p["max_duplicate_ratio"], "DUPLICATE_RECORDS"),
    ]
    for c in GATED_FIELDS:
        worse = (F.col(f"n_{c}") >= p["min_baseline_field_count"]) & (F.col(f"base_{c}") >= p["min_baseline_field_coverage"]) & (F.col(f"base_{c}") - F.col(f"own_{c}") > p["max_field_coverage_drop"])
        reasons.append(F.when(worse, f"FIELD_COVERAGE_REGRESSION_{c.upper()}"))
    diagnostics = [F.when(many & (extraction < p["min_coverage_ratio"]), "COVERAGE_MISMATCH"), F.when(many & (extraction > p["max_extraction_ratio"]), "OVER_EXTRACTION")]
    rows = rows.withColumns({"reasons": F.array_compact(F.array(*reasons)), "diagnostics": F.array_compact(F.array(*diagnostics)), "coverage_ratio": F.round(F.least(F.lit(1.0), ratio(n, reference)), 6), "extraction_ratio": F.round(extraction, 6)})
    return rows.select(group, "extracted", "duplicates", "bad_urls", "bad_dates", "baseline", "coverage_ratio", "extraction_ratio", (F.size("reasons") == 0).alias("passed"), "reasons", "diagnostics")


def shadow_parity(expected: DataFrame, got: DataFrame, group: str, title: str = "title") -> DataFrame:
    """Per group, the titles of one extraction that the other lacks, either way, and those in both."""
    a = expected.select(group, F.lower(F.trim(title)).alias("t"), F.lit(1).alias("x")).distinct()
    b = got.select(group, F.lower(F.trim(title)).alias("t"), F.lit(1).alias("y")).distinct()
    both = a.join(b, [group, "t"], "full_outer")
    return both.groupBy(group).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("common"), F.count_if(F.col("y").isNull()).alias("missing"), F.count_if(F.col("x").isNull()).alias("extra"))


def telemetry(stages: DataFrame, group: str) -> DataFrame:
    """Sums of tokens and cost over stages, and whether any used a model."""
    return stages.groupBy(group).agg(F.sum("llm_input_tokens").alias("input_tokens"), F.sum(F.coalesce("llm_output_tokens", F.lit(0))).alias("output_tokens"), F.round(F.sum("llm_cost").cast("double"), 4).alias("cost"), F.bool_or(F.coalesce(F.col("llm_output_tokens") > 0, F.lit(False))).alias("llm_used"))


def representatives(records: DataFrame, group: str, order: str, limit: int = 6) -> DataFrame:
    """Up to limit records of each group, each once, in this priority: first, last, middle, longest and shortest title,
    most empty fields, quartiles."""
    whole = Window.partitionBy(group)
    at = Window.partitionBy(group).orderBy(order)
    rows = records.withColumns({"i": F.row_number().over(at) - 1, "n": F.count(F.lit(1)).over(whole), "len": F.length("title"), "missing": sum((F.col(c).isNull().cast("int") for c in GATED_FIELDS), F.lit(0))})
    first_where = lambda value: F.min_by("i", F.struct(value, F.col("i"))).over(whole)
    half = lambda k: F.floor(F.col("n") * k / 4)
    marks = [F.lit(0), F.col("n") - 1, half(2), first_where(-F.col("len")), first_where(F.col("len")), first_where(-F.col("missing")), half(1), half(3)]
    rows = rows.withColumns({f"m{k}": m.cast("int") for k, m in enumerate(marks)})
    priority = F.least(*[F.when(F.col("i") == F.col(f"m{k}"), k) for k in range(len(marks))])
    rows = rows.withColumn("priority", priority).filter("priority is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("priority"))).filter(F.col("place") <= limit).drop("n", "len", "missing", *[f"m{k}" for k in range(len(marks))])
