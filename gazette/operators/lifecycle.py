"""Further writes and point reads of the service: crawl runs, submissions, markers, devices, folders, keywords and inquiries.

As in writes: functions from a snapshot and its changes to the next snapshot, with times as parameters. Changes of one key are
resolved by the order that the function states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .writes import instant, insert_new, latest, owned, remove, upsert

#: What a crawl run takes at its end. The first replace what is stored, the others only if given.
RUN_RESULT = ("status", "observed_hash", "processed_hash", "schema_hash", "extracted_notice_count", "error_code", "error_message")
RUN_TELEMETRY = ("llm_used", "llm_input_tokens", "llm_output_tokens", "llm_cost", "agent_stage_telemetry", "rule_activation_status", "rule_activation_reason", "evaluator_decision", "evaluator_confidence")


def changed(state: DataFrame, changes: DataFrame, keys: list[str], values) -> DataFrame:
    """state with values(row of changes) in the rows whose keys are in changes; the others as they are.

    values takes a function from a column's name to that column of changes, and gives the new columns.
    """
    names = [c for c in changes.columns if c not in keys]
    given = changes.select(*keys, F.struct(*[F.col(c) for c in names], F.lit(True).alias("_hit")).alias("_given"))
    hit = F.coalesce(F.col("_given._hit"), F.lit(False))
    new = values(lambda c: F.col("_given")[c])
    rows = state.join(given, keys, "left")
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c) if c in state.columns else F.lit(None)) for c, v in new.items()}).drop("_given")


def record_submissions(sites: DataFrame, submissions: DataFrame, as_of: str) -> DataFrame:
    """Submitted sites (site_id, submitted_url, validation_status) wait for validation; an active one stays active."""
    return changed(sites, submissions, ["site_id"], lambda g: {
        "submitted_url": g("submitted_url"), "crawl_status": F.when(F.col("crawl_status") == "active", "active").otherwise("pending"), "validation_status": g("validation_status"),
        "validation_error_code": F.lit(None).cast("string"), "last_validated_at": instant(as_of),
    })


def create_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Runs appended: no evidence is an empty list, and no model was used unless the run says so."""
    filled = new.withColumns({"candidate_evidence": F.coalesce("candidate_evidence", F.lit("[]")), "llm_used": F.coalesce("llm_used", F.lit(False))})
    return runs.unionByName(filled, allowMissingColumns=True)


def finish_runs(runs: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Runs with the results of (crawl_run_id, ...); of the telemetry only what is given replaces what is stored."""
    kept = [c for c in RUN_TELEMETRY if c in results.columns]
    return changed(runs, results, ["crawl_run_id"], lambda g: {
        **{c: g(c) for c in RUN_RESULT if c in results.columns}, **{c: F.coalesce(g(c), F.col(c)) for c in kept}, "finished_at": instant(as_of),
    })


def review_runs(runs: DataFrame, reviews: DataFrame, as_of: str) -> DataFrame:
    """A person's label, notes and id for runs, for later calibration."""
    return changed(runs, reviews, ["crawl_run_id"], lambda g: {"review_label": g("review_label"), "review_notes": g("review_notes"), "reviewed_by": g("reviewed_by"), "reviewed_at": instant(as_of)})


def mark_viewed(rows: DataFrame, viewed: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """The time of the last view of sites (site_id) or subscriptions (user_id, site_id)."""
    return changed(rows, viewed.select(*keys).distinct(), keys, lambda g: {"last_viewed_at": instant(as_of)})


def switch_notifications(subscriptions: DataFrame, switches: DataFrame) -> DataFrame:
    return changed(subscriptions, switches, ["user_id", "site_id"], lambda g: {"notification_enabled": g("notification_enabled")})


def processed_well(states: DataFrame, done: DataFrame, as_of: str) -> DataFrame:
    """After a success all three hashes are the same one, and the retries start again."""
    return changed(states, done, ["api_id"], lambda g: {
        "last_hash": g("hash"), "last_observed_hash": g("hash"), "last_processed_hash": g("hash"), "processing_status": F.lit("success"), "retry_count": F.lit(0), "next_retry_at": F.lit(None).cast("timestamp_ntz"), "scraped_at": instant(as_of),
    })


def save_apis(apis: DataFrame, changes: DataFrame) -> DataFrame:
    """Update or insert each site's source; what a change leaves out stays as it is."""
    return upsert(apis, changes, ["site_id"], keep_if_null=tuple(c for c in changes.columns if c != "site_id"))


def replace_config(states: DataFrame, configs: DataFrame) -> DataFrame:
    """The extractor's configuration, schema hash and confidence of sources, replaced as a whole."""
    return changed(states, configs, ["api_id"], lambda g: {c: g(c) for c in ("extractor_config", "schema_hash", "confidence")})


def save_devices(tokens: DataFrame, seen: DataFrame) -> DataFrame:
    """One token per user and device: the last one seen (seen_at, then token). A known device keeps its type."""
    last = latest(seen, ["user_id", "device_id"], F.desc("seen_at"), F.desc("fcm_token")).withColumnRenamed("seen_at", "last_updated_at")
    return upsert(tokens, last, ["user_id", "device_id"], keep_old=("device_type",))


def remove_tokens(tokens: DataFrame, deliveries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Invalid tokens (fcm_token) go, and their deliveries with them."""
    dead = tokens.join(gone.select("fcm_token").distinct(), "fcm_token", "left_semi").select("token_id")
    return remove(tokens, dead, ["token_id"]), remove(deliveries, dead, ["token_id"])


def save_profile(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Nickname and notification switch, where given."""
    return changed(users, changes, ["user_id"], lambda g: {c: F.coalesce(g(c), F.col(c)) for c in ("nickname", "is_notification_enabled")})


def rename_folders(folders: DataFrame, names: DataFrame) -> DataFrame:
    """New names (folder_id, user_id, folder_name) of folders that are that user's."""
    return changed(folders, names, ["folder_id", "user_id"], lambda g: {"folder_name": g("folder_name")})


def add_owned(held: DataFrame, rows: DataFrame, folders: DataFrame, keys: list[str]) -> DataFrame:
    """Notices or keywords put into folders of the user who asks; what is there already stays as it is."""
    return insert_new(held, owned(rows, folders).select(held.columns), keys)


def remove_owned(held: DataFrame, rows: DataFrame, folders: DataFrame, keys: list[str]) -> DataFrame:
    """Notices or keywords taken out of folders of the user who asks."""
    return remove(held, owned(rows, folders), keys)


def ask(inquiries: DataFrame, new: DataFrame, sites: DataFrame, as_of: str) -> DataFrame:
    """Inquiries with the site as it is now: later changes of the site don't change them."""
    site = sites.select("site_id", "site_url", F.col("validation_error_code").alias("site_error_code"))
    rows = new.join(site, "site_id", "left").withColumns({"status": F.lit("PENDING"), "created_at": instant(as_of)})
    return inquiries.unionByName(rows, allowMissingColumns=True)


def reply(inquiries: DataFrame, replies: DataFrame, as_of: str) -> DataFrame:
    return changed(inquiries, replies, ["inquiry_id"], lambda g: {"admin_reply": g("admin_reply"), "status": F.lit("RESOLVED"), "replied_at": instant(as_of)})


def lookup(state: DataFrame, asked: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """columns of each asked key; null where the key isn't known. Of a repeated key, the row of the least columns."""
    found = state.groupBy(key).agg(F.min(F.struct(*columns)).alias("_row"))
    return asked.select(key).distinct().join(found, key, "left").select(key, *[F.col("_row")[c].alias(c) for c in columns])


def result_state(status: Column, notices: Column) -> Column:
    """failed, valid_empty or success of an extraction: its status and its number of notices, null without a list."""
    return F.when(status.isNull() | (status == "error") | notices.isNull(), "failed").when(notices == 0, "valid_empty").otherwise("success")


def move_matches(moves: DataFrame, keywords: DataFrame) -> DataFrame:
    """The moves (id, title, folder_id) whose title holds a keyword of the folder, in any case; every one, if the folder has none."""
    words = keywords.select("folder_id", F.lower("keyword").alias("_word")).distinct()
    fits = F.col("_word").isNull() | F.contains(F.lower("title"), F.col("_word"))
    return moves.join(words, "folder_id", "left").filter(fits).select(*moves.columns).distinct()


def home_timeline(feed: DataFrame, needle: str) -> DataFrame:
    """A user's notices of all sites whose title holds needle, newest first (place from 1), by notice_id where times are equal."""
    from pyspark.sql.window import Window

    newest = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("created_at"), F.desc("notice_id"))
    return feed.filter(F.contains(F.lower("title"), F.lit(needle.lower()))).withColumn("place", F.row_number().over(newest))


def backfilled_error(crawl_status: Column, message: Column) -> Column:
    """The error code of a failed or blocked site from its stored message."""
    # The messages' marks and their codes, in this order
    marks = (("대기열", "CRAWL_QUEUE_UNAVAILABLE"), ("수집된 API 후보가 없습니다", "NO_NOTICE_SOURCE"), ("API 후보 사전 검증", "SITE_VALIDATION_FAILED"), ("검증 API 저장", "DATABASE_ERROR"))
    code = F.when(crawl_status == "blocked", "ROBOTS_TXT_BLOCKED")
    for mark, name in marks:
        code = code.when(message.contains(mark), name)
    return code.when(crawl_status == "failed", "SITE_REGISTRATION_FAILED")


def backfill_errors(sites: DataFrame) -> DataFrame:
    """Failed and blocked sites without an error code get one."""
    wanted = F.col("validation_error_code").isNull() & F.col("crawl_status").isin("failed", "blocked")
    return sites.withColumn("validation_error_code", F.when(wanted, backfilled_error(F.col("crawl_status"), F.col("validation_error"))).otherwise(F.col("validation_error_code")))
