"""What a crawl run leaves behind: one all-or-nothing write of its verified result, and the bookkeeping around it.

A result touches five tables. verdicts() decides once, for each site, whether its result may be stored; every table then takes the rows of
the accepted sites only, by the same anti-join, so that a refused site changes nothing anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import payloads, urls
from . import writes as W
from .lifecycle import changed, finish_runs
from .reads import event_outcomes

#: The form of a stored rule, and the versions that it is stored with.
RULE_FORMAT = "agent_extractor_v1"
RULE_VERSIONS = {"notice_identity_version": 2, "detail_url_base_version": 4, "json_detail_template_version": 1, "json_date_role_version": 1}
#: The version that notices' identities are stored under, and the code of a write that was refused.
IDENTITY_VERSION, REFUSED_CODE, FAILED_CODE = 2, "DATABASE_ERROR", "NOTICE_EXTRACTION_FAILED"
STORED = ("success", "valid_empty")
#: The error of a site whose observation was skipped, unless another is stored.
SKIPPED = {"retry_exhausted": "공지 추출 재시도 횟수를 모두 소진했습니다.", "backoff": "이전 공지 추출 실패로 다음 재시도 시각까지 대기합니다."}


def colliding_sites(matched: DataFrame) -> DataFrame:
    """The sites of which two records would become one notice. matched: match_notices() of records with a record_index.

    Two records collide that update the same notice or are new under the same identity, and a record known by its detail url alone
    collides with any earlier record of that url.
    """
    known = matched.filter("notice_id IS NOT NULL").groupBy("site_id", F.col("notice_id").cast("string").alias("k")).count()
    new = matched.filter("notice_id IS NULL").groupBy("site_id", F.concat_ws(":", "kind", "identity").alias("k")).count()
    first = matched.filter(F.trim("detail_url") != "").groupBy("site_id", F.trim("detail_url").alias("identity")).agg(F.min("record_index").alias("first"))
    later = matched.filter("kind = 'detail_url'").join(first, ["site_id", "identity"]).filter("first < record_index")
    return known.unionByName(new).filter("count > 1").select("site_id").unionByName(later.select("site_id")).distinct()


def verdicts(notices: DataFrame, results: DataFrame, records: DataFrame) -> DataFrame:
    """(site_id, processing_status, refusal) of each result: null, or status, no_records, records or collision."""
    counts = records.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    twice = colliding_sites(W.match_notices(notices, records)).withColumn("twice", F.lit(True))
    rows = results.select("site_id", "processing_status").join(counts, "site_id", "left").join(twice, "site_id", "left").na.fill({"n": 0, "twice": False})
    status = F.col("processing_status")
    refusal = (
        F.when(~F.coalesce(status.isin(*STORED), F.lit(False)), "status").when((status == "success") & (F.col("n") == 0), "no_records")
        .when((status == "valid_empty") & (F.col("n") > 0), "records").when(F.col("twice"), "collision")
    )
    return rows.select("site_id", "processing_status", refusal.alias("refusal"))


def persist(tables: dict[str, DataFrame], results: DataFrame, records: DataFrame, judged: DataFrame, as_of: str, first_id: int) -> dict[str, DataFrame]:
    """The tables after the results of the sites that judged (verdicts()) accepts; those of refused sites stay as they are.

    tables: apis (by site_id), notices, sites, subscriptions, users, tokens, events. results: site_id, api_url, source_hash, processing_status,
    crawl_run_id. In order: the source and its hashes, the notices, their aging out after a success, events for what is
    new, and last the activation, so that a first crawl notifies nobody. judged is read by every table: give it written or checkpointed.
    """
    accepted = judged.filter("refusal IS NULL").select("site_id", "processing_status")
    fine = results.join(accepted.select("site_id"), "site_id", "left_semi")
    hashes = {c: F.col("source_hash") for c in ("last_hash", "last_observed_hash", "last_processed_hash")}
    states = fine.select("site_id", "api_url", *[v.alias(c) for c, v in hashes.items()], "processing_status", F.lit(0).alias("retry_count"), W.instant(as_of).alias("scraped_at"))
    apis = W.upsert(tables["apis"], states, ["site_id"])
    apis = changed(apis, fine.select("site_id"), ["site_id"], lambda g: {c: F.lit(None).cast(apis.schema[c].dataType) for c in ("next_retry_at", "last_error") if c in apis.columns})
    notices = W.upsert_notices(tables["notices"], records.join(accepted.select("site_id"), "site_id", "left_semi"), as_of, first_id)
    succeeded = accepted.filter("processing_status = 'success'").select("site_id", F.lit(True).alias("_done"))
    old = F.col("_done") & F.col("is_active") & (F.col("created_at") < W.instant(as_of) - F.expr(f"INTERVAL {W.MONTHS_KEPT} MONTHS"))
    notices = notices.join(succeeded, "site_id", "left").withColumn("is_active", F.when(old, False).otherwise(F.col("is_active"))).drop("_done")
    new = notices.filter("inserted").join(fine.select("site_id", "crawl_run_id"), "site_id").select("site_id", "crawl_run_id", "notice_id")
    events, deliveries = W.fan_out(new, tables["subscriptions"], tables["users"], tables["tokens"], tables["events"])
    sites, subscriptions = W.activate(tables["sites"], tables["subscriptions"], accepted, as_of)
    return {"apis": apis, "notices": notices, "events": events, "deliveries": deliveries, "sites": sites, "subscriptions": subscriptions}


def completed(results: DataFrame, judged: DataFrame) -> DataFrame:
    """results as they ended: a result that the write refused counts as failed. Fail-closed: so does one without a verdict."""
    verdict = judged.select("site_id", "refusal", F.lit(True).alias("_judged"))
    rows = results.join(verdict, "site_id", "left")
    lost = F.col("processing_status").isin(*STORED) & (F.col("_judged").isNull() | F.col("refusal").isNotNull())
    failed = F.coalesce(lost | ~F.col("processing_status").isin(*STORED), F.lit(True))
    code = F.when(lost, REFUSED_CODE).when(failed, F.coalesce(F.col("error_code") if "error_code" in results.columns else F.lit(None), F.lit(FAILED_CODE)))
    return rows.withColumns({"status": F.when(failed, "failed").otherwise(F.col("processing_status")), "error_code": code}).drop("refusal", "_judged")


def complete(runs: DataFrame, states: DataFrame, sites: DataFrame, ended: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, states, sites) after the completed() results: runs finished; of failed ones the retry is counted and the site failed.

    ended: also api_id, source_hash, extracted_notice_count and the telemetry that finish_runs() takes.
    """
    failed = F.col("status") == "failed"
    telemetry = [c for c in ended.columns if c not in ("site_id", "api_id", "api_url", "source_hash", "processing_status", "status", "error_code", "crawl_run_id")]
    done = ended.select("crawl_run_id", "status", F.col("source_hash").alias("observed_hash"), F.when(~failed, F.col("source_hash")).alias("processed_hash"), "error_code", *telemetry)
    new_runs = finish_runs(runs, done, as_of)
    new_states = W.processing_results(states, ended.filter(failed).select("api_id", "status", F.col("source_hash").alias("observed_hash")), as_of)
    new_sites = changed(sites, ended.filter(failed).select("site_id", "error_code"), ["site_id"], lambda g: {"crawl_status": F.lit("failed"), "validation_error_code": g("error_code")})
    return new_runs, new_states, new_sites


def skipped(sites: DataFrame, subscriptions: DataFrame, decisions: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(sites, subscriptions) of skipped observations (site_id, decision, last_error): an unchanged source counts as a success; one that
    waits for its retry or has none left fails the site, with the stored error or else why it was skipped."""
    sites, subscriptions = W.activate(sites, subscriptions, decisions.filter("decision = 'unchanged'"), as_of)
    failed = decisions.filter(F.col("decision").isin(*SKIPPED)).select("site_id", F.coalesce(F.nullif(F.trim("last_error"), F.lit("")), F.try_element_at(F.create_map(*[F.lit(x) for kv in SKIPPED.items() for x in kv]), "decision")).alias("error"))
    values = lambda g: {"crawl_status": F.lit("failed"), "validation_status": F.lit("valid"), "validation_error_code": F.lit(FAILED_CODE), "validation_error": g("error")}
    return changed(sites, failed, ["site_id"], values), subscriptions


def with_identity_version(config: Column) -> Column:
    """A source's configuration, as JSON, stamped with the version of identities; a newer stamp and a missing configuration stay."""
    stored = F.coalesce(F.get_json_object(config, "$.notice_identity_version").cast("int"), F.lit(0))
    stamped = F.map_concat(
        F.map_filter(F.from_json(config, "map<string,variant>"), lambda k, v: k != "notice_identity_version"),
        F.create_map(F.lit("notice_identity_version"), F.parse_json(F.lit(str(IDENTITY_VERSION)))),
    )
    return F.when(F.nullif(config, F.lit("")).isNull() | (stored >= IDENTITY_VERSION), config).otherwise(F.to_json(stamped))


def apply_result(states: DataFrame, results: DataFrame) -> DataFrame:
    """What an extraction found out about its source (api_id, extractor_config, schema_hash, confidence), where it says anything."""
    return changed(states, results, ["api_id"], lambda g: {c: F.coalesce(g(c), F.col(c) if c in states.columns else F.lit(None)) for c in ("extractor_config", "schema_hash", "confidence") if c in results.columns})


def rollout_allowed(pending: Column, rule_active: Column, enabled: bool, mode: str = "new_sites") -> Column:
    """Whether rules may be learnt for a source: with the switch on, for all, or for new sources and those with an active rule. Any other
    mode allows nothing."""
    if not enabled or mode not in ("all", "new_sites"):
        return F.lit(False)
    return F.lit(True) if mode == "all" else F.coalesce(pending, F.lit(False)) | F.coalesce(rule_active, F.lit(False))


def expectation_met(expected: Column, crawl_status: Column, notices: Column, least: Column) -> Column:
    """Whether a site's registration ended as expected (passed or rejected); null where nothing is expected."""
    passed = crawl_status.isin("success", "unchanged") & (notices >= F.coalesce(least, F.lit(0)))
    rejected = crawl_status.isin("error", "failed", "blocked") & (notices == 0)
    return F.when(expected == "passed", F.coalesce(passed, F.lit(False))).when(expected == "rejected", F.coalesce(rejected, F.lit(False)))


def observed(ended: DataFrame, name: str = "outcome") -> tuple[DataFrame, Observation]:
    """ended with counts that are taken while it is written: after the write, the observation's get has them without a second scan."""
    seen = Observation(name)
    status = F.col("status")
    return ended.observe(seen, F.count(F.lit(1)).alias("results"), *[F.count_if(status == s).alias(s) for s in (*STORED, "failed")], F.count_if(F.col("error_code") == REFUSED_CODE).alias("refused")), seen


def get_or_create_users(users: DataFrame, logins: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(users, found): each login (social_id, provider, email, referrer_code, at) with its user, and whether it made one.

    A new user's id comes from the hash of the social id, so that a replay makes no second one; an id that is taken goes to the next
    free number of the hash. A social id's first login counts. A known referrer's limit grows by one for each new user.
    """
    first = W.latest(logins, ["social_id"], F.col("at"), F.col("email"))
    known = users.select("social_id", F.col("user_id").alias("known_id"))
    rows = first.join(known, "social_id", "left")
    tries = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.xxhash64("social_id", i), F.lit(1 << 52)) + (1 << 52))
    fresh = rows.filter("known_id IS NULL").select("social_id", F.posexplode(tries).alias("turn", "user_id"))
    taken = users.select("user_id")
    fresh = fresh.join(taken, "user_id", "left_anti")
    owner = fresh.groupBy("user_id").agg(F.min(F.struct("turn", "social_id")).alias("o"))
    mine = fresh.join(owner, "user_id").filter(F.col("o.social_id") == F.col("social_id")).groupBy("social_id").agg(F.min_by("user_id", "turn").alias("new_id"))
    found = rows.join(mine, "social_id", "left").select("social_id", F.coalesce("known_id", "new_id").alias("user_id"), F.col("known_id").isNull().alias("created"), "provider", "email", "referrer_code")
    nickname = F.coalesce(F.nullif(F.substring_index("email", "@", 1), F.lit("")), F.lit("User"))
    made = found.filter("created").select("user_id", "social_id", "provider", "email", nickname.alias("nickname"), F.lit(5).alias("max_sites_limit"), F.lit(1000).alias("max_keywords_limit"), W.instant(as_of).alias("created_at"))
    referrals = found.filter("created").select(F.col("referrer_code").try_cast("bigint").alias("referrer_id"), F.col("user_id").alias("referee_id"))
    credited = W.credit_referrals(users, referrals.filter("referrer_id IS NOT NULL"))
    return credited.unionByName(made, allowMissingColumns=True), found.select("social_id", "user_id", "created")


def create_folders(folders: DataFrame, asked: DataFrame, first_id: int) -> DataFrame:
    """New folders (user_id, folder_name, parent_folder_id) behind a user's others; a parent must be that user's own top folder."""
    parents = folders.filter("parent_folder_id IS NULL").select(F.col("folder_id").alias("parent_folder_id"), "user_id", F.lit(True).alias("_fits"))
    rows = asked.join(parents, ["parent_folder_id", "user_id"], "left").filter("parent_folder_id IS NULL OR _fits").drop("_fits")
    last = folders.groupBy("user_id").agg((F.max("sort_order") + 1).alias("_next"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("folder_name", "parent_folder_id"))
    counts = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_i", place).join(counts, "user_id").join(last, "user_id", "left")
    new = rows.select((F.lit(first_id) + F.col("_off") + F.col("_i") - 1).alias("folder_id"), "user_id", "parent_folder_id", "folder_name", (F.coalesce("_next", F.lit(0)) + F.col("_i") - 1).alias("sort_order"))
    return folders.unionByName(new.select(folders.columns))


def own_inquiries(inquiries: DataFrame) -> DataFrame:
    """Each user's inquiries, newest first: with place from 1, by the later id where times are equal."""
    newest = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("created_at"), F.desc("inquiry_id"))
    return inquiries.withColumn("place", F.row_number().over(newest))


def sync_legacy(tables: dict[str, DataFrame], runs: DataFrame, records: DataFrame, as_of: str, first_id: int) -> dict[str, DataFrame]:
    """(notices, events, deliveries) after records of the older extraction: as persist(), but nothing is activated and no source is written.

    runs: (site_id, crawl_run_id). A site with colliding records is left out as a whole. Links are brought into their canonical form.
    """
    rows = records.withColumn("detail_url", urls.canonical(F.col("detail_url")))
    fine = rows.join(colliding_sites(W.match_notices(tables["notices"], rows)), "site_id", "left_anti")
    notices = W.upsert_notices(tables["notices"], fine, as_of, first_id)
    new = notices.filter("inserted").join(runs.select("site_id", "crawl_run_id"), "site_id").select("site_id", "crawl_run_id", "notice_id")
    events, deliveries = W.fan_out(new, tables["subscriptions"], tables["users"], tables["tokens"], tables["events"])
    return {"notices": notices, "events": events, "deliveries": deliveries}


def set_crawl_state(sites: DataFrame, states: DataFrame, as_of: str) -> DataFrame:
    """Sites with a new crawl state (site_id, crawl_status, validation_status, validation_error_code, validation_error); the validation's
    status stays where none is given."""
    return changed(sites, states, ["site_id"], lambda g: {
        "crawl_status": g("crawl_status"), "validation_status": F.coalesce(g("validation_status"), F.col("validation_status")), "validation_error_code": g("validation_error_code"),
        "validation_error": g("validation_error"), "last_validated_at": W.instant(as_of),
    })


def insert_apis(apis: DataFrame, new: DataFrame, first_id: int) -> DataFrame:
    """Sources appended, each with a number of its own: from first_id on in the order of site and url. What new lacks is null."""
    counts = new.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("site_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = new.withColumn("_i", F.row_number().over(Window.partitionBy("site_id").orderBy("api_url"))).join(counts, "site_id")
    rows = numbered.withColumn("api_id", F.lit(first_id) + F.col("_off") + F.col("_i") - 1).drop("_i", "_n", "_off")
    return apis.unionByName(rows, allowMissingColumns=True)


def delivered(deliveries: DataFrame, outbox: DataFrame, outcomes: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(deliveries, outbox) after outcomes (delivery_id, sent, error), one for each delivery: attempts counted, and the events closed whose
    deliveries were touched and are all at an end."""
    failures = outcomes.filter("NOT sent").select("delivery_id", F.coalesce("error", F.lit("")).alias("error"))
    after = W.failed_deliveries(deliveries, failures, as_of).select(deliveries.columns)
    after = changed(after, outcomes.filter("sent").select("delivery_id"), ["delivery_id"], lambda g: {"status": F.lit("sent")})
    touched = after.join(outcomes.select("delivery_id"), "delivery_id", "left_semi").select("event_id").distinct()
    closed = event_outcomes(outbox.join(touched, "event_id", "left_semi"), after).select("event_id", F.col("status").alias("_now"))
    events = outbox.join(closed, "event_id", "left").withColumn("status", F.coalesce("_now", "status")).drop("_now")
    return after.select(deliveries.columns), events.select(outbox.columns)


def remove_device(tokens: DataFrame, gone: DataFrame) -> DataFrame:
    """Tokens without those of the given users' devices (user_id, device_id)."""
    return W.remove(tokens, gone.select("user_id", "device_id").distinct(), ["user_id", "device_id"])


def is_active_rule(config: Column) -> Column:
    """Whether a stored configuration, as JSON, is an approved rule that may be executed."""
    at = lambda path: F.get_json_object(config, path)
    rule = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(config), "$.rule", "variant")).startswith("OBJECT"), F.lit(False))
    return F.coalesce((at("$.format") == RULE_FORMAT) & (at("$.activation.status") == "active"), F.lit(False)) & rule


def active_rule_config(rule: Column, evaluation: Column, origin: Column) -> Column:
    """The configuration that is stored for a rule, as JSON, whose evaluation, as JSON, let it pass; else null."""
    passed = F.coalesce(F.get_json_object(evaluation, "$.decision") == "pass", F.lit(False)) & F.try_parse_json(rule).isNotNull()
    versions = "".join(f',"{name}":{number}' for name, number in RULE_VERSIONS.items())
    head = F.concat(F.lit('{"format":"' + RULE_FORMAT + '","source_type":'), payloads.quoted(F.get_json_object(rule, "$.source_type")), F.lit(',"rule":'), rule)
    return F.when(passed, payloads.canonical_json(F.concat(head, F.lit(',"activation":{"status":"active","evaluated_once":true,"rule_origin":'), payloads.quoted(origin), F.lit(',"evaluation":'), evaluation, F.lit("}" + versions + "}"))))
