"""Queries of operators.lifecycle, of the features of candidates and of the response checks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import text as T
from ..operators import lifecycle as L
from .registry import AS_OF, FEED_SQL, query, text

NOW = f"TIMESTAMP '{AS_OF}'"


def sent(s):
    """Submissions of every second nation's sites."""
    return s.sites.filter("nation_id % 2 = 0").select("site_id", F.concat(F.lit("https://in.example/"), "site_id").alias("submitted_url"), F.when(F.col("site_id") % 2 == 0, "pending").otherwise("checking").alias("validation_status"))


@query("sites", """SELECT site_id, CASE WHEN hit THEN concat('https://in.example/', site_id) END AS submitted_url, CASE WHEN NOT hit THEN crawl_status WHEN crawl_status = 'active' THEN 'active' ELSE 'pending' END AS crawl_status,
  CASE WHEN hit THEN CASE WHEN site_id % 2 = 0 THEN 'pending' ELSE 'checking' END END AS validation_status, CASE WHEN NOT hit THEN validation_error_code END AS validation_error_code FROM (SELECT *, nation_id % 2 = 0 AS hit FROM sites)""")
def record_submission(s):
    return L.record_submissions(s.sites, sent(s), AS_OF).select("site_id", "submitted_url", "crawl_status", "validation_status", "validation_error_code")


@query("runs sites", """SELECT crawl_run_id, site_id, status, CAST(NULL AS VARCHAR) AS candidate_evidence, CAST(NULL AS BOOLEAN) AS llm_used FROM runs
  UNION ALL SELECT 100000000 + site_id, site_id, 'running', CASE WHEN site_id % 3 = 0 THEN '[1]' ELSE '[]' END, coalesce(CASE WHEN site_id % 4 <> 0 THEN site_id % 4 = 1 END, false) FROM sites""")
def create_crawl_run(s):
    new = s.sites.select((F.col("site_id") + 100000000).alias("crawl_run_id"), "site_id", F.lit("running").alias("status"), F.when(F.col("site_id") % 3 == 0, "[1]").alias("candidate_evidence"), F.when(F.col("site_id") % 4 != 0, F.col("site_id") % 4 == 1).alias("llm_used"))
    return L.create_runs(s.runs, new).select("crawl_run_id", "site_id", "status", "candidate_evidence", "llm_used")


@query("runs", f"""SELECT crawl_run_id, CASE WHEN hit THEN 'success' ELSE status END AS status, CASE WHEN hit THEN NULL ELSE error_code END AS error_code,
  CASE WHEN hit AND crawl_run_id % 4 = 0 THEN 7 ELSE llm_input_tokens END AS llm_input_tokens, CASE WHEN hit AND crawl_run_id % 10 = 0 THEN 'approved' ELSE rule_activation_status END AS rule_activation_status,
  CAST(CASE WHEN hit THEN {NOW} END AS VARCHAR) AS finished_at FROM (SELECT *, crawl_run_id % 2 = 0 AS hit FROM runs)""")
def finish_crawl_run(s):
    n = F.col("crawl_run_id")
    results = s.runs.filter(n % 2 == 0).select(n, F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_code"), F.when(n % 4 == 0, F.lit(7).cast("bigint")).alias("llm_input_tokens"), F.when(n % 10 == 0, "approved").alias("rule_activation_status"))
    out = L.finish_runs(s.runs, results, AS_OF)
    return out.select("crawl_run_id", "status", "error_code", "llm_input_tokens", "rule_activation_status", *text("finished_at"))


@query("runs", f"""SELECT crawl_run_id, CASE WHEN hit THEN 'uncertain' ELSE review_label END AS review_label, CASE WHEN hit THEN concat('note ', site_id) END AS review_notes,
  CASE WHEN hit THEN site_id END AS reviewed_by, CAST(CASE WHEN hit THEN {NOW} END AS VARCHAR) AS reviewed_at FROM (SELECT *, review_label IS NULL AND status = 'failed' AS hit FROM runs)""")
def review_crawl_run(s):
    reviews = s.runs.filter("review_label is null and status = 'failed'").select("crawl_run_id", F.lit("uncertain").alias("review_label"), F.concat(F.lit("note "), "site_id").alias("review_notes"), F.col("site_id").alias("reviewed_by"))
    return L.review_runs(s.runs, reviews, AS_OF).select("crawl_run_id", "review_label", "review_notes", "reviewed_by", *text("reviewed_at"))


@query("sites subscriptions", f"SELECT site_id, CAST(CASE WHEN site_id IN (SELECT site_id FROM subscriptions) THEN {NOW} END AS VARCHAR) AS last_viewed_at FROM sites")
def site_view_time(s):
    return L.mark_viewed(s.sites, s.subscriptions, ["site_id"], AS_OF).select("site_id", *text("last_viewed_at"))


@query("subscriptions", f"SELECT user_id, site_id, CAST(CASE WHEN user_id % 3 = 0 THEN {NOW} ELSE last_viewed_at END AS VARCHAR) AS last_viewed_at, CAST(registration_completed_at AS VARCHAR) AS registration_completed_at FROM subscriptions")
def user_view_time(s):
    out = L.mark_viewed(s.subscriptions, s.subscriptions.filter("user_id % 3 = 0"), ["user_id", "site_id"], AS_OF)
    return out.select("user_id", "site_id", *text("last_viewed_at", "registration_completed_at"))


@query("subscriptions", "SELECT user_id, site_id, CASE WHEN site_id % 2 = 0 THEN NOT notification_enabled ELSE notification_enabled END AS notification_enabled FROM subscriptions")
def toggle_notification(s):
    switches = s.subscriptions.filter("site_id % 2 = 0").select("user_id", "site_id", (~F.col("notification_enabled")).alias("notification_enabled"))
    return L.switch_notifications(s.subscriptions, switches).select("user_id", "site_id", "notification_enabled")


@query("states", "SELECT api_id, CASE WHEN hit THEN observed_hash END AS last_hash, CASE WHEN hit THEN observed_hash ELSE last_processed_hash END AS last_processed_hash, CASE WHEN hit THEN 'success' ELSE processing_status END AS processing_status, CASE WHEN hit THEN 0 ELSE retry_count END AS retry_count FROM (SELECT *, api_id % 3 = 1 AS hit FROM states)")
def api_success(s):
    done = s.states.filter("api_id % 3 = 1").select("api_id", F.col("observed_hash").alias("hash"))
    return L.processed_well(s.states, done, AS_OF).select("api_id", "last_hash", "last_processed_hash", "processing_status", "retry_count")


@query("states sites", """SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(b.api_url, a.api_url) AS api_url, coalesce(b.hash, a.hash) AS hash FROM
  (SELECT site_id, min(api_url) AS api_url, max(observed_hash) AS hash FROM states GROUP BY site_id) AS a FULL JOIN
  (SELECT site_id, CASE WHEN site_id % 2 = 0 THEN concat('https://new.example/', site_id) END AS api_url, CASE WHEN site_id % 3 = 0 THEN 'h9' END AS hash FROM sites) AS b ON a.site_id = b.site_id""")
def save_api(s):
    apis = s.states.groupBy("site_id").agg(F.min("api_url").alias("api_url"), F.max("observed_hash").alias("hash"))
    n = F.col("site_id")
    return L.save_apis(apis, s.sites.select(n.cast("bigint").alias("site_id"), F.when(n % 2 == 0, F.concat(F.lit("https://new.example/"), n)).alias("api_url"), F.when(n % 3 == 0, "h9").alias("hash")))


@query("states", "SELECT api_id, CASE WHEN processing_status = 'failed' THEN concat('{\"v\":', api_id, '}') ELSE extractor_config END AS extractor_config, CASE WHEN processing_status = 'failed' THEN concat('s', api_id % 9) END AS schema_hash FROM states")
def replace_extractor_config(s):
    configs = s.states.filter("processing_status = 'failed'").select("api_id", F.concat(F.lit('{"v":'), "api_id", F.lit("}")).alias("extractor_config"), F.concat(F.lit("s"), F.col("api_id") % 9).alias("schema_hash"), F.lit(0.9).alias("confidence"))
    return L.replace_config(s.states, configs).select("api_id", "extractor_config", "schema_hash")



@query("tokens deliveries", """SELECT 'old' AS state, user_id, device, min(fcm_token) AS fcm_token, min(platform) AS device_type FROM (SELECT user_id, 'd1' AS device, fcm_token, platform, token_id, min(token_id) OVER (PARTITION BY user_id) AS m FROM tokens) WHERE token_id = m AND user_id NOT IN (SELECT token_id % 900 FROM deliveries WHERE status = 'pending') GROUP BY user_id, device
  UNION ALL SELECT 'new', user_id, 'd1', concat('t', max(n)), CASE WHEN user_id IN (SELECT user_id FROM tokens) THEN (SELECT min(t.platform) FROM tokens t WHERE t.token_id = (SELECT min(u.token_id) FROM tokens u WHERE u.user_id = p.user_id)) ELSE NULL END
  FROM (SELECT token_id % 900 AS user_id, 1000000000 + delivery_id AS n FROM deliveries WHERE status = 'pending') AS p GROUP BY user_id""")
def device_token_upsert(s):
    first = s.tokens.groupBy("user_id").agg(F.min_by(F.struct("fcm_token", "platform"), "token_id").alias("t")).select("user_id", F.lit("d1").alias("device_id"), "t.fcm_token", F.col("t.platform").alias("device_type"), F.lit(AS_OF).cast("timestamp_ntz").alias("last_updated_at"))
    seen = s.deliveries.filter("status = 'pending'").select((F.col("token_id") % 900).alias("user_id"), F.lit("d1").alias("device_id"), F.concat(F.lit("t"), F.col("delivery_id") + 1000000000).alias("fcm_token"), F.lit(None).cast("string").alias("device_type"), F.lit(AS_OF).cast("timestamp_ntz").alias("seen_at"))
    out = L.save_devices(first, seen)
    return out.select(F.when(F.col("fcm_token").startswith("t"), "new").otherwise("old").alias("state"), "user_id", F.col("device_id").alias("device"), "fcm_token", "device_type")


@query("tokens deliveries", "SELECT delivery_id, token_id FROM deliveries WHERE token_id NOT IN (SELECT token_id FROM tokens WHERE fcm_token IN (SELECT fcm_token FROM tokens WHERE platform = 'IOS'))")
def invalid_token_cascade(s):
    return L.remove_tokens(s.tokens, s.deliveries, s.tokens.filter("platform = 'IOS'"))[1].select("delivery_id", "token_id")


@query("users", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN concat('n', user_id) ELSE nickname END AS nickname, CASE WHEN user_id % 3 = 0 THEN false ELSE is_notification_enabled END AS is_notification_enabled FROM users")
def save_user_profile(s):
    n = F.col("user_id")
    return L.save_profile(s.users, s.users.select(n, F.when(n % 5 == 0, F.concat(F.lit("n"), n)).alias("nickname"), F.when(n % 3 == 0, False).alias("is_notification_enabled"))).select("user_id", "nickname", "is_notification_enabled")


@query("folders", "SELECT folder_id, user_id, CASE WHEN user_id = 1 THEN concat('new ', folder_id) ELSE folder_name END AS folder_name FROM folders")
def rename_folder(s):
    """User 1 asks for all folders; only their own take the name."""
    return L.rename_folders(s.folders, s.folders.select("folder_id", F.lit(1).alias("user_id"), F.concat(F.lit("new "), "folder_id").alias("folder_name"))).select("folder_id", "user_id", "folder_name")


@query("folders folder_notices", "SELECT folder_id, notice_id FROM folder_notices UNION SELECT folder_id, s_suppkey FROM supplier JOIN folders ON folder_id = 100 + s_nationkey AND user_id = s_suppkey % 3")
def add_folder_notice(s):
    asked = s.supplier.select((F.col("s_nationkey") + 100).alias("folder_id"), F.col("s_suppkey").alias("notice_id"), (F.col("s_suppkey") % 3).alias("user_id"))
    return L.add_owned(s.folder_notices, asked, s.folders, ["folder_id", "notice_id"])


@query("folders folder_notices", "SELECT folder_id, notice_id FROM folder_notices n WHERE NOT EXISTS (SELECT 1 FROM folders f WHERE f.folder_id = n.folder_id AND f.user_id = n.notice_id % 2)")
def remove_folder_notice(s):
    return L.remove_owned(s.folder_notices, s.folder_notices.withColumn("user_id", F.col("notice_id") % 2), s.folders, ["folder_id", "notice_id"])


@query("folders keywords", "SELECT folder_id, keyword FROM keywords UNION SELECT folder_id, folder_name FROM folders WHERE user_id = 2")
def add_folder_keyword(s):
    asked = s.folders.select("folder_id", F.col("folder_name").alias("keyword"), F.lit(2).alias("user_id"))
    return L.add_owned(s.keywords, asked, s.folders, ["folder_id", "keyword"])


@query("folders keywords", "SELECT folder_id, keyword FROM keywords k WHERE NOT (keyword = 'RING' AND folder_id IN (SELECT folder_id FROM folders WHERE user_id = 0))")
def remove_folder_keyword(s):
    return L.remove_owned(s.keywords, s.keywords.filter("keyword = 'RING'").withColumn("user_id", F.lit(0)), s.folders, ["folder_id", "keyword"])


def inquiries(s):
    """One inquiry for each failed run, without a site for every fifth."""
    n = F.col("crawl_run_id")
    new = s.runs.filter("status = 'failed'").select(n.alias("inquiry_id"), (n % 50).alias("user_id"), F.when(n % 5 != 0, F.col("site_id")).alias("site_id"), n.alias("crawl_run_id"), F.concat(F.lit("Q"), n).alias("title"))
    return L.ask(new.limit(0).withColumns({"site_url": F.lit(None).cast("string"), "site_error_code": F.lit(None).cast("string"), "status": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp_ntz")}), new, s.sites, AS_OF)


INQUIRIES = f"SELECT crawl_run_id AS inquiry_id, crawl_run_id % 50 AS user_id, CASE WHEN crawl_run_id % 5 <> 0 THEN r.site_id END AS site_id, concat('Q', crawl_run_id) AS title, site_url, s.validation_error_code AS site_error_code FROM runs r LEFT JOIN sites s ON s.site_id = CASE WHEN crawl_run_id % 5 <> 0 THEN r.site_id END WHERE r.status = 'failed'"


@query("runs sites", f"{INQUIRIES}")
def inquiry_snapshot(s):
    return inquiries(s).select("inquiry_id", "user_id", "site_id", "title", "site_url", "site_error_code")


@query("runs sites", f"SELECT inquiry_id, CASE WHEN user_id = 7 THEN concat('A', inquiry_id) END AS admin_reply, CASE WHEN user_id = 7 THEN 'RESOLVED' ELSE 'PENDING' END AS status FROM ({INQUIRIES})")
def inquiry_reply(s):
    asked = inquiries(s)
    return L.reply(asked, asked.filter("user_id = 7").select("inquiry_id", F.concat(F.lit("A"), "inquiry_id").alias("admin_reply")), AS_OF).select("inquiry_id", "admin_reply", "status")


@query("sites", "SELECT DISTINCT url AS site_url, site_id FROM (SELECT CASE WHEN site_id % 4 = 0 THEN concat(site_url, '?') ELSE site_url END AS url FROM sites) LEFT JOIN sites ON url = site_url")
def site_id_of_url(s):
    asked = s.sites.select(F.when(F.col("site_id") % 4 == 0, F.concat("site_url", F.lit("?"))).otherwise(F.col("site_url")).alias("site_url"))
    return L.lookup(s.sites, asked, "site_url", ["site_id"])


@query("states", "SELECT DISTINCT u AS api_url, last_processed_hash, processing_status, retry_count FROM (SELECT concat('https://a.example/', event_id % 1500) AS u FROM events) LEFT JOIN states ON u = api_url")
def processing_state_of_url(s):
    asked = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").select(F.concat(F.lit("https://a.example/"), F.col("event_id") % 1500).alias("api_url"))
    return L.lookup(s.states, asked, "api_url", ["last_processed_hash", "processing_status", "retry_count"])


@query("users", "SELECT DISTINCT o_custkey AS user_id, nickname, provider, role, max_sites_limit FROM orders LEFT JOIN users ON user_id = o_custkey")
def user_info(s):
    return L.lookup(s.users, s.orders.select(F.col("o_custkey").alias("user_id")), "user_id", ["nickname", "provider", "role", "max_sites_limit"])


@query("keywords", "SELECT p_partkey AS id, 100 + p_partkey % 30 AS folder_id FROM part WHERE 100 + p_partkey % 30 NOT IN (SELECT folder_id FROM keywords) OR EXISTS (SELECT 1 FROM keywords k WHERE k.folder_id = 100 + p_partkey % 30 AND contains(lower(p_name), lower(keyword)))")
def move_to_folder(s):
    moves = s.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 30 + 100).alias("folder_id"))
    return L.move_matches(moves, s.keywords).select("id", "folder_id")


@query("notices subscriptions hidden", f"SELECT s.user_id, n.notice_id, row_number() OVER (PARTITION BY s.user_id ORDER BY n.created_at DESC NULLS LAST, n.notice_id DESC) AS place {FEED_SQL} AND contains(lower(n.title), 'urgent')")
def home_timeline(s):
    from ..operators import reads as R

    return L.home_timeline(R.user_feed(s.notices, s.subscriptions, s.hidden), "Urgent").select("user_id", "notice_id", "place")


MESSAGES = ("크롤링 대기열이 없습니다", "수집된 API 후보가 없습니다.", "API 후보 사전 검증 실패", "검증 API 저장 실패", "other")


@query("sites", f"""SELECT site_id, CASE WHEN validation_error_code IS NOT NULL OR crawl_status IS NULL OR crawl_status NOT IN ('failed', 'blocked') THEN validation_error_code WHEN crawl_status = 'blocked' THEN 'ROBOTS_TXT_BLOCKED' WHEN m LIKE '%대기열%' THEN 'CRAWL_QUEUE_UNAVAILABLE'
  WHEN m LIKE '%수집된 API 후보가 없습니다%' THEN 'NO_NOTICE_SOURCE' WHEN m LIKE '%API 후보 사전 검증%' THEN 'SITE_VALIDATION_FAILED' WHEN m LIKE '%검증 API 저장%' THEN 'DATABASE_ERROR' ELSE 'SITE_REGISTRATION_FAILED' END AS validation_error_code
  FROM (SELECT *, list_extract({list(MESSAGES)}, CAST(site_id // 5 % 5 AS INTEGER) + 1) AS m FROM sites)""")
def error_code_backfill(s):
    sites = s.sites.withColumn("validation_error", F.get(F.array(*map(F.lit, MESSAGES)), F.floor(F.col("site_id") / 5).cast("int") % 5))
    return L.backfill_errors(sites).select("site_id", "validation_error_code")


HEADERS = ("Accept", "Cookie", "Host", "Sec-Fetch-Mode", "sec-ch-ua", "X-XSRF-Token", "csrf-token", "Authorization", "X-Api-Key", "Referer", "Cache-Control")


@query("", f"""SELECT p_partkey AS id, array_to_string(list_filter(h, lambda x: lower(x) NOT IN ('cookie', 'content-length', 'content-encoding', 'host', 'connection', 'accept-encoding', 'cache-control') AND NOT starts_with(lower(x), 'sec-ch-') AND NOT starts_with(lower(x), 'sec-fetch-')), ',') AS sent,
  array_to_string(list_filter(h, lambda x: lower(x) NOT IN ('authorization', 'cookie', 'proxy-authorization', 'x-api-key', 'x-csrf-token', 'x-xsrf-token', 'csrf-token')), ',') AS public FROM (SELECT p_partkey, list_filter({list(HEADERS)}, lambda x: (p_size + length(x)) % 3 <> 0) AS h FROM part)""")
def header_sanitization(s):
    named = F.filter(F.array(*map(F.lit, HEADERS)), lambda x: (F.col("p_size") + F.length(x)) % 3 != 0)
    headers = F.map_from_arrays(named, named)
    return s.part.select(F.col("p_partkey").alias("id"), F.array_join(F.map_keys(C.sent_headers(headers)), ",").alias("sent"), F.array_join(F.map_keys(C.public_headers(headers)), ",").alias("public"))


PAGES = ("ok", "Cloudflare ... Just a moment", "cloudflare turnstile", "just a moment challenge-platform", "에펨코리아 보안 시스템 Turnstile", "Attention Required! | Cloudflare")
URLS = ("https://a.example/x", "https://challenges.cloudflare.com/y", "https://a.example/cdn-cgi/challenge/z", "https://a.example/CDN-CGI/challenge-platform/q")


@query("", f"""SELECT p_partkey AS id, p_size % 9 = 0 OR lower(u) LIKE '%//challenges.cloudflare.com/%' OR lower(u) LIKE '%/cdn-cgi/challenge%' OR p_size % 6 IN (1, 2, 4, 5) AS blocked
  FROM (SELECT *, list_extract({list(URLS)}, CAST(p_partkey % 4 AS INTEGER) + 1) AS u FROM part)""")
def access_blocks(s):
    status = F.when(F.col("p_size") % 9 == 0, 429).when(F.col("p_size") % 9 == 1, None).otherwise(200)
    url, body = F.get(F.array(*map(F.lit, URLS)), (F.col("p_partkey") % 4).cast("int")), F.get(F.array(*map(F.lit, PAGES)), (F.col("p_size") % 6).cast("int"))
    return s.part.select(F.col("p_partkey").alias("id"), T.access_blocked(status, url, body).alias("blocked"))


@query("states", "SELECT api_id, CASE WHEN processing_status IS NULL OR api_id % 7 = 0 OR retry_count = 4 THEN 'failed' WHEN retry_count = 0 THEN 'valid_empty' ELSE 'success' END AS result FROM states")
def result_classification(s):
    status = F.when(F.col("api_id") % 7 == 0, "error").otherwise(F.col("processing_status"))
    return s.states.select("api_id", L.result_state(status, F.when(F.col("retry_count") != 4, F.col("retry_count"))).alias("result"))


@query("", """SELECT event_id AS api_index, api_url, exact AS is_exact_target, host AS is_same_host, telemetry AS looks_like_telemetry, telemetry_sample AS sample_tells, content AS looks_like_non_content, asset AS looks_like_static_asset,
  list_contains(hits, 'title') AS has_title_key, CAST(len(list_filter(hits, lambda x: x = 'date')) AS INTEGER) AS date_key_count, legacy AS legacy_endpoint_hint FROM (
  SELECT *, event_type = 'view' AS exact, event_type <> 'click' AS host, event_type = 'signup' OR (NOT repeated AND event_type = 'click') AS telemetry, event_type = 'click' AS telemetry_sample,
    event_type = 'error' AND NOT repeated AS content, event_id % 4 = 0 AND len(hits) = 0 AS asset, event_type = 'click' AS legacy FROM (
  SELECT *, event_id % 5 = 0 AS repeated, CASE event_id % 3 WHEN 0 THEN ['title', 'date', 'date'] WHEN 1 THEN ['list'] ELSE CAST([] AS VARCHAR[]) END AS hits, CASE event_type WHEN 'view' THEN 'https://a.example/list/?p=1' WHEN 'click' THEN 'https://b.example/x.do' WHEN 'signup' THEN 'https://a.example/pixel' WHEN 'error' THEN 'https://a.example/captcha' ELSE 'https://a.example/o' END AS api_url FROM events))""")
def candidate_features(s):
    e = F.col("event_type")
    n = F.col("event_id")
    url = F.when(e == "view", "https://a.example/list/?p=1").when(e == "click", "https://b.example/x.do").when(e == "signup", "https://a.example/pixel").when(e == "error", "https://a.example/captcha").otherwise("https://a.example/o")
    hits = F.when(n % 3 == 0, F.array(F.lit("title"), F.lit("date"), F.lit("date"))).when(n % 3 == 1, F.array(F.lit("list"))).otherwise(F.array().cast("array<string>"))
    given = {"target_url": F.lit("https://A.example/list"), "api_url": url, "source_kind": F.when(n % 4 == 0, "script_other").otherwise("xhr_json"), "resource_type": F.lit("xhr"), "method": F.lit("get"), "content_type": F.lit("text/html"), "data_key_hits": hits, "body_shape": F.lit("other"), "sample": F.when(e == "click", "a beacon").otherwise("text"), "key_count": F.lit(1), "has_callback_param": F.lit(None).cast("boolean"), "has_repeated_records": n % 5 == 0, "semantic_record_count": F.lit(0), "title_date_pair_count": F.lit(0), "has_notice_terms": F.lit(False)}
    f = C.features(given)
    rows = s.spark.read.parquet(f"{s.sf_dir}/events.parquet").select(n.alias("api_index"), url.alias("api_url"), f.alias("f"), (e == "click").alias("sample_tells"))
    return rows.select("api_index", "api_url", *[F.col("f")[c].alias(c) for c in ("is_exact_target", "is_same_host", "looks_like_telemetry")], "sample_tells", *[F.col("f")[c].alias(c) for c in ("looks_like_non_content", "looks_like_static_asset", "has_title_key", "date_key_count", "legacy_endpoint_hint")])


@query("", """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN strftime(d, '%Y-%m-%dT09:30:00') WHEN 5 THEN strftime(d, '%Y-%m-%d') WHEN 6 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS published
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL 10 YEAR AS d FROM orders)""")
def normal_dates(s):
    """Each order's date, ten years later, in one of eight forms; one of them names no day that exists."""
    d, n = F.add_months(F.col("o_orderdate").cast("date"), 120), F.col("o_orderkey") % 8
    forms = ["yyyy-MM-dd", "yyyy.M.d", "'on 'MMMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'  09:30'", "yy'년 'M'월 'd'일'", "yyyy'.13.'d"]
    shown = F.when(n == 7, (F.unix_seconds(d.cast("timestamp")) * 1000 + 1).cast("string"))
    for i, form in enumerate(forms):
        shown = shown.when(n == i, F.date_format(d, form))
    return s.orders.select(F.col("o_orderkey").alias("id"), T.normal_dates(shown).alias("published"))
