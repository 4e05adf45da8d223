"""All registered queries of the notice service: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL.

Each query applies an operator to whole views of the test tables (sources.entities). A limit stands only where it is the
feature: queues, top lists and per-group limits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import embedded as E
from ..functions import records as J
from ..functions import safety as S
from ..functions import structure as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.rules import JsonRule, execute
from ..operators import decisions as D
from ..operators import reads as R
from ..operators import writes as W
from ..sources.entities import Source, duckdb_with

AS_OF = "2024-01-20 00:00:00"
ORDERS_AS_OF = "2001-07-01 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    """Registers a function of a Source under its name, with DuckDB SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = f"{duckdb_with(*views.split())} {sql}" if views else sql
        return f

    return add


def text(*columns: str) -> list:
    """Columns as text, as times are compared."""
    return [F.col(c).cast("string").alias(c) for c in columns]


FEED_SQL = """FROM notices n JOIN subscriptions s USING (site_id) WHERE n.is_active
  AND NOT EXISTS (SELECT 1 FROM hidden h WHERE h.user_id = s.user_id AND h.notice_id = n.notice_id)"""
IS_NEW = "coalesce(s.registration_completed_at IS NOT NULL AND n.created_at > s.last_viewed_at, false)"
ORDER = "coalesce(n.published_at, n.created_at, n.scraped_at) DESC NULLS LAST, n.notice_id DESC"


@query("notices subscriptions hidden", f"""SELECT s.user_id, n.notice_id, n.site_id, s.alias, n.title, coalesce(n.author, '') AS author, coalesce(n.detail_url, n.url) AS link,
  coalesce(strftime(n.published_at, '%Y-%m-%dT%H:%M:%S'), '') AS published_at, strftime(n.created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, {IS_NEW} AS is_new {FEED_SQL}""")
def user_feed(s):
    return R.shaped_feed(R.user_feed(s.notices, s.subscriptions, s.hidden))


@query("subscriptions sites notices", """SELECT u.user_id, s.site_id, s.site_url, u.alias,
  CASE WHEN u.registration_completed_at IS NULL THEN false ELSE EXISTS (SELECT 1 FROM notices n WHERE n.site_id = s.site_id AND n.is_active AND n.created_at > u.last_viewed_at) END AS has_new,
  CASE WHEN u.registration_completed_at IS NULL AND coalesce(s.crawl_status, 'active') = 'active' THEN 'pending' ELSE coalesce(s.crawl_status, 'active') END AS crawl_status,
  s.validation_error_code, u.registration_completed_at IS NOT NULL AS registration_completed, u.notification_enabled FROM subscriptions u JOIN sites s ON u.site_id = s.site_id""")
def subscription_status(s):
    return R.subscription_status(s.subscriptions, s.sites, s.notices)


@query("sites notices", """SELECT site_id, site_url, EXISTS (SELECT 1 FROM notices n WHERE n.site_id = sites.site_id AND n.created_at > TIMESTAMP '2001-07-01') AS has_new FROM sites""")
def sites_with_new(s):
    viewed = s.sites.select("site_id", W.instant(ORDERS_AS_OF).alias("last_viewed_at"))
    return R.sites_with_news(s.sites, s.notices, viewed)


@query("sites notices", "SELECT site_url, notice_id, title FROM notices JOIN sites USING (site_id) WHERE is_active")
def notices_by_url(s):
    return R.notices_of_url(s.notices, s.sites).select("site_url", "notice_id", "title")


@query("sites notices", """SELECT site_id, site_url, coalesce((SELECT title FROM notices n WHERE n.site_id = sites.site_id AND is_active ORDER BY coalesce(published_at, created_at, scraped_at) DESC NULLS LAST, notice_id DESC LIMIT 1), '없음') AS title FROM sites""")
def latest_title(s):
    return R.latest_titles(s.notices, s.sites)


@query("sites notices", """SELECT site_id, site_url, count(notice_id) AS n, CASE WHEN count(notice_id) > 0 THEN 'success' ELSE 'empty' END AS status
  FROM sites LEFT JOIN (SELECT * FROM notices WHERE is_active) n USING (site_id) GROUP BY site_id, site_url""")
def stored_notices_status(s):
    return R.stored_notices_status(s.notices, s.sites)


@query("sites subscriptions", "SELECT DISTINCT site_id, site_url FROM sites JOIN subscriptions USING (site_id)")
def crawl_targets(s):
    return R.crawl_targets(s.sites, s.subscriptions)


@query("states sites", "SELECT site_url, api_id, api_url, last_processed_hash, processing_status, retry_count FROM states JOIN sites USING (site_id)")
def api_configs(s):
    return R.api_config(s.states, s.sites).select("site_url", "api_id", "api_url", "last_processed_hash", "processing_status", "retry_count")


@query("states", r"""SELECT api_id, site_id, api_url, extractor_config FROM states WHERE regexp_matches(api_url, '^https?://a[.]example/[0-9]+5$') AND CAST(extractor_config->>'$.k' AS BIGINT) >= 50 AND site_id <> 7
  ORDER BY scraped_at DESC NULLS LAST, api_id DESC LIMIT 5""")
def rule_templates_topk(s):
    return R.rule_templates(s.states, "^https?://a[.]example/[0-9]+5$", "$.k", 50, exclude_site=7)


@query("runs sites", "SELECT crawl_run_id, site_url, status, CAST(started_at AS VARCHAR) AS started_at FROM runs JOIN sites USING (site_id) WHERE review_label IS NULL AND status = 'failed' ORDER BY runs.started_at DESC, crawl_run_id DESC LIMIT 50")
def review_queue_topk(s):
    return R.review_queue(s.runs, s.sites, status="failed").select("crawl_run_id", "site_url", "status", *text("started_at"))


TRACKED = "FROM runs WHERE started_at >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND (rule_activation_status IS NOT NULL OR agent_stage_telemetry <> '[]')"


@query("runs", f"""SELECT count(*) AS tracked_runs, count(*) FILTER (WHERE rule_activation_status = 'approved') AS approved_runs, count(*) FILTER (WHERE rule_activation_status = 'reused') AS reused_runs,
  count(*) FILTER (WHERE rule_activation_status = 'rejected') AS rejected_runs, count(*) FILTER (WHERE rule_activation_status = 'failed') AS failed_runs, count(*) FILTER (WHERE evaluator_decision = 'pass') AS evaluator_passes,
  count(*) FILTER (WHERE evaluator_decision = 'fail') AS evaluator_failures, CAST(coalesce(sum(llm_input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(llm_output_tokens), 0) AS BIGINT) AS output_tokens,
  round(CAST(coalesce(sum(llm_cost), 0) AS DOUBLE), 4) AS cost, count(DISTINCT site_id) AS affected_sites {TRACKED}""")
def rollout_summary(s):
    return R.rollout_summary(s.runs, AS_OF, 48)


@query("runs", f"SELECT crawl_run_id, site_id, status, CAST(llm_cost AS DOUBLE) AS llm_cost, CAST(started_at AS VARCHAR) AS started_at {TRACKED} ORDER BY runs.started_at DESC, crawl_run_id DESC LIMIT 20")
def rollout_recent(s):
    return R.rollout_recent(s.runs, AS_OF, 48).select("crawl_run_id", "site_id", "status", "llm_cost", *text("started_at"))


@query("subscriptions sites runs", """SELECT u.user_id, s.site_id, s.site_url, u.alias AS site_alias, coalesce(s.crawl_status, 'active') AS crawl_status, s.validation_error_code AS site_error_code, r.crawl_run_id, r.status AS crawl_run_status, r.error_code AS crawl_run_error_code,
  CASE WHEN coalesce(s.crawl_status, 'active') IN ('failed', 'blocked') THEN coalesce(s.validation_error_code, r.error_code) ELSE s.validation_error_code END AS error_code
  FROM sites s JOIN subscriptions u ON u.site_id = s.site_id LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, crawl_run_id DESC) = 1) r ON r.site_id = s.site_id""")
def latest_per_site(s):
    return R.site_contexts(s.subscriptions, s.sites, s.runs)


@query("folders folder_notices notices keywords", """, held AS (SELECT f.folder_id, string_agg(notice_id || ':' || title, ',' ORDER BY notice_id) AS held FROM folder_notices f JOIN notices USING (notice_id) GROUP BY 1),
  words AS (SELECT folder_id, string_agg(keyword, ',' ORDER BY keyword) AS words FROM keywords GROUP BY 1), full_ AS (SELECT f.*, coalesce(held, '') AS held, coalesce(words, '') AS words FROM folders f LEFT JOIN held USING (folder_id) LEFT JOIN words USING (folder_id)),
  below AS (SELECT user_id, parent_folder_id AS folder_id, string_agg(folder_id || '=' || folder_name || '[' || held || '](' || words || ')', ';' ORDER BY sort_order, folder_id) AS children FROM full_ WHERE parent_folder_id IS NOT NULL GROUP BY 1, 2)
  SELECT r.user_id, CAST(r.folder_id AS BIGINT) AS folder_id, r.folder_name, r.held, coalesce(children, '') AS children FROM full_ r LEFT JOIN below b ON r.user_id = b.user_id AND r.folder_id = b.folder_id WHERE r.parent_folder_id IS NULL""")
def folder_tree(s):
    tree = R.folder_tree(s.folders, s.folder_notices, s.notices, s.keywords)
    shown = lambda n: F.array_join(F.transform(n, lambda x: F.concat_ws(":", x["notice_id"], x["title"])), ",")
    child = lambda c: F.concat(c["folder_id"].cast("string"), F.lit("="), c["folder_name"], F.lit("["), shown(c["notices"]), F.lit("]("), F.array_join(c["keywords"], ","), F.lit(")"))
    return tree.select("user_id", F.col("folder_id").cast("bigint").alias("folder_id"), "folder_name", shown(F.col("notices")).alias("held"), F.coalesce(F.array_join(F.transform("children", child), ";"), F.lit("")).alias("children"))


@query("folders", "SELECT n_nationkey * 5 AS folder_id, CASE WHEN f.folder_id IS NULL THEN -1 WHEN parent_folder_id IS NULL THEN 0 ELSE 1 END AS depth FROM nation LEFT JOIN folders f ON f.folder_id = n_nationkey * 5")
def folder_depth(s):
    return R.folder_depth(s.folders, s.nation.select((F.col("n_nationkey") * 5).alias("folder_id")))


@query("users subscriptions", "SELECT user_id, nickname, role, coalesce(max_sites_limit, 5) AS max_sites, count(site_id) AS n_sites FROM users LEFT JOIN subscriptions USING (user_id) GROUP BY ALL")
def user_limits(s):
    return R.user_limits(s.users, s.subscriptions)


@query("tokens users", "SELECT token_id, user_id, fcm_token, platform FROM tokens WHERE user_id IN (SELECT user_id FROM users)")
def device_tokens(s):
    return R.device_tokens(s.tokens, s.users)


PENDING = "status = 'pending' OR (status = 'processing' AND updated_at < TIMESTAMP '2024-01-20' - INTERVAL 10 MINUTE)"


@query("outbox", f"SELECT event_id FROM outbox WHERE {PENDING} ORDER BY created_at, event_id LIMIT 100")
def outbox_pending(s):
    return R.pending_events(s.outbox, AS_OF).select("event_id")


@query("deliveries tokens", "SELECT delivery_id, event_id, token_id, attempt_count, fcm_token FROM deliveries JOIN tokens USING (token_id) WHERE status IN ('pending', 'failed') AND attempt_count < 3 AND next_attempt_at <= TIMESTAMP '2024-01-20'")
def ready_deliveries(s):
    return R.ready_deliveries(s.deliveries, s.tokens, AS_OF).select("delivery_id", "event_id", "token_id", "attempt_count", "fcm_token")


@query("outbox deliveries", """SELECT o.event_id, count(delivery_id) AS n, count(delivery_id) FILTER (WHERE d.status = 'sent') AS n_sent, count(delivery_id) FILTER (WHERE d.status IN ('pending', 'failed') AND attempt_count < 3) AS n_again,
  CASE WHEN count(delivery_id) FILTER (WHERE d.status IN ('pending', 'failed') AND attempt_count < 3) > 0 THEN 'pending' WHEN count(delivery_id) FILTER (WHERE d.status = 'sent') > 0 THEN 'sent' ELSE 'cancelled' END AS status
  FROM outbox o LEFT JOIN deliveries d ON d.event_id = o.event_id GROUP BY o.event_id""")
def event_terminal_state(s):
    return R.event_outcomes(s.outbox, s.deliveries)


@query("tokens users", "SELECT trim(fcm_token) AS token, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS user_ids FROM tokens JOIN users USING (user_id) WHERE is_notification_enabled AND nullif(trim(fcm_token), '') IS NOT NULL AND lower(coalesce(platform, '')) = 'ios' GROUP BY 1")
def broadcast_recipients(s):
    return R.recipients(s.tokens, s.users, platform="ios").select("token", F.array_join(F.array_sort(F.transform("user_ids", lambda x: x.cast("string"))), ",").alias("user_ids"))


@query("users", "SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // 500 AS chunk FROM users")
def recipient_chunks(s):
    return R.chunks(s.users.select("user_id"), "user_id", 500)


@query("outbox subscriptions users", "SELECT event_id, o.status, user_id, site_id, alias, s.notification_enabled, nickname, is_notification_enabled FROM outbox o JOIN subscriptions s USING (subscription_id) JOIN users USING (user_id)")
def notification_contexts(s):
    return R.notification_contexts(s.outbox, s.subscriptions, s.users).drop("subscription_id")


@query("subscriptions sites", "SELECT user_id, site_id, CASE WHEN validation_error_code IN ('NO_NOTICE_SOURCE', 'NOTICE_EXTRACTION_FAILED') THEN 'SITE_VALIDATION_FAILED' ELSE validation_error_code END AS public_code FROM subscriptions JOIN sites USING (site_id)")
def public_error_codes(s):
    return R.public_errors(s.subscriptions.join(s.sites, "site_id")).select("user_id", "site_id", "public_code")


@query("notices subscriptions hidden", f"SELECT s.user_id, s.alias AS label, string_agg(CAST(n.notice_id AS VARCHAR), ',' ORDER BY {ORDER}) AS notice_ids, bool_or({IS_NEW}) AS has_new {FEED_SQL} GROUP BY 1, 2")
def feed_grouped(s):
    rows = R.grouped_feed(R.user_feed(s.notices, s.subscriptions, s.hidden))
    return rows.select("user_id", "label", F.array_join(F.transform("notice_ids", lambda x: x.cast("string")), ",").alias("notice_ids"), "has_new")


@query("notices subscriptions hidden", f"SELECT user_id, site_id, notice_id, place FROM (SELECT s.user_id, n.site_id, n.notice_id, row_number() OVER (PARTITION BY s.user_id, n.site_id ORDER BY {ORDER}) AS place {FEED_SQL}) WHERE place <= 3")
def display_limit_count(s):
    return R.first_per_group(R.user_feed(s.notices, s.subscriptions, s.hidden), 3, ["user_id", "site_id"]).select("user_id", "site_id", "notice_id", F.col("place").cast("bigint").alias("place"))


@query("notices subscriptions hidden", f"SELECT s.user_id, n.notice_id {FEED_SQL} AND (coalesce(n.published_at, n.created_at) IS NULL OR coalesce(n.published_at, n.created_at) >= TIMESTAMP '1999-01-01')")
def display_limit_date(s):
    return R.since(R.user_feed(s.notices, s.subscriptions, s.hidden), "1999-01-01").select("user_id", "notice_id")


@query("notices subscriptions hidden", f"SELECT s.user_id, n.notice_id, coalesce(n.author, 'Unknown') AS author, strftime(coalesce(n.published_at, n.created_at), '%Y-%m-%d') AS shown_date {FEED_SQL}")
def display_format(s):
    return R.display(R.user_feed(s.notices, s.subscriptions, s.hidden))


@query("keywords folder_notices", "SELECT DISTINCT folder_id, p_partkey AS id FROM part JOIN keywords ON contains(lower(p_name), lower(keyword)) WHERE NOT EXISTS (SELECT 1 FROM folder_notices h WHERE h.folder_id = keywords.folder_id AND h.notice_id = p_partkey)")
def keyword_categorize(s):
    return R.categorize(s.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), s.keywords, s.folder_notices)


@query("", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def text_search(s):
    return R.text_search(s.documents.select("doc_id", "text"), "tion the", "text").select("doc_id")


@query("folders folder_notices notices", """SELECT CAST(r.folder_id AS BIGINT) AS folder_id FROM folders r WHERE parent_folder_id IS NULL AND EXISTS (SELECT 1 FROM folders c JOIN folder_notices h ON h.folder_id = c.folder_id JOIN notices n USING (notice_id)
  WHERE (c.folder_id = r.folder_id OR (c.parent_folder_id = r.folder_id AND c.user_id = r.user_id)) AND contains(lower(title), 'notice 3'))""")
def folder_search(s):
    tree = R.folder_tree(s.folders, s.folder_notices, s.notices, s.keywords)
    return R.folder_search(tree, "NOTICE 3").select(F.col("folder_id").cast("bigint").alias("folder_id"))


CHANGED = "SELECT site_id, concat(site_url, CASE WHEN site_id % 2 = 0 THEN '' ELSE '/new' END) AS site_url, 'pending' AS crawl_status FROM sites WHERE site_id % 3 = 0"


@query("sites", f", changes AS (SELECT *, CAST(NULL AS VARCHAR) AS validation_error_code FROM ({CHANGED}) UNION ALL SELECT 10000000, 'https://added.example', 'pending', 'NEW') SELECT coalesce(c.site_id, s.site_id) AS site_id, coalesce(s.site_url, c.site_url) AS site_url, CASE WHEN c.site_id IS NULL THEN s.crawl_status ELSE c.crawl_status END AS crawl_status, coalesce(c.validation_error_code, s.validation_error_code) AS validation_error_code FROM sites s FULL JOIN changes c ON s.site_id = c.site_id")
def upsert_site(s):
    """First url wins, a null error changes nothing."""
    sites = s.sites
    changes = sites.filter("site_id % 3 = 0").select("site_id", F.expr("concat(site_url, CASE WHEN site_id % 2 = 0 THEN '' ELSE '/new' END)").alias("site_url"), F.lit("pending").alias("crawl_status"), F.lit(None).cast("string").alias("validation_error_code"))
    changes = changes.unionByName(s.spark.sql("SELECT 10000000L AS site_id, 'https://added.example' AS site_url, 'pending' AS crawl_status, 'NEW' AS validation_error_code"))
    return W.upsert(sites.drop("nation_id"), changes, ["site_id"], keep_old=("site_url",), keep_if_null=("validation_error_code",))


@query("notices", "SELECT notice_id, is_active AND NOT created_at < TIMESTAMP '2001-07-01' - INTERVAL 3 MONTH AS is_active FROM notices")
def age_out(s):
    return W.age_out(s.notices, ORDERS_AS_OF).select("notice_id", "is_active")


@query("sites", "SELECT site_id, CASE WHEN site_id % 2 = 0 THEN 'active' ELSE crawl_status END AS crawl_status, CASE WHEN site_id % 2 = 0 THEN NULL ELSE validation_error_code END AS validation_error_code FROM sites")
def activate_sites(s):
    return W.activate(s.sites, s.subscriptions, s.sites.filter("site_id % 2 = 0"), AS_OF)[0].select("site_id", "crawl_status", "validation_error_code")


@query("subscriptions", "SELECT subscription_id, CAST(CASE WHEN site_id % 2 = 0 AND registration_completed_at IS NULL THEN TIMESTAMP '2024-01-20' ELSE registration_completed_at END AS VARCHAR) AS registration_completed_at FROM subscriptions")
def activate_subscriptions(s):
    return W.activate(s.sites, s.subscriptions, s.sites.filter("site_id % 2 = 0"), AS_OF)[1].select("subscription_id", *text("registration_completed_at"))


@query("subscriptions users sites", """, requests AS (SELECT user_id, user_id % greatest((SELECT count(*) FROM supplier), 1) AS site_id, 'mine' AS alias FROM users)
  SELECT coalesce(s.user_id, r.user_id) AS user_id, coalesce(s.site_id, r.site_id) AS site_id, coalesce(r.alias, s.alias) AS alias,
  CASE WHEN s.user_id IS NOT NULL THEN s.registration_completed_at IS NOT NULL ELSE coalesce(t.crawl_status, 'active') = 'active' END AS completed
  FROM subscriptions s FULL JOIN requests r ON s.user_id = r.user_id AND s.site_id = r.site_id LEFT JOIN sites t ON t.site_id = r.site_id""")
def subscribe_upsert(s):
    requests = s.users.join(s.n_sites).select("user_id", F.expr("user_id % greatest(n, 1)").alias("site_id"), F.lit("mine").alias("alias"))
    return W.subscribe(s.subscriptions, requests, s.sites, AS_OF).select("user_id", "site_id", "alias", F.col("registration_completed_at").isNotNull().alias("completed"))


@query("hidden", "SELECT user_id, notice_id FROM hidden UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def hide_dedup(s):
    rows = s.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("notice_id"))
    return W.insert_new(s.hidden, rows, ["user_id", "notice_id"])


@query("subscriptions", "SELECT user_id, site_id FROM subscriptions WHERE site_id % 3 <> 0")
def unsubscribe(s):
    return W.remove(s.subscriptions, s.sites.filter("site_id % 3 = 0").join(s.subscriptions.select("user_id", "site_id"), "site_id"), ["user_id", "site_id"]).select("user_id", "site_id")


@query("folders", "SELECT folder_id, CASE WHEN user_id = 0 AND folder_id = 115 THEN 0 WHEN user_id = 0 AND folder_id = 103 THEN 1 WHEN user_id = 0 AND folder_id = 100 THEN 2 ELSE sort_order END AS sort_order FROM folders")
def reorder_folders(s):
    return W.reorder_folders(s.folders, 0, [115, 103, 100]).select("folder_id", F.col("sort_order").cast("int").alias("sort_order"))


@query("folders", "SELECT folder_id FROM folders WHERE NOT (folder_id = 1 OR (parent_folder_id IS NOT NULL AND parent_folder_id = 1))")
def delete_folder_cascade(s):
    gone = s.spark.sql("SELECT 1 AS folder_id, 1 AS user_id UNION ALL SELECT 2, 0")
    return W.delete_folders(s.folders, s.folder_notices, s.keywords, gone)["folders"].select("folder_id")


@query("states", """, after AS (SELECT *, CASE WHEN api_id % 3 = 0 THEN 'failed' WHEN api_id % 3 = 1 THEN 'success' END AS now_status FROM states)
  SELECT api_id, coalesce(now_status, processing_status) AS processing_status, CASE WHEN now_status = 'failed' THEN retry_count + 1 WHEN now_status IS NOT NULL THEN 0 ELSE retry_count END AS retry_count,
  CAST(CASE WHEN now_status = 'failed' THEN TIMESTAMP '2024-01-20' + least(1440, 5 * CAST(power(2, least(retry_count, 8)) AS BIGINT)) * INTERVAL 1 MINUTE WHEN now_status IS NOT NULL THEN NULL ELSE next_retry_at END AS VARCHAR) AS next_retry_at,
  CASE WHEN now_status = 'success' THEN observed_hash ELSE last_processed_hash END AS last_processed_hash FROM after""")
def retry_backoff(s):
    results = s.states.filter("api_id % 3 < 2").select("api_id", F.expr("CASE WHEN api_id % 3 = 0 THEN 'failed' ELSE 'success' END").alias("status"), "observed_hash")
    return W.processing_results(s.states, results, AS_OF).select("api_id", "processing_status", F.col("retry_count").cast("bigint").alias("retry_count"), *text("next_retry_at"), "last_processed_hash")


DECISION = """CASE WHEN observed_hash = last_processed_hash THEN 'unchanged' WHEN coalesce(processing_status, '') <> 'failed' THEN 'process' WHEN retry_count >= 3 THEN 'retry_exhausted'
  WHEN next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20' THEN 'process' ELSE 'backoff' END"""


@query("states", f"SELECT api_id, {DECISION} AS decision, CASE WHEN {DECISION} = 'unchanged' AND api_id % 4 < 2 THEN 'process' ELSE {DECISION} END AS upgraded FROM states")
def observation_decision(s):
    decision = D.observation(AS_OF)
    return s.states.select("api_id", decision.alias("decision"), D.upgraded(decision, F.col("api_id") % 4, 2).alias("upgraded"))


@query("deliveries", """SELECT delivery_id, CASE WHEN delivery_id % 4 = 1 THEN attempt_count + 1 ELSE attempt_count END AS attempt_count, CASE WHEN delivery_id % 4 = 1 THEN 'failed' ELSE status END AS status,
  CAST(CASE WHEN delivery_id % 4 = 1 THEN TIMESTAMP '2024-01-20' + 60 * CAST(power(2, attempt_count) AS BIGINT) * INTERVAL 1 SECOND ELSE next_attempt_at END AS VARCHAR) AS next_attempt_at FROM deliveries""")
def delivery_backoff(s):
    failures = s.deliveries.filter("delivery_id % 4 = 1").select("delivery_id", F.lit("unreachable").alias("error"))
    return W.failed_deliveries(s.deliveries, failures, AS_OF).select("delivery_id", F.col("attempt_count").cast("bigint").alias("attempt_count"), "status", *text("next_attempt_at"))


@query("outbox", f", mine AS (SELECT event_id FROM outbox WHERE {PENDING} ORDER BY created_at, event_id LIMIT 100) SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM mine) THEN 'processing' ELSE status END AS status FROM outbox")
def claim_events(s):
    return W.claim_events(s.outbox, AS_OF).select("event_id", "status")


@query("deliveries outbox", "SELECT delivery_id, CASE WHEN event_id IN (SELECT event_id FROM outbox WHERE status = 'failed') AND status <> 'sent' THEN 'cancelled' ELSE status END AS status FROM deliveries")
def cancel_deliveries(s):
    return W.cancel_events(s.outbox, s.deliveries, s.outbox.filter("status = 'failed'"), AS_OF)[1].select("delivery_id", "status")


#: Observed records: some update by external id, some by detail url, the rest are new.
RECORDS = """SELECT site_id, concat('again ', notice_id) AS title, author, url, CASE WHEN notice_id % 2 = 0 THEN external_id END AS external_id,
  CASE WHEN notice_id % 5 < 3 THEN detail_url ELSE concat('https://new.example/', notice_id) END AS detail_url, published_at FROM {notices} WHERE notice_id % 10 = 4 OR notice_id % 10 = 1"""


@query("notices", f""", records AS ({RECORDS.format(notices="notices")}), found AS (SELECT r.*, coalesce(a.notice_id, b.notice_id) AS hit FROM records r
  LEFT JOIN notices a ON r.external_id IS NOT NULL AND a.site_id = r.site_id AND a.external_id = r.external_id LEFT JOIN notices b ON r.external_id IS NULL AND b.site_id = r.site_id AND b.detail_url = r.detail_url)
  SELECT n.site_id, coalesce(f.title, n.title) AS title, coalesce(f.detail_url, n.detail_url) AS detail_url, n.external_id, CASE WHEN f.hit IS NOT NULL THEN false END AS inserted FROM notices n LEFT JOIN found f ON f.hit = n.notice_id
  UNION ALL SELECT site_id, title, detail_url, external_id, true FROM found WHERE hit IS NULL""")
def notice_identity_upsert(s):
    records = s.spark.sql(RECORDS, notices=s.notices)
    out = W.upsert_notices(s.notices, records, AS_OF, first_id=1_000_000_000)
    return out.select("site_id", "title", "detail_url", "external_id", "inserted")


@query("observations", """SELECT l_orderkey, l_linenumber, price, coalesce(external_id, detail_url, title) AS k FROM observations QUALIFY row_number() OVER (PARTITION BY l_orderkey, coalesce(external_id, detail_url, title) ORDER BY l_partkey, site_id, price) = 1""")
def identity_dedup(s):
    rows = s.observations.withColumn("url", F.lit("")).withColumn("_order", F.struct("l_partkey", "site_id", "price"))
    # titles repeat with equal authors and dates only here, so the title stands for the content identity
    rows = rows.withColumns({"author": F.lit(""), "published_at": F.lit(None).cast("timestamp_ntz")})
    return W.first_of_identity(rows, ["l_orderkey"], "_order").select("l_orderkey", "l_linenumber", "price", F.coalesce("external_id", "detail_url", "title").alias("k"))


@query("observations", "SELECT site_id * 10000000 + l_orderkey AS notice_id, count(*) AS records FROM observations GROUP BY 1 HAVING count(*) > 1")
def identity_collisions(s):
    return W.collisions(s.observations.select((F.col("site_id") * 10000000 + F.col("l_orderkey")).alias("notice_id")))


NEW = "SELECT site_id, notice_id % 3 AS crawl_run_id, notice_id FROM {notices} WHERE created_at > TIMESTAMP '2001-06-01'"


@query("notices subscriptions users outbox", f""", new_ AS ({NEW.format(notices="notices")}), ids AS (SELECT site_id, crawl_run_id, string_agg(CAST(notice_id AS VARCHAR), ',' ORDER BY notice_id) AS new_notice_ids, count(DISTINCT notice_id) AS new_notice_count FROM new_ GROUP BY 1, 2)
  SELECT subscription_id, crawl_run_id, new_notice_ids, new_notice_count FROM ids JOIN subscriptions s USING (site_id) JOIN users u USING (user_id)
  WHERE registration_completed_at IS NOT NULL AND notification_enabled AND is_notification_enabled AND NOT EXISTS (SELECT 1 FROM outbox o WHERE o.subscription_id = s.subscription_id AND o.crawl_run_id = ids.crawl_run_id)""")
def event_fanout(s):
    new = s.spark.sql(NEW, notices=s.notices)
    rows = W.fan_out(new, s.subscriptions, s.users, s.tokens, s.outbox)[0]
    return rows.select("subscription_id", "crawl_run_id", F.array_join(F.transform("new_notice_ids", lambda x: x.cast("string")), ",").alias("new_notice_ids"), F.col("new_notice_count").cast("bigint").alias("new_notice_count"))


@query("notices subscriptions users tokens outbox", f""", new_ AS ({NEW.format(notices="notices")}) SELECT DISTINCT subscription_id, crawl_run_id, token_id FROM (SELECT DISTINCT site_id, crawl_run_id FROM new_) i JOIN subscriptions s USING (site_id) JOIN users u USING (user_id) JOIN tokens t USING (user_id)
  WHERE registration_completed_at IS NOT NULL AND notification_enabled AND is_notification_enabled AND NOT EXISTS (SELECT 1 FROM outbox o WHERE o.subscription_id = s.subscription_id AND o.crawl_run_id = i.crawl_run_id)""")
def delivery_fanout(s):
    return W.fan_out(s.spark.sql(NEW, notices=s.notices), s.subscriptions, s.users, s.tokens, s.outbox)[1]


@query("users subscriptions hidden", "SELECT 'subscriptions' AS name, user_id, site_id AS other_id FROM subscriptions WHERE user_id % 10 <> 0 UNION ALL SELECT 'hidden', user_id, notice_id FROM hidden WHERE user_id % 10 <> 0 UNION ALL SELECT 'users', user_id, NULL FROM users WHERE user_id % 10 <> 0")
def cascade_delete_user(s):
    """The rows that are left, with their table's name."""
    left = W.delete_users(s.users, s.users.filter("user_id % 10 = 0"), {"subscriptions": s.subscriptions, "hidden": s.hidden})
    other = {"users": F.lit(None), "subscriptions": F.col("site_id"), "hidden": F.col("notice_id")}
    rows = [t.select(F.lit(name).alias("name"), "user_id", other[name].cast("bigint").alias("other_id")) for name, t in left.items()]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


@query("users", "SELECT user_id, CASE WHEN r.n > 0 THEN coalesce(max_sites_limit, 5) + r.n ELSE max_sites_limit END AS max_sites_limit FROM users LEFT JOIN (SELECT referrer_id, count(*) AS n FROM users WHERE referrer_id <> user_id GROUP BY 1) r ON r.referrer_id = user_id")
def referral_credit(s):
    return W.credit_referrals(s.users, s.users.select("referrer_id", F.col("user_id").alias("referee_id"))).select("user_id", F.col("max_sites_limit").cast("bigint").alias("max_sites_limit"))


@query("subscriptions sites", "SELECT subscription_id, s.registration_completed_at IS NOT NULL OR coalesce(t.crawl_status, 'active') = 'active' AND t.site_id IS NOT NULL AS completed FROM subscriptions s LEFT JOIN sites t USING (site_id)")
def baseline_backfill(s):
    return W.open_baselines(s.subscriptions, s.sites, AS_OF).select("subscription_id", F.col("registration_completed_at").isNotNull().alias("completed"))


@query("", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(s):
    return s.documents.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("", "WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT a.doc_id, a.h = b.h AS same_as_before FROM h a JOIN h b ON b.doc_id = a.doc_id - 1")
def content_hash_changes(s):
    now = s.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    before = now.select((F.col("doc_id") + 1).alias("doc_id"), F.col("h").alias("b"))
    return now.join(before, "doc_id").select("doc_id", (F.col("h") == F.col("b")).alias("same_as_before"))


GATE = """, r AS (SELECT *, concat(kind, ':', identity) AS k FROM (SELECT site_id, detail_url, published_at, author, external_id, CASE WHEN external_id IS NOT NULL THEN 'e' WHEN detail_url IS NOT NULL THEN 'd' ELSE 'h' END AS kind,
  coalesce(external_id, detail_url, concat(title, '|', coalesce(author, ''), '|', url, '|', coalesce(CAST(published_at AS VARCHAR), ''))) AS identity, is_active FROM notices)), got AS (SELECT site_id, count(*) AS extracted, count(*) - count(DISTINCT k) AS duplicates,
  count(*) FILTER (WHERE detail_url IS NULL) AS bad_urls, count(*) FILTER (WHERE published_at IS NULL) AS bad_dates, avg(CASE WHEN author IS NULL THEN 0 ELSE 1 END) AS a, avg(CASE WHEN published_at IS NULL THEN 0 ELSE 1 END) AS p, avg(CASE WHEN detail_url IS NULL THEN 0 ELSE 1 END) AS d, avg(CASE WHEN external_id IS NULL THEN 0 ELSE 1 END) AS e FROM r WHERE is_active GROUP BY 1),
  had AS (SELECT site_id, count(*) AS baseline, count(author) AS na, count(published_at) AS np, count(detail_url) AS nd, count(external_id) AS ne FROM r GROUP BY 1)
  SELECT s.site_id, coalesce(extracted, 0) AS extracted, coalesce(duplicates, 0) AS duplicates, coalesce(bad_urls, 0) AS bad_urls, coalesce(bad_dates, 0) AS bad_dates, coalesce(baseline, 0) AS baseline,
  concat_ws(',', CASE WHEN coalesce(extracted, 0) < 1 THEN 'NO_EXTRACTED_RECORDS' END, CASE WHEN untitled > 0.25 * source_records THEN 'MISSING_TITLES' END, CASE WHEN bad_urls > 0.2 * extracted THEN 'INVALID_DETAIL_URLS' END, CASE WHEN bad_dates > 0.5 * extracted THEN 'INVALID_DATES' END, CASE WHEN duplicates > 0.2 * extracted THEN 'DUPLICATE_RECORDS' END,
  CASE WHEN na >= 2 AND na >= 0.5 * baseline AND na / baseline - coalesce(a, 0) > 0.2 THEN 'FIELD_COVERAGE_REGRESSION_AUTHOR' END, CASE WHEN np >= 2 AND np >= 0.5 * baseline AND np / baseline - coalesce(p, 0) > 0.2 THEN 'FIELD_COVERAGE_REGRESSION_PUBLISHED_AT' END,
  CASE WHEN nd >= 2 AND nd >= 0.5 * baseline AND nd / baseline - coalesce(d, 0) > 0.2 THEN 'FIELD_COVERAGE_REGRESSION_DETAIL_URL' END, CASE WHEN ne >= 2 AND ne >= 0.5 * baseline AND ne / baseline - coalesce(e, 0) > 0.2 THEN 'FIELD_COVERAGE_REGRESSION_EXTERNAL_ID' END) AS reasons,
  concat_ws(',', CASE WHEN semantic >= 4 AND coalesce(extracted, 0) / semantic < 0.5 THEN 'COVERAGE_MISMATCH' END, CASE WHEN semantic >= 4 AND extracted / semantic > 1.2 THEN 'OVER_EXTRACTION' END) AS diagnostics
  FROM sites s LEFT JOIN got USING (site_id) LEFT JOIN had USING (site_id) LEFT JOIN (SELECT site_id, count(*) AS source_records, count(*) FILTER (WHERE author IS NULL) AS untitled, count(external_id) * (1 + site_id % 9) AS semantic FROM notices GROUP BY site_id) USING (site_id)"""


@query("notices sites", GATE)
def hard_gate(s):
    """Over stored notices, without an extraction's own counts: notices without an author stand in for rejected records, and external ids,
    by a factor of the site, for records that were seen. rule_gate has the real counts of a run."""
    rows = W.identities(s.notices)
    counts = s.notices.groupBy("site_id").agg(F.count(F.lit(1)).alias("source_records"), F.count_if(F.col("author").isNull()).alias("rejected"), (F.count("external_id") * (F.col("site_id") % 9 + 1)).alias("semantic_records"))
    sources = s.sites.select("site_id", F.lit(False).alias("failed")).join(counts, "site_id", "left").na.fill(0, ["source_records", "rejected", "semantic_records"])
    out = D.gate(rows.filter("is_active"), rows, sources, "site_id")
    return out.select("site_id", "extracted", "duplicates", "bad_urls", "bad_dates", "baseline", F.array_join("reasons", ",").alias("reasons"), F.array_join("diagnostics", ",").alias("diagnostics"))


@query("observations", """, x AS (SELECT l_orderkey, l_linenumber, title, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, length(title) AS len,
  CASE WHEN author IS NULL THEN 1 ELSE 0 END + CASE WHEN published_at IS NULL THEN 1 ELSE 0 END + CASE WHEN detail_url IS NULL THEN 1 ELSE 0 END + CASE WHEN external_id IS NULL THEN 1 ELSE 0 END AS missing
  FROM (SELECT * FROM observations) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, site_id, price)),
  y AS (SELECT *, first_value(i) OVER (PARTITION BY l_orderkey ORDER BY len DESC, i) AS a, first_value(i) OVER (PARTITION BY l_orderkey ORDER BY len, i) AS b, first_value(i) OVER (PARTITION BY l_orderkey ORDER BY missing DESC, i) AS c FROM x),
  z AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 1 WHEN i = n * 2 // 4 THEN 2 WHEN i = a THEN 3 WHEN i = b THEN 4 WHEN i = c THEN 5 WHEN i = n // 4 THEN 6 WHEN i = n * 3 // 4 THEN 7 END AS priority FROM y)
  SELECT l_orderkey, l_linenumber, i, place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY priority) AS place FROM z WHERE priority IS NOT NULL) WHERE place <= 6""")
def representative_sample(s):
    rows = s.observations.withColumn("_order", F.struct("l_linenumber", "l_partkey", "site_id", "price"))
    return D.representatives(rows, "l_orderkey", "_order").select("l_orderkey", "l_linenumber", F.col("i").cast("bigint").alias("i"), F.col("place").cast("bigint").alias("place"))


@query("notices", """, a AS (SELECT DISTINCT site_id, lower(trim(title)) AS t FROM notices), b AS (SELECT DISTINCT site_id, lower(trim(title)) AS t FROM notices WHERE is_active)
  SELECT coalesce(a.site_id, b.site_id) AS site_id, count(*) FILTER (WHERE a.t IS NOT NULL AND b.t IS NOT NULL) AS common, count(*) FILTER (WHERE b.t IS NULL) AS missing, count(*) FILTER (WHERE a.t IS NULL) AS extra FROM a FULL JOIN b ON a.site_id = b.site_id AND a.t = b.t GROUP BY 1""")
def shadow_parity(s):
    """All notices of a site against those that are still active."""
    return D.shadow_parity(s.notices, s.notices.filter("is_active"), "site_id")


RANKED = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, length DESC, api_index) AS rank FROM (SELECT DISTINCT ON (target_id, api_index) * FROM candidates ORDER BY target_id, api_index, score, length))"


def distinct_candidates(s):
    return W.latest(s.candidates, ["target_id", "api_index"], F.col("score"), F.col("length"))


@query("candidates", f"{RANKED} SELECT target_id, api_index, rank FROM ranked")
def rank_candidates(s):
    return D.ranked(distinct_candidates(s)).select("target_id", "api_index", F.col("rank").cast("bigint").alias("rank"))


@query("candidates", f"""{RANKED}, p AS (SELECT *, CASE WHEN rank = min(rank) FILTER (WHERE is_exact_target) OVER w THEN 0 WHEN rank = min(rank) FILTER (WHERE has_repeated_records) OVER w THEN 1 WHEN rank = min(rank) FILTER (WHERE is_same_host AND NOT looks_like_non_content) OVER w THEN 2 ELSE 3 END AS priority
  FROM ranked WINDOW w AS (PARTITION BY target_id)) SELECT target_id, api_index, rank FROM p QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY priority, rank) <= 4""")
def diversity_pool(s):
    return D.diverse_pool(distinct_candidates(s)).select("target_id", "api_index", F.col("rank").cast("bigint").alias("rank"))


@query("candidates", f"""{RANKED}, g AS (SELECT target_id, count(*) AS n, bool_or(has_repeated_records) AS any_records, max(score) FILTER (WHERE rank = 2) AS second FROM ranked GROUP BY 1)
  SELECT target_id, api_index, score, score - second AS gap, CASE WHEN looks_like_telemetry OR looks_like_non_content THEN 'reject_or_observe_more' WHEN n = 1 AND has_repeated_records AND score >= 12 THEN 'accept_rule' WHEN n = 1 AND has_repeated_records THEN 'defer_to_llm' WHEN n = 1 THEN 'reject_or_observe_more'
  WHEN has_repeated_records AND score >= 22 AND score - second >= 6 THEN 'accept_rule' WHEN has_repeated_records AND has_title_key AND is_json_like AND has_list_key AND score - second >= 4 THEN 'accept_rule' WHEN any_records THEN 'defer_to_llm' ELSE 'reject_or_observe_more' END AS decision FROM ranked JOIN g USING (target_id) WHERE rank = 1""")
def candidate_decision(s):
    return D.choices(distinct_candidates(s))


@query("runs", "SELECT site_id, CAST(sum(llm_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(coalesce(llm_output_tokens, 0)) AS BIGINT) AS output_tokens, round(CAST(sum(llm_cost) AS DOUBLE), 4) AS cost, bool_or(coalesce(llm_output_tokens > 0, false)) AS llm_used FROM runs GROUP BY 1")
def telemetry_rollup(s):
    return D.telemetry(s.runs, "site_id")


@query("", "SELECT page_id, lower(split_part(split_part(url, '://', 2), '/', 1)) = lower(split_part(split_part('https://blog.tionsh.example.net/', '://', 2), '/', 1)) AS same FROM pages")
def same_host(s):
    host = F.lower(F.call_function("parse_url", F.col("url"), F.lit("HOST")))
    return s.pages.select("page_id", (host == "blog.tionsh.example.net").alias("same"))


#: The pages' urls, some wrapped as the target of a redirect.
WRAPPED = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://go.example/out?utm_medium=m&return_url=', url_encode(url)) WHEN 1 THEN concat('HTTPS://Go.Example:443/out?x=1&url=', url_encode(url_encode(url)), '#f') ELSE url END AS url FROM {pages}"
URL_PARTS = """regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(url, '[?]([^#]*)', 1), '&') AS items FROM pages"""


@query("", f"""SELECT page_id, lower(site) || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/+', '/', 'g') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical
  FROM (SELECT page_id, site, path, list_distinct(list_filter(items, lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS kept FROM (SELECT page_id, {URL_PARTS}))""")
def canonical_url(s):
    return s.spark.sql(WRAPPED, pages=s.pages).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("", f"""SELECT page_id, lower(site) || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS redacted
  FROM (SELECT page_id, site, path, list_distinct(list_transform(list_filter(items, lambda x: x <> ''), lambda x: split_part(x, '=', 1) || '=')) AS kept FROM (SELECT page_id, {URL_PARTS}))""")
def redact_url(s):
    return s.pages.select("page_id", U.redacted(F.col("url")).alias("redacted"))


@query("", "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || CASE WHEN rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') END AS plain FROM pages")
def url_equality_key(s):
    return s.pages.select("page_id", T.url_without_query(F.col("url")).alias("plain"))


@query()
def visible_text(s):
    return J.visible_text(s.pages, "page_id", "html")


@query("", "SELECT event_id, props->>'$.k' AS k, CAST(NULL AS VARCHAR) AS title FROM events")
def json_rule_extract(s):
    return J.json_rule(s.events.select("event_id", "props"), "props", {"k": "$.k", "title": "$.items[0].title"}).select("event_id", "k", "title")


EXTRACTED = """SELECT o_custkey * 1000000 + o_orderkey // 4096 AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey // 4096 ORDER BY o_orderkey) - 1 AS INTEGER) AS record_index, concat('Order ', o_orderkey) AS title, o_orderpriority AS author,
  concat('https://shop.example/orders/', o_orderkey) AS detail_url, CAST(o_orderkey AS VARCHAR) AS external_id, strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') AS published_at FROM orders"""
LATER = "o_orderdate + INTERVAL 10 YEARS"
#: The same of documents that hold all orders of a customer.
LISTED = EXTRACTED.replace("o_custkey * 1000000 + o_orderkey // 4096 AS", "o_custkey AS").replace("o_custkey, o_orderkey // 4096", "o_custkey") + " QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2"
#: A JSON document of a customer's orders holds those of 4096 successive order keys.
PAGE = "o_custkey * 1000000 + o_orderkey div 4096"


@query("", EXTRACTED)
def json_extract(s):
    """Records of JSON documents that hold each customer's orders."""
    record = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("writer"), F.date_format(F.expr(LATER), "yyyy.MM.dd").alias("regDate"), F.concat(F.lit("/orders/"), F.col("o_orderkey"), F.lit("?utm_source=x")).alias("viewUrl"))
    docs = s.orders.groupBy(F.expr(PAGE).alias("page")).agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(record)).alias("items")).alias("response"))).alias("body")).withColumn("base", F.lit("https://shop.example/list"))
    return J.extract(docs, "page", "body", "base").drop("url", "source_path")


@query("", LISTED)
def html_extract(s):
    """Records of HTML documents that list each customer's orders between navigation and other blocks."""
    row = F.format_string('<tr class="row" data-no="%d"><td><a href="/orders/%d#top">Order %d</a></td><td class="writer">%s</td><td><time datetime="%s">x</time></td></tr>', "o_orderkey", "o_orderkey", "o_orderkey", "o_orderpriority", F.date_format(F.expr(LATER), "yyyy-MM-dd"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("html")))), lambda x: x["html"])
    page = F.concat(F.lit("<html><body><nav><ul><li><a href='/a'>Home page</a></li><li><a href='/b'>All of it</a></li><li><a href='/c'>More</a></li></ul></nav><div><p>Text<br>more</div><table>"), F.array_join(rows, ""), F.lit("</table></body>"))
    docs = s.orders.groupBy(F.col("o_custkey").alias("page")).agg(page.alias("body")).withColumn("base", F.lit("https://shop.example/list"))
    return J.extract(docs, "page", "body", "base").drop("url", "source_path")


@query("", "SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN date_trunc('hour', TIMESTAMP '2024-01-20 10:30:00' - (event_id % 50) * INTERVAL 1 MINUTE) WHEN event_type = 'click' THEN date_trunc('hour', TIMESTAMP '2024-01-20 10:30:00' - (event_id % 50) * INTERVAL 1 HOUR) WHEN event_type = 'error' THEN date_trunc('day', TIMESTAMP '2024-01-20 10:30:00' - (event_id % 50) * INTERVAL 30 DAY) ELSE date_trunc('day', TIMESTAMP '2024-01-20 10:30:00') END AS VARCHAR) AS at FROM events")
def relative_times(s):
    shown = F.concat((F.col("event_id") % 50).cast("string"), F.when(F.col("event_type") == "view", "분 전").when(F.col("event_type") == "click", "시간 전").when(F.col("event_type") == "error", "개월 전"))
    return s.events.select("event_id", T.relative_time(F.coalesce(shown, F.lit("")), W.instant("2024-01-20 10:30:00")).cast("string").alias("at"))


def order_documents(s):
    """JSON documents that hold each customer's orders."""
    record = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order  "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("writer"), F.date_format(F.expr(LATER), "yyyy.MM.dd").alias("regDate"))
    return s.orders.groupBy(F.expr(PAGE).alias("page")).agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(record)).alias("items")).alias("response"))).alias("body"))


@query("", EXTRACTED.replace("concat('https://shop.example/orders/', o_orderkey)", "concat('https://shop.example/o/', replace(o_orderpriority, ' ', '%20'), '/', o_orderkey)"))
def json_rule_execute(s):
    rule = JsonRule("$.response.items", {"title": "$.title", "author": "$.writer", "external_id": "$.id", "published_at": "$.regDate"}, {"detail_url": ("/o/{kind}/{key}", {"kind": "$.writer", "key": "$.id"})})
    return execute(order_documents(s), rule, "page", "body", "https://shop.example/list")


@query("", """SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN starts_with(h, '{') THEN 'json_object' WHEN starts_with(h, '[') THEN 'json_array' WHEN starts_with(h, '<') THEN 'html' WHEN regexp_matches(h, '^[A-Za-z_$][0-9A-Za-z_.$]*[ \\t\\n]*\\(') THEN 'jsonp_wrapper'
  WHEN contains(h, 'var ') OR contains(h, 'window.') THEN 'javascript_bridge' ELSE 'textual_other' END AS shape FROM (SELECT doc_id, text, trim(substr(text, 1, 120)) AS h FROM documents)""")
def body_shapes(s):
    return s.documents.select("doc_id", C.body_shape(F.col("text")).alias("shape"))


@query("", "SELECT page_id, list_aggregate(list_filter(['title', 'subject', 'content', 'writer', 'regdate', 'date', 'posted', 'list', 'items', 'rows', 'total_count', 'count', 'notice', 'board', 'zz_title', 'zz_end_dt', 'zz_jo_num', 'article', 'post', 'job', 'recruit', 'apply', 'deadline'], lambda k: contains(lower(html), k))[1:10], 'string_agg', ',') AS hits FROM pages")
def data_key_hits(s):
    return s.pages.select("page_id", F.array_join(C.data_key_hits(F.col("html")), ",").alias("hits"))


@query("", "SELECT page_id, CASE WHEN regexp_matches(lower(html), '^[ \\n]*<') THEN 'document_html' ELSE 'document_other' END AS kind FROM pages")
def source_kinds(s):
    shape, hits = C.body_shape(F.col("html")), C.data_key_hits(F.col("html"))
    return s.pages.select("page_id", C.source_kind(F.col("url"), F.lit("document"), F.lit("GET"), F.lit(""), shape, hits, F.lit(False)).alias("kind"))


@query("runs", "SELECT crawl_run_id, round((llm_input_tokens * 0.4 + coalesce(llm_output_tokens, 0) * 1.6) * 1350 / 1e6, 6) AS won FROM runs")
def run_costs(s):
    return s.runs.select("crawl_run_id", F.round(C.cost_in_won("openai", F.col("llm_input_tokens"), F.coalesce("llm_output_tokens", F.lit(0))), 6).alias("won"))


@query()
def informative_samples(s):
    return s.pages.select("page_id", C.informative_sample(F.col("html")).alias("sample"))


@query("", """SELECT p_partkey AS api_index, CASE p_size % 4 WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 24 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 8 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 30 + least(p_size, 10) WHEN p_size % 2 <> 0 THEN -8 ELSE 0 END
  + CASE WHEN p_size % 3 <> 0 AND p_size % 7 <> 0 THEN -4 ELSE 0 END + CASE WHEN p_size % 4 = 1 AND p_size % 7 <> 0 THEN -6 ELSE 0 END + CASE WHEN p_size % 4 = 3 THEN -10 ELSE 0 END + CASE WHEN p_size % 6 = 0 AND p_size % 5 <> 0 THEN -12 ELSE 0 END + CASE WHEN p_size % 11 = 0 THEN -35 ELSE 0 END AS score FROM part""")
def candidate_scores(s):
    """The additive score of candidates whose features come from a part's size."""
    size = F.col("p_size")
    off = ["looks_like_static_asset", "looks_like_non_content", "resource_is_data_channel", "is_post", "is_json_like", "is_jsonp_like", "is_javascript_bridge", "has_callback_param", "legacy_endpoint_hint", "has_date_key", "has_total_count", "has_list_key", "sample_length_ok", "has_notice_terms"]
    given = {"is_exact_target": size % 2 == 0, "is_same_host": size % 3 == 0, "has_title_key": size % 5 == 0, "has_repeated_records": size % 7 == 0, "semantic_record_count": size, "is_document_html": size % 4 == 1, "looks_like_telemetry": size % 11 == 0, "query_or_body_key_count": F.lit(0), "title_date_pair_count": F.lit(0)}
    features = F.struct(*[F.lit(False).alias(c) for c in off], *[v.alias(k) for k, v in given.items()])
    kind = F.when(size % 4 == 0, "graphql").when(size % 4 == 1, "document_html").when(size % 4 == 2, "xhr_other").otherwise("script_other")
    url = F.when(size % 6 == 0, "https://a.example/x.bundle.js").otherwise("https://a.example/x")
    rows = s.part.select("p_partkey", features.alias("f"), kind.alias("kind"), url.alias("url"))
    return rows.select(F.col("p_partkey").alias("api_index"), D.score(F.col("f"), F.col("kind"), F.col("url")).alias("score"))


@query("", """SELECT p_partkey AS id, concat_ws(',', CASE WHEN a >= 2 AND v = 0 THEN 'RECORD_EVIDENCE_LOST' END, CASE WHEN a >= 2 AND n = 0 THEN 'NAVIGATION_EVIDENCE_LOST' END, CASE WHEN a = 0 AND v = 0 AND e > 0 THEN 'EMBEDDED_DATA_NOT_EXPANDED' END,
  CASE WHEN t AND (CASE WHEN a > 0 THEN least(1, greatest(0, (a - v) / a)) ELSE 0 END >= 0.5 OR (2 - n) / 2 >= 0.5 OR v = 0 AND FALSE) THEN 'VIEW_TRUNCATED' END) AS reasons FROM (SELECT p_partkey, p_size % 5 AS a, p_size % 3 AS v, p_size % 4 AS n, p_size % 2 AS e, p_size % 7 = 0 AS t FROM part)""")
def source_view_checks(s):
    size = F.col("p_size")
    raw = F.struct((size % 5).alias("records"), F.lit(2).alias("navigation"), F.lit(3).alias("titles"), (size % 2).alias("embedded"))
    view = F.struct((size % 3).alias("records"), (size % 4).alias("navigation"), F.lit(3).alias("titles"), F.lit(0).alias("embedded"))
    return s.part.select(F.col("p_partkey").alias("id"), F.array_join(C.view_reasons(raw, view, size % 7 == 0), ",").alias("reasons"))


@query("", LISTED)
def embedded_extract(s):
    """Records of HTML pages that carry each customer's orders as the state of a script."""
    record = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("writer"), F.date_format(F.expr(LATER), "yyyy.MM.dd").alias("regDate"), F.concat(F.lit("/orders/"), F.col("o_orderkey")).alias("url"))
    docs = s.orders.groupBy(F.col("o_custkey").alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(record)).alias("list"))).alias("body"))
    head = '<html><head><script type="application/ld+json">{"a": [{"title": "x"}, {"title": "y"}, {"title": "z"}]}</script></head><body>'
    state = F.when(F.col("page") % 2 == 0, F.concat(F.lit("<script>window.__STATE__ = "), F.col("body"), F.lit("; go()</script>"))).otherwise(F.concat(F.lit('<script type="application/json" id="x">'), F.col("body"), F.lit("</script>")))
    pages = docs.select("page", F.concat(F.lit(head), state).alias("html"), F.lit("https://shop.example/list").alias("base"))
    return E.extract_embedded(pages, "page", "html", "base")


@query("", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'PORT' WHEN 1 THEN 'USERINFO' WHEN 2 THEN 'ADDRESS' END AS refusal FROM pages")
def url_refusals(s):
    """Urls of the pages, three of four made unsafe."""
    rest = F.regexp_replace("url", "^https?://[^/]*", "")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.concat(F.lit("https://"), host, F.lit(":8443"), rest)).when(kind == 1, F.concat(F.lit("https://u:p@"), host, rest)).when(kind == 2, F.concat(F.lit("http://10.0.0.7"), rest)).otherwise(F.col("url"))
    return s.pages.select("page_id", S.refusals(url).alias("refusal"))


@query("", """SELECT event_id, concat('{"token":"[REDACTED]","k":', props->>'$.k', ',"user":"u', user_id, '"}') AS redacted, concat('{"k":', props->>'$.k', '}') AS pruned FROM events""")
def json_evidence(s):
    body = F.concat(F.lit('{"token":"t'), F.col("event_id"), F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit(',"user":"u'), F.col("user_id"), F.lit('"}'))
    nulls = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"none":null}'))
    return s.events.select("event_id", S.redacted_json(body).alias("redacted"), S.pruned_json(nulls).alias("pruned"))


@query()
def structure_sample(s):
    return N.structure_samples(s.pages, "page_id", "html")


@query("", "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS place, concat('Order ', o_orderkey) AS label, concat('https://shop.example/view?id=', o_orderkey) AS target, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS argument FROM orders")
def navigation_resolve(s):
    """Links of pages that list each customer's orders: by a function, by an assignment or plainly."""
    key = F.col("o_orderkey").cast("string")
    label = F.concat(F.lit(">Order "), key, F.lit("</a></li>"))
    row = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<li><a onclick=\"goView('"), key, F.lit("')\""), label))
    row = row.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("<li><a onclick=\"location.href='/view?id=' + encodeURIComponent(this.dataset.key)\" data-key=\""), key, F.lit('"'), label)).otherwise(F.concat(F.lit('<li><a href="/view?id='), key, F.lit('&amp;utm_medium=x"'), label))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", row.alias("html")))), lambda x: x["html"])
    page = F.concat(F.lit("<script>function goView(id) { if (id) { track(id); } location.href = '/view?id=' + id; }</script><ul>"), F.array_join(rows, ""), F.lit("</ul>"))
    return N.document_links(s.orders.groupBy(F.col("o_custkey").alias("page")).agg(page.alias("body")).withColumn("base", F.lit("https://shop.example/list")), "page", "body", "base")


@query("", "SELECT DISTINCT p_brand, concat('item-', p_size) AS id FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1)")
def volatile_html_ids(s):
    return N.volatile_ids(s.part.select("p_brand", F.concat(F.lit("item-"), F.col("p_size")).alias("id")), "p_brand", "id")


from . import lifecycle_queries, outcome_queries  # noqa: E402, F401  register their queries
