"""The service's queries over its tables: feeds, subscriptions, reviews, folders, the outbox and recipients.

Every function takes DataFrames and returns a lazy one; times are parameters. Joins carry no hints: on one user's or one
site's rows they are small, and on whole tables Spark chooses by size at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOTICE_ORDER = "coalesce(published_at, created_at, scraped_at)"
NO_NOTICE = "없음"
DEFAULT_SITES = 5
STALE_PROCESSING = "INTERVAL 10 MINUTES"
MAX_ATTEMPTS = 3


def newest_first(*tie: str) -> list[Column]:
    """Fixed order of every list of notices."""
    return [F.expr(NOTICE_ORDER).desc_nulls_last(), *[F.col(c).desc() for c in tie or ("notice_id",)]]


def user_feed(notices: DataFrame, subscriptions: DataFrame, hidden: DataFrame, user_id: int | None = None) -> DataFrame:
    """Active notices of subscribed sites without hidden ones; is_new: created after the last view of a registered site.

    For one user, or all (then each user's rows stand by themselves). The hidden rows are an anti-join on both keys.
    """
    if user_id is not None:
        subscriptions, hidden = subscriptions.filter(F.col("user_id") == user_id), hidden.filter(F.col("user_id") == user_id)
    rows = notices.filter("is_active").join(subscriptions.select("user_id", "site_id", "alias", "last_viewed_at", "registration_completed_at"), "site_id")
    rows = rows.join(hidden, ["user_id", "notice_id"], "left_anti")
    return rows.withColumn("is_new", F.coalesce(F.col("registration_completed_at").isNotNull() & (F.col("created_at") > F.col("last_viewed_at")), F.lit(False))).withColumn("link", F.coalesce("detail_url", "url"))


def shaped_feed(feed: DataFrame) -> DataFrame:
    """Nulls as empty texts, times as ISO text."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return feed.select("user_id", "notice_id", "site_id", "alias", "title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("link", F.lit("")).alias("link"), iso("published_at").alias("published_at"), iso("created_at").alias("created_at"), "is_new")


def subscription_status(subscriptions: DataFrame, sites: DataFrame, notices: DataFrame) -> DataFrame:
    """Subscribed sites with has_new and the status shown. The newest active notice of each site replaces an EXISTS."""
    newest = notices.filter("is_active").groupBy("site_id").agg(F.max("created_at").alias("newest"))
    rows = subscriptions.join(sites, "site_id").join(newest, "site_id", "left")
    done = F.col("registration_completed_at").isNotNull()
    status = F.coalesce("crawl_status", F.lit("active"))
    return rows.select(
        "user_id", "site_id", "site_url", "alias",
        (done & F.coalesce(F.col("newest") > F.col("last_viewed_at"), F.lit(False))).alias("has_new"),
        F.when(~done & (status == "active"), "pending").otherwise(status).alias("crawl_status"),
        "validation_error_code", done.alias("registration_completed"), "notification_enabled",
    )


def sites_with_news(sites: DataFrame, notices: DataFrame, viewed: DataFrame) -> DataFrame:
    """Whether each site has a notice after its last view (viewed: site_id, last_viewed_at), active or not."""
    newest = notices.groupBy("site_id").agg(F.max("created_at").alias("newest"))
    rows = sites.join(newest, "site_id", "left").join(viewed, "site_id", "left")
    return rows.select("site_id", "site_url", F.coalesce(F.col("newest") > F.col("last_viewed_at"), F.lit(False)).alias("has_new"))


def notices_of_url(notices: DataFrame, sites: DataFrame, site_url: str | None = None) -> DataFrame:
    """Active notices of a site's url; newest_first() is their order."""
    chosen = sites if site_url is None else sites.filter(F.col("site_url") == site_url)
    return notices.filter("is_active").join(chosen.select("site_id", "site_url"), "site_id")


def latest_titles(notices: DataFrame, sites: DataFrame) -> DataFrame:
    """Each site's newest active title, or NO_NOTICE."""
    best = notices.filter("is_active").groupBy("site_id").agg(F.max_by("title", F.struct(F.expr(NOTICE_ORDER), "notice_id")).alias("title"))
    return sites.select("site_id", "site_url").join(best, "site_id", "left").withColumn("title", F.coalesce("title", F.lit(NO_NOTICE)))


def stored_notices_status(notices: DataFrame, sites: DataFrame) -> DataFrame:
    """How many active notices each url has, and the status success or empty."""
    counts = notices.filter("is_active").groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    rows = sites.join(counts, "site_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("site_id", "site_url", "n", F.when(F.col("n") > 0, "success").otherwise("empty").alias("status"))


def crawl_targets(sites: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return sites.join(subscriptions, "site_id", "left_semi").select("site_id", "site_url")


def api_config(states: DataFrame, sites: DataFrame) -> DataFrame:
    return states.join(sites.select("site_id", "site_url"), "site_id")


def rule_templates(states: DataFrame, pattern: str, path: str, least: int, exclude_site: int | None = None, limit: int = 5) -> DataFrame:
    """Newest configurations whose url fits a pattern and whose JSON value at path is large enough."""
    rows = states.filter(F.col("api_url").rlike(pattern) & (F.try_variant_get(F.try_parse_json("extractor_config"), path, "bigint") >= least))
    if exclude_site is not None:
        rows = rows.filter(F.col("site_id") != exclude_site)
    return rows.orderBy(F.col("scraped_at").desc_nulls_last(), F.col("api_id").desc()).limit(limit).select("api_id", "site_id", "api_url", "extractor_config")


def review_queue(runs: DataFrame, sites: DataFrame, reviewed: bool = False, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = runs.filter(F.col("review_label").isNotNull() == reviewed)
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.join(sites.select("site_id", "site_url"), "site_id").orderBy(F.col("started_at").desc(), F.col("crawl_run_id").desc()).limit(limit)


def tracked(runs: DataFrame, as_of: str, hours: int) -> DataFrame:
    hours = min(max(int(hours), 1), 24 * 30)
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return runs.filter((F.col("started_at") >= since) & (F.col("rule_activation_status").isNotNull() | (F.col("agent_stage_telemetry") != "[]")))


def rollout_summary(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    status = lambda s: F.count_if(F.col("rule_activation_status") == s)
    says = lambda s: F.count_if(F.col("evaluator_decision") == s)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return tracked(runs, as_of, hours).agg(
        F.count(F.lit(1)).alias("tracked_runs"), status("approved").alias("approved_runs"), status("reused").alias("reused_runs"), status("rejected").alias("rejected_runs"), status("failed").alias("failed_runs"),
        says("pass").alias("evaluator_passes"), says("fail").alias("evaluator_failures"), total("llm_input_tokens").cast("bigint").alias("input_tokens"), total("llm_output_tokens").cast("bigint").alias("output_tokens"),
        F.round(total("llm_cost").cast("double"), 4).alias("cost"), F.countDistinct("site_id").alias("affected_sites"),
    )


def rollout_recent(runs: DataFrame, as_of: str, hours: int = 24, limit: int = 20) -> DataFrame:
    rows = tracked(runs, as_of, hours).orderBy(F.col("started_at").desc(), F.col("crawl_run_id").desc()).limit(min(max(int(limit), 1), 100))
    return rows.withColumn("llm_cost", F.col("llm_cost").cast("double"))


def site_contexts(subscriptions: DataFrame, sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Each subscribed site with its latest run: one aggregate by site instead of a lateral query per row."""
    latest = runs.groupBy("site_id").agg(F.max_by(F.struct("crawl_run_id", "status", "error_code"), F.struct("started_at", "crawl_run_id")).alias("latest"))
    rows = subscriptions.join(sites, "site_id").join(latest, "site_id", "left")
    status = F.coalesce("crawl_status", F.lit("active"))
    own = F.col("validation_error_code")
    return rows.select(
        "user_id", "site_id", "site_url", F.col("alias").alias("site_alias"), status.alias("crawl_status"), own.alias("site_error_code"),
        "latest.crawl_run_id", F.col("latest.status").alias("crawl_run_status"), F.col("latest.error_code").alias("crawl_run_error_code"),
        F.when(status.isin("failed", "blocked"), F.coalesce(own, "latest.error_code")).otherwise(own).alias("error_code"),
    )


def folder_tree(folders: DataFrame, bridge: DataFrame, notices: DataFrame, keywords: DataFrame) -> DataFrame:
    """Root folders with arrays of their children, notices and keywords; a child without a root is dropped."""
    held = bridge.join(notices.select("notice_id", "title"), "notice_id").groupBy("folder_id").agg(F.sort_array(F.collect_list(F.struct("notice_id", "title"))).alias("notices"))
    words = keywords.groupBy("folder_id").agg(F.sort_array(F.collect_list("keyword")).alias("keywords"))
    full = folders.join(held, "folder_id", "left").join(words, "folder_id", "left")
    empty = lambda c, like: F.coalesce(c, F.expr(f"cast(array() as {like})"))
    full = full.withColumns({"notices": empty("notices", "array<struct<notice_id:bigint,title:string>>"), "keywords": empty("keywords", "array<string>")})
    below = full.filter("parent_folder_id is not null").groupBy("user_id", F.col("parent_folder_id").alias("folder_id")).agg(F.sort_array(F.collect_list(F.struct("sort_order", "folder_id", "folder_name", "notices", "keywords"))).alias("children"))
    return full.filter("parent_folder_id is null").join(below, ["user_id", "folder_id"], "left").drop("parent_folder_id")


def folder_depth(folders: DataFrame, asked: DataFrame) -> DataFrame:
    """(folder_id, depth) of each asked folder_id. -1: no such folder, 0: root, 1: below one."""
    known = folders.select("folder_id", F.when(F.col("parent_folder_id").isNull(), 0).otherwise(1).alias("_depth"))
    return asked.select("folder_id").distinct().join(known, "folder_id", "left").select("folder_id", F.coalesce("_depth", F.lit(-1)).alias("depth"))


def user_limits(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each user's site limit (DEFAULT_SITES where unset) and subscription count."""
    counts = subscriptions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sites"))
    return users.join(counts, "user_id", "left").select("user_id", "nickname", "role", F.coalesce("max_sites_limit", F.lit(DEFAULT_SITES)).alias("max_sites"), F.coalesce("n_sites", F.lit(0)).alias("n_sites"))


def device_tokens(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """The device tokens of users."""
    return tokens.join(users.select("user_id"), "user_id", "left_semi").select("token_id", "user_id", "fcm_token", "platform")


def pending_events(outbox: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The oldest events that are pending, or have been processing for too long."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(STALE_PROCESSING))
    return outbox.filter((F.col("status") == "pending") | stale).orderBy("created_at", "event_id").limit(limit)


def ready_deliveries(deliveries: DataFrame, tokens: DataFrame, as_of: str) -> DataFrame:
    due = F.col("next_attempt_at") <= F.lit(as_of).cast("timestamp_ntz")
    return deliveries.filter(F.col("status").isin("pending", "failed") & (F.col("attempt_count") < MAX_ATTEMPTS) & due).join(tokens.select("token_id", "user_id", "fcm_token"), "token_id")


def event_outcomes(outbox: DataFrame, deliveries: DataFrame) -> DataFrame:
    """pending while a delivery may be tried again, else sent if one was, else cancelled; also without any delivery."""
    again = F.col("status").isin("pending", "failed") & (F.col("attempt_count") < MAX_ATTEMPTS)
    sums = deliveries.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "sent").alias("n_sent"), F.count_if(again).alias("n_again"))
    rows = outbox.select("event_id").join(sums, "event_id", "left").na.fill(0, ["n", "n_sent", "n_again"])
    return rows.withColumn("status", F.when(F.col("n_again") > 0, "pending").when(F.col("n_sent") > 0, "sent").otherwise("cancelled"))


def recipients(tokens: DataFrame, users: DataFrame, role: str | None = None, platform: str | None = None) -> DataFrame:
    """A row per trimmed device token with the users behind it, blank tokens left out."""
    rows = tokens.join(users.filter("is_notification_enabled"), "user_id").withColumn("token", F.nullif(F.trim("fcm_token"), F.lit("")))
    rows = rows.filter("token is not null")
    if role:
        rows = rows.filter(F.lower(F.coalesce("role", F.lit(""))) == role.lower())
    if platform:
        rows = rows.filter(F.lower(F.coalesce("platform", F.lit(""))) == platform.lower())
    return rows.groupBy("token").agg(F.array_sort(F.collect_set("user_id")).alias("user_ids"))


def chunks(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows with chunk, of size rows each in the order of by, for batched sending.

    Two passes: rows are range partitioned and numbered in their partition, and the partitions' counts are summed up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()).persist()
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(before, "_p").withColumn("chunk", F.floor((F.col("_off") + F.col("_i")) / size).cast("bigint")).drop("_m", "_p", "_i", "_n", "_off")


def notification_contexts(outbox: DataFrame, subscriptions: DataFrame, users: DataFrame) -> DataFrame:
    rows = outbox.select("event_id", "subscription_id", "status").join(subscriptions.select("subscription_id", "user_id", "site_id", "alias", "notification_enabled"), "subscription_id")
    return rows.join(users.select("user_id", "nickname", "is_notification_enabled"), "user_id")


#: Stored error codes that are shown as another.
ERROR_ALIASES = {
    "NO_NOTICE_SOURCE": "SITE_VALIDATION_FAILED",
    "NOTICE_EXTRACTION_FAILED": "SITE_VALIDATION_FAILED",
}


def public_errors(rows: DataFrame, code: str = "validation_error_code") -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ERROR_ALIASES.items() for x in pair])
    return rows.withColumn("public_code", F.coalesce(F.try_element_at(table, F.col(code)), F.col(code)))


def grouped_feed(feed: DataFrame) -> DataFrame:
    """Each group's notices (by alias, else link) newest first, and whether any is new."""
    label = F.coalesce(F.nullif(F.trim("alias"), F.lit("")), "link")
    rows = feed.withColumn("label", label)
    place = Window.partitionBy("user_id", "label").orderBy(*newest_first())
    rows = rows.withColumn("place", F.row_number().over(place))
    return rows.groupBy("user_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "notice_id"))), lambda x: x["notice_id"]).alias("notice_ids"), F.bool_or("is_new").alias("has_new"))


def first_per_group(feed: DataFrame, n: int, group: list[str]) -> DataFrame:
    """At most n rows of each group, newest first."""
    return feed.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*newest_first()))).filter(F.col("place") <= n)


def since(feed: DataFrame, date: str) -> DataFrame:
    """Rows of the date or later, and those without any."""
    at = F.expr(NOTICE_ORDER)
    return feed.filter(at.isNull() | (at >= F.lit(date).cast("timestamp_ntz")))


#: Characters of the pieces by which titles and keywords meet.
GRAM = 3


def holds(titles: DataFrame, keywords: DataFrame) -> DataFrame:
    """(folder_id, id) of titles that hold one of a folder's keywords, in any case. No pair of a title and a keyword is formed by
    chance: they meet in the keyword's first GRAM characters, and then the whole keyword is looked for. Shorter keywords meet titles by
    pieces of their own length.
    """
    words = keywords.select("folder_id", F.lower("keyword").alias("word")).filter("word <> ''").distinct()
    different = words.select("word").distinct().withColumn("gram", F.substring("word", 1, GRAM))
    low = titles.select("id", F.lower("title").alias("low")).filter("low <> ''")
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.substring(F.col("low"), i, F.lit(n)))
    grams = low.select("id", "low", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in range(1, GRAM + 1)]))).alias("gram"))
    found = grams.join(different, "gram").filter(F.contains("low", "word")).groupBy("id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    # folders are looked up for each different set of words, so no pair of a title and a folder comes about twice
    folders = found.select("words").distinct().select("words", F.explode("words").alias("word")).join(words, "word").select("words", "folder_id").distinct()
    return found.join(folders, "words").select("folder_id", "id")


def categorize(titles: DataFrame, keywords: DataFrame, held: DataFrame) -> DataFrame:
    """(folder_id, id) of titles that hold one of a folder's keywords and aren't in the folder yet."""
    return holds(titles, keywords).join(held.select("folder_id", F.col("notice_id").alias("id")), ["folder_id", "id"], "left_anti")


def text_search(rows: DataFrame, needle: str, column: str = "title") -> DataFrame:
    return rows.filter(F.contains(F.lower(F.col(column)), F.lit(needle.lower())))


def folder_search(tree: DataFrame, needle: str) -> DataFrame:
    """Roots that hold, themselves or in a child, a notice whose title holds needle."""
    hit = lambda n: F.contains(F.lower(n["title"]), F.lit(needle.lower()))
    return tree.filter(F.exists("notices", hit) | F.coalesce(F.exists("children", lambda c: F.exists(c["notices"], hit)), F.lit(False)))


def display(feed: DataFrame) -> DataFrame:
    """Author or Unknown, and the first date that there is, as text."""
    return feed.select("user_id", "notice_id", F.coalesce(F.nullif(F.trim("author"), F.lit("")), F.lit("Unknown")).alias("author"), F.date_format(F.coalesce("published_at", "created_at"), "yyyy-MM-dd").alias("shown_date"))
