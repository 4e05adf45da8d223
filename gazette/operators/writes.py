"""The service's writes as functions from a state and its changes to the next state.

A table is never updated in place: a write reads one snapshot and gives the rows of the next, to be written beside it (see
streaming.commit). Times are parameters. Keys that repeat among the changes are resolved by an explicit order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONTHS_KEPT = 3
DELIVERY_DELAY = 60
ERROR_LENGTH = 2000


def instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def latest(changes: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last in the order."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return changes.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Insert or update by keys. keep_old: columns whose stored value wins; keep_if_null: where a null change changes nothing.

    changes has one row per key and may lack columns, which then stay.
    """
    rest = [c for c in state.columns if c not in keys]
    given = [c for c in changes.columns if c in rest]
    old = state.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_was"))
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given], F.lit(True).alias("_is"))
    both = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        o = F.col(f"_old_{c}")
        if c not in given:
            return o
        n = F.col(f"_new_{c}")
        if c in keep_old:
            return F.coalesce(o, n)
        if c in keep_if_null:
            return F.coalesce(n, o)
        return F.when(F.col("_is"), n).otherwise(o)

    return both.select(*keys, *[value(c).alias(c) for c in rest])


def set_where(state: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Conditional update: values in the rows that fit, the others as they are."""
    return state.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def remove(state: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return state.join(gone.select(*keys), keys, "left_anti")


def insert_new(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key isn't there yet, each key once."""
    fresh = rows.select(state.columns).dropDuplicates(keys).join(state.select(*keys), keys, "left_anti")
    return state.unionByName(fresh.select(state.columns))


def owned(rows: DataFrame, folders: DataFrame, user: str = "user_id") -> DataFrame:
    """rows of folder_id and a user whose folder is that user's."""
    return rows.join(folders.select("folder_id", F.col("user_id").alias(user)), ["folder_id", user], "left_semi")


def retry_delay(retries: Column) -> Column:
    """Minutes until the next try: 5 times 2 to the retries so far (8 at most), a day at most."""
    return F.least(F.lit(24 * 60), (5 * F.pow(F.lit(2), F.least(retries, F.lit(8)))).cast("bigint"))


def processing_results(state: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """The processing states after results (api_id, status, observed_hash): a failure counts a retry, anything else resets it."""
    rows = state.join(results.select("api_id", F.col("status").alias("_status"), F.col("observed_hash").alias("_hash")), "api_id", "left")
    hit, failed = F.col("_status").isNotNull(), F.col("_status") == "failed"
    after = instant(as_of) + retry_delay(F.col("retry_count")) * F.expr("INTERVAL '1' MINUTE")
    return rows.withColumns({
        "next_retry_at": F.when(failed, after).when(hit, None).otherwise(F.col("next_retry_at")),
        "retry_count": F.when(failed, F.col("retry_count") + 1).when(hit, 0).otherwise(F.col("retry_count")),
        "last_processed_hash": F.when(hit & ~failed, F.col("_hash")).otherwise(F.col("last_processed_hash")),
        "processing_status": F.coalesce("_status", "processing_status"),
    }).drop("_status", "_hash")


def age_out(notices: DataFrame, as_of: str) -> DataFrame:
    """Notices created over three months ago become inactive."""
    old = F.col("created_at") < instant(as_of) - F.expr(f"INTERVAL {MONTHS_KEPT} MONTHS")
    return set_where(notices, old & F.col("is_active"), {"is_active": F.lit(False)})


def activate(sites: DataFrame, subscriptions: DataFrame, ready: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """After a site's first success: the site is active and its open subscriptions get their baseline."""
    mark = ready.select("site_id", F.lit(True).alias("_ready")).distinct()
    now = instant(as_of)
    new_sites = sites.join(mark, "site_id", "left").withColumns({"crawl_status": F.when(F.col("_ready"), "active").otherwise(F.col("crawl_status")), "validation_error_code": F.when(F.col("_ready"), None).otherwise(F.col("validation_error_code"))}).drop("_ready")
    open_ = F.col("_ready") & F.col("registration_completed_at").isNull()
    new_subs = subscriptions.join(mark, "site_id", "left").withColumns({"last_viewed_at": F.when(open_, now).otherwise(F.col("last_viewed_at")), "registration_completed_at": F.when(open_, now).otherwise(F.col("registration_completed_at"))}).drop("_ready")
    return new_sites, new_subs


def subscribe(subscriptions: DataFrame, requests: DataFrame, sites: DataFrame, as_of: str) -> DataFrame:
    """New subscriptions of requests (user_id, site_id, alias); an existing one only takes the alias.

    A new one on an active site starts with its baseline, else it waits for the first success.
    """
    now = instant(as_of)
    ready = F.coalesce("crawl_status", F.lit("active")) == "active"
    rows = requests.join(sites.select("site_id", "crawl_status"), "site_id").join(subscriptions.select("user_id", "site_id", F.lit(True).alias("_was")), ["user_id", "site_id"], "left")
    fresh = rows.filter("_was is null").select("user_id", "site_id", "alias", now.alias("last_viewed_at"), F.when(ready, now).alias("registration_completed_at"))
    told = rows.filter("_was").select("user_id", "site_id", F.col("alias").alias("_alias"))
    kept = subscriptions.join(told, ["user_id", "site_id"], "left").withColumn("alias", F.coalesce("_alias", "alias")).drop("_alias")
    return kept.unionByName(fresh, allowMissingColumns=True)


def fallback_hash(title: Column, author: Column, url: Column, published_at: Column) -> Column:
    """The last identity of a notice: a SHA-256 of its canonical JSON."""
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " ")))
    row = F.struct(squeeze(author).alias("author"), F.coalesce(published_at.cast("string"), F.lit("")).alias("published_at"), squeeze(title).alias("title"), F.trim(F.coalesce(url, F.lit(""))).alias("url"))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def identities(rows: DataFrame, fold: bool = False) -> DataFrame:
    """rows with kind and identity: the external id (fold: in any case), else the detail url, else the fallback hash."""
    external, detail = F.nullif(F.trim("external_id"), F.lit("")), F.nullif(F.trim("detail_url"), F.lit(""))
    external = F.lower(external) if fold else external
    kind = F.when(external.isNotNull(), "external_id").when(detail.isNotNull(), "detail_url").otherwise("record_hash")
    return rows.withColumns({"kind": kind, "identity": F.coalesce(external, detail, fallback_hash(F.col("title"), F.col("author"), F.col("url"), F.col("published_at")))})


def match_notices(notices: DataFrame, records: DataFrame) -> DataFrame:
    """records with the notice_id that they update (null: a new one).

    By external id alone if the record has one; else by detail url, whatever else the notice has; else by the hash among
    notices that have neither. Where notices keep a record_hash, a record that nothing else finds takes the lowest notice without any
    identity of the same title, author and date: one from before hashes were kept.
    """
    known = identities(notices).select(F.col("notice_id"), "site_id", "external_id", "detail_url", "kind", "identity")
    keys = known.filter("external_id is not null").select("site_id", F.lit("external_id").alias("kind"), F.trim("external_id").alias("identity"), "notice_id")
    keys = keys.unionByName(known.filter("detail_url is not null").select("site_id", F.lit("detail_url").alias("kind"), F.trim("detail_url").alias("identity"), "notice_id"))
    keys = keys.unionByName(known.filter("kind = 'record_hash'").select("site_id", "kind", "identity", "notice_id"))
    keys = keys.groupBy("site_id", "kind", "identity").agg(F.min("notice_id").alias("notice_id"))
    found = identities(records).join(keys, ["site_id", "kind", "identity"], "left")
    if "record_hash" not in notices.columns:
        return found
    same = ["site_id", "title", F.coalesce("author", F.lit("")).alias("_author"), F.coalesce(F.col("published_at").cast("string"), F.lit("")).alias("_date")]
    old = notices.filter("external_id is null and detail_url is null and record_hash is null").select(*same, "notice_id")
    old = old.groupBy("site_id", "title", "_author", "_date").agg(F.min("notice_id").alias("_old")).withColumn("_kind", F.lit("record_hash"))
    keyed = found.select("*", *same[2:])
    on = ["site_id", "title", "_author", "_date"]
    return keyed.join(old, on, "left").withColumn("notice_id", F.coalesce("notice_id", F.when(F.col("kind") == F.col("_kind"), F.col("_old")))).select(found.columns)


def collisions(matched: DataFrame) -> DataFrame:
    """Notices that more than one record would update: the whole write is refused if there is any."""
    return matched.filter("notice_id is not null").groupBy("notice_id").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


def upsert_notices(notices: DataFrame, records: DataFrame, as_of: str, first_id: int) -> DataFrame:
    """The notices after records, with inserted: true for new ones, false for updated, null for the others.

    New ids follow the records' identities in order, from first_id.
    """
    matched = match_notices(notices, records)
    found = matched.filter("notice_id is not null")
    fresh = latest(matched.filter("notice_id is null"), ["site_id", "kind", "identity"], F.col("title"))
    n = found.select("notice_id", *[F.col(c).alias("_" + c) for c in ("title", "author", "url", "detail_url", "external_id", "published_at")])
    hit = F.col("_title").isNotNull()
    keep = lambda c: F.coalesce(F.col("_" + c), F.col(c))
    take = lambda c: F.when(hit, F.coalesce(F.col("_" + c), F.lit(""))).otherwise(F.col(c))
    updated = notices.join(n, "notice_id", "left").withColumns({**{c: take(c) for c in ("title", "author", "url")}, **{c: keep(c) for c in ("detail_url", "external_id", "published_at")}, "scraped_at": F.when(hit, instant(as_of)).otherwise(F.col("scraped_at")), "is_active": F.when(hit, F.lit(True)).otherwise(F.col("is_active")), "inserted": F.when(hit, F.lit(False))})
    # ids by one row number within each site, after the number of new ones of all smaller sites
    counts = fresh.groupBy("site_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("site_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("site_id").orderBy("kind", "identity"))).join(counts, "site_id")
    new = numbered.select((F.lit(first_id) + F.col("_off") + F.col("_i") - 1).alias("notice_id"), "site_id", "title", "detail_url", "url", "external_id", "author", instant(as_of).alias("created_at"), "published_at", instant(as_of).alias("scraped_at"), F.lit(True).alias("is_active"), F.lit(True).alias("inserted"))
    columns = [*notices.columns, "inserted"]
    return updated.select(columns).unionByName(new.select(columns))


def first_of_identity(records: DataFrame, group: list[str], order: str) -> DataFrame:
    """Order-preserving deduplication: the first record of each identity in its group."""
    return latest(identities(records, fold=True), [*group, "kind", "identity"], F.col(order))


def fan_out(new_notices: DataFrame, subscriptions: DataFrame, users: DataFrame, tokens: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, deliveries) for runs with new notices (site_id, crawl_run_id, notice_id).

    One event per eligible subscription and run that isn't there yet, one delivery per event and device.
    """
    ids = new_notices.groupBy("site_id", "crawl_run_id").agg(F.sort_array(F.collect_set("notice_id")).alias("new_notice_ids"))
    eligible = subscriptions.filter("registration_completed_at is not null and notification_enabled").join(users.filter("is_notification_enabled").select("user_id"), "user_id", "left_semi")
    rows = eligible.select("subscription_id", "user_id", "site_id").join(ids, "site_id").join(events.select("subscription_id", "crawl_run_id"), ["subscription_id", "crawl_run_id"], "left_anti")
    fresh = rows.withColumn("new_notice_count", F.size("new_notice_ids"))
    return fresh, fresh.join(tokens.select("token_id", "user_id"), "user_id").select("subscription_id", "crawl_run_id", "token_id").distinct()


def failed_deliveries(deliveries: DataFrame, failures: DataFrame, as_of: str) -> DataFrame:
    """After failures (delivery_id, error): one more attempt, the next after a minute times 2 to the attempts before."""
    rows = deliveries.join(failures.select("delivery_id", F.substring("error", 1, ERROR_LENGTH).alias("_error")), "delivery_id", "left")
    hit = F.col("_error").isNotNull()
    wait = (DELIVERY_DELAY * F.pow(F.lit(2), F.col("attempt_count"))).cast("bigint")
    return rows.withColumns({
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "next_attempt_at": F.when(hit, instant(as_of) + wait * F.expr("INTERVAL '1' SECOND")).otherwise(F.col("next_attempt_at")),
        "attempt_count": F.when(hit, F.col("attempt_count") + 1).otherwise(F.col("attempt_count")),
        "last_error": F.col("_error"),
    }).drop("_error")


def claim_events(outbox: DataFrame, as_of: str, limit: int = 100) -> DataFrame:
    """The outbox after one claim of the pending events: they are processing from now on. One writer claims at a time."""
    from .reads import pending_events

    chosen = pending_events(outbox, as_of, limit).select("event_id", F.lit(True).alias("_mine"))
    rows = outbox.join(chosen, "event_id", "left")
    return rows.withColumns({"status": F.when(F.col("_mine"), "processing").otherwise(F.col("status")), "updated_at": F.when(F.col("_mine"), instant(as_of)).otherwise(F.col("updated_at"))}).drop("_mine")


def cancel_events(outbox: DataFrame, deliveries: DataFrame, gone: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """Events in gone and their unsent deliveries are cancelled."""
    mark = gone.select("event_id", F.lit(True).alias("_gone"))
    events = outbox.join(mark, "event_id", "left").withColumn("status", F.when(F.col("_gone"), "cancelled").otherwise(F.col("status"))).drop("_gone")
    parts = deliveries.join(mark, "event_id", "left").withColumn("status", F.when(F.col("_gone") & (F.col("status") != "sent"), "cancelled").otherwise(F.col("status"))).drop("_gone")
    return events, parts


def delete_users(users: DataFrame, gone: DataFrame, dependents: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after users are deleted with all that is theirs; dependents: tables with a user_id."""
    return {"users": remove(users, gone, ["user_id"])} | {name: remove(t, gone, ["user_id"]) for name, t in dependents.items()}


def delete_folders(folders: DataFrame, bridge: DataFrame, keywords: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Folders in gone (folder_id, user_id), if owned, go with their children, notices and keywords."""
    roots = owned(gone, folders).select("folder_id")
    below = folders.join(roots.select(F.col("folder_id").alias("parent_folder_id")), "parent_folder_id", "left_semi").select("folder_id")
    dead = roots.unionByName(below).distinct()
    return {"folders": remove(folders, dead, ["folder_id"]), "folder_notices": remove(bridge, dead, ["folder_id"]), "keywords": remove(keywords, dead, ["folder_id"])}


def reorder_folders(folders: DataFrame, user_id: int, ids: list[int]) -> DataFrame:
    """Owned folders in the list take their place in it."""
    places = F.create_map(*[F.lit(x) for i, f in enumerate(ids) for x in (f, i)])
    place = F.try_element_at(places, F.col("folder_id").cast("int"))
    return set_where(folders, (F.col("user_id") == user_id) & place.isNotNull(), {"sort_order": place})


def open_baselines(subscriptions: DataFrame, sites: DataFrame, as_of: str) -> DataFrame:
    """Subscriptions without a baseline on an active site get one."""
    active = sites.filter(F.coalesce("crawl_status", F.lit("active")) == "active").select("site_id", F.lit(True).alias("_active"))
    rows = subscriptions.join(active, "site_id", "left")
    return rows.withColumn("registration_completed_at", F.when(F.col("registration_completed_at").isNull() & F.col("_active"), F.coalesce("last_viewed_at", instant(as_of))).otherwise(F.col("registration_completed_at"))).drop("_active")


def credit_referrals(users: DataFrame, referrals: DataFrame) -> DataFrame:
    """A referrer's site limit grows by one for each user referred (referrer_id, referee_id), each referee once."""
    counts = referrals.dropDuplicates(["referee_id"]).filter("referrer_id <> referee_id").groupBy(F.col("referrer_id").alias("user_id")).agg(F.count(F.lit(1)).alias("_n"))
    return users.join(counts, "user_id", "left").withColumn("max_sites_limit", F.when(F.col("_n") > 0, F.coalesce("max_sites_limit", F.lit(5)) + F.col("_n")).otherwise(F.col("max_sites_limit"))).drop("_n")
