"""Comparisons of two extractions, and checks of what a judge of them may refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import payloads, urls

#: Fields that two extractions of one source must agree on.
PARITY_FIELDS = ("author", "published_at", "detail_url", "external_id")
#: How sure a judge must be to let a result pass, and how many reasons and fields it may give.
LEAST_CONFIDENCE, MOST_REASONS, MOST_FIELDS, MOST_REASON_CHARS = 0.8, 8, 5, 1000
#: Candidates of which evidence is kept, and characters of a reason.
EVIDENCE_ROWS, EVIDENCE_CHARS = 8, 500


def title_key(title: Column) -> Column:
    """A title in lower case with single spaces; null if it is blank."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(title, r"(?U)\s+", " "))), F.lit(""))


def by_title(records: DataFrame, group: str, order: str) -> DataFrame:
    """One row for each title of a group: the last in order."""
    return records.withColumn("t", title_key(F.col("title"))).filter("t IS NOT NULL").groupBy(group, "t").agg(F.max_by(F.struct(*PARITY_FIELDS), order).alias("_f"))


def field_mismatches(expected: DataFrame, got: DataFrame, group: str, order: str) -> DataFrame:
    """(group, field, mismatches): in how many records of got a field differs from the expected record of the same title.

    Of expected records of one title the last in order counts; empty values count as none. Fields without a difference have no row.
    """
    mine = got.select(group, title_key(F.col("title")).alias("t"), F.struct(*PARITY_FIELDS).alias("_g")).filter("t IS NOT NULL")
    both = mine.join(by_title(expected, group, order), [group, "t"])
    value = lambda side, c: F.nullif(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    apart = [F.when(~value("_f", c).eqNullSafe(value("_g", c)), c) for c in PARITY_FIELDS]
    rows = both.select(group, F.explode(F.array_compact(F.array(*apart))).alias("field"))
    return rows.groupBy(group, "field").agg(F.count(F.lit(1)).alias("mismatches"))


def listed_titles(got: DataFrame, lists: DataFrame, group: str) -> DataFrame:
    """(group, kind, title): expected titles that got lacks and prohibited ones that it has. lists: (group, kind, title), kind expected or prohibited."""
    asked = lists.select(group, "kind", title_key(F.col("title")).alias("title")).filter("title IS NOT NULL").distinct()
    held = got.select(group, title_key(F.col("title")).alias("title"), F.lit(True).alias("held")).filter("title IS NOT NULL").distinct()
    rows = asked.join(held, [group, "title"], "left")
    wrong = F.when(F.col("kind") == "expected", F.col("held").isNull()).when(F.col("kind") == "prohibited", F.col("held").isNotNull())
    return rows.filter(wrong).select(group, F.when(F.col("kind") == "expected", "missing").otherwise("prohibited").alias("kind"), "title")


def shadow_verdicts(expected: DataFrame, got: DataFrame, lists: DataFrame, gates: DataFrame, group: str) -> DataFrame:
    """Each group's verdict on got: expectation_failed, rule_extractor_required, parity_mismatch or rule_based_pass, with the counts behind it.

    gates: (group, passed). A group that nothing is expected of is legacy_failed.
    """
    count = lambda df, name: df.groupBy(group).agg(F.count(F.lit(1)).alias(name), F.countDistinct(title_key(F.col("title"))).alias(f"{name}_titles"))
    titles = lambda df: df.select(group, title_key(F.col("title")).alias("t")).filter("t IS NOT NULL").distinct()
    common = titles(expected).join(titles(got), [group, "t"], "left_semi").groupBy(group).agg(F.count(F.lit(1)).alias("common"))
    wrong = listed_titles(got, lists, group).groupBy(group).agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "prohibited").alias("prohibited"))
    rows = gates.join(count(expected, "expected"), group, "left").join(count(got, "got"), group, "left").join(common, group, "left").join(wrong, group, "left")
    rows = rows.na.fill(0, ["expected", "expected_titles", "got", "got_titles", "common", "missing", "prohibited"])
    parity = F.when(F.col("expected_titles") > 0, F.col("common") / F.col("expected_titles")).otherwise(0.0)
    status = (
        F.when(F.col("expected") == 0, "legacy_failed").when((F.col("missing") > 0) | (F.col("prohibited") > 0), "expectation_failed").when(~F.coalesce("passed", F.lit(False)), "rule_extractor_required")
        .when((parity < 1.0) | (F.col("got") != F.col("expected")), "parity_mismatch").otherwise("rule_based_pass")
    )
    return rows.select(group, status.alias("status"), "expected", "got", F.round(parity, 6).alias("title_parity"), "missing", "prohibited")


def unknown_evidence(answers: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """The references (keys) of answers that the request didn't offer: an answer with any is refused."""
    return answers.select(*keys).distinct().join(allowed.select(*keys), keys, "left_anti")


def evaluation_faults(decision: Column, confidence: Column, reason_codes: Column, fields: Column, reason: Column) -> Column:
    """Why a judge's verdict isn't valid, as a list: a pass needs confidence and no reasons, a failure needs one; all within bounds."""
    n = F.coalesce(F.size(reason_codes), F.lit(0))
    faults = [
        F.when(~F.coalesce(decision.isin("pass", "fail"), F.lit(False)), "DECISION"),
        F.when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "CONFIDENCE"),
        F.when((decision == "pass") & (n > 0), "PASS_WITH_REASONS"), F.when((decision == "fail") & (n == 0), "FAIL_WITHOUT_REASON"),
        F.when((decision == "pass") & (confidence < LEAST_CONFIDENCE), "LOW_CONFIDENCE"),
        F.when((n > MOST_REASONS) | (F.coalesce(F.size(fields), F.lit(0)) > MOST_FIELDS), "TOO_MANY"),
        F.when(~F.coalesce(F.length(reason).between(1, MOST_REASON_CHARS), F.lit(False)), "REASON"),
    ]
    return F.array_compact(F.array(*faults))


def best_views(views: DataFrame, group: str) -> DataFrame:
    """The view of a source that lost least: by its reasons, its loss and whether it was cut, then by the priority of its strategy.

    views: group, strategy, priority, n_reasons, loss, truncated. tied: how many views were as good.
    """
    quality = F.struct("n_reasons", "loss", "truncated")
    ranked = views.withColumn("q", quality)
    best = ranked.groupBy(group).agg(F.min("q").alias("best"))
    rows = ranked.join(best, group).filter("q = best")
    return rows.groupBy(group).agg(F.min_by("strategy", F.struct("priority", "strategy")).alias("strategy"), F.count(F.lit(1)).alias("tied"))


def prioritized(candidates: DataFrame, pool: DataFrame, selected: DataFrame, target: str = "target_id") -> DataFrame:
    """(target, api_index, place): the selected candidate, then the pool, then the rest by rank, each once. Targets without a selection have none.

    candidates: with rank; pool: with place; selected: (target, api_index).
    """
    keys = [target, "api_index"]
    step = lambda df, n, at: df.select(*keys, F.struct(F.lit(n).alias("step"), at.cast("bigint").alias("at")).alias("order"))
    rows = step(candidates, 2, F.col("rank")).unionByName(step(pool, 1, F.col("place"))).unionByName(step(selected, 0, F.lit(0)))
    rows = rows.join(selected.select(target).distinct(), target, "left_semi").groupBy(*keys).agg(F.min("order").alias("order"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(target).orderBy("order", "api_index"))).select(*keys, "place")


def candidate_evidence(ordered: DataFrame, target: str = "target_id") -> DataFrame:
    """What is kept of the first EVIDENCE_ROWS candidates of each target: place, selected, the address without values, its hash and the reason.

    ordered: prioritized() with api_url, selected and validation_reason. The address is replaced within the reason, too.
    """
    url = F.coalesce("api_url", F.lit(""))
    endpoint = urls.redacted(url)
    reason = F.coalesce("validation_reason", F.lit(""))
    reason = F.when(url != "", F.replace(reason, url, endpoint)).otherwise(reason)
    rows = ordered.filter(F.col("place") <= EVIDENCE_ROWS)
    return rows.select(target, "place", "api_index", "selected", endpoint.alias("endpoint"), F.sha2(url, 256).alias("url_hash"), F.substring(reason, 1, EVIDENCE_CHARS).alias("validation_reason"))


def approved_notices(notices: DataFrame, target_url: Column, as_of: str) -> DataFrame:
    """Notices of an approved rule as they are stored: with the link in the target's form, the target's url and the time."""
    now = F.lit(as_of).cast("timestamp_ntz")
    link = urls.mobile_detail(urls.canonical(F.col("detail_url")), target_url, F.col("external_id"))
    return notices.withColumns({"detail_url": link, "url": target_url, "created_at": now, "scraped_at": now, "content_type": F.lit("notice")})


def rule_hash(rule: Column) -> Column:
    """The schema hash of a rule given as JSON."""
    return payloads.json_hash(rule)
