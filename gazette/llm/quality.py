"""Quality rules per document and per host, with DataFrame functions alone.

Base rules look at one text. Host rules aggregate base failures by domain, shrink each host's failure rate towards the
corpus with a beta prior fitted to all hosts by the method of moments, and join the verdict back to the documents.

Nulls and edge cases: a null or blank text has no words, so it fails the base rules. Documents with a null source form
one host of their own. Repeated rows are judged one by one and count each. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_WORDS = 50
#: A text fails if more than this percentage of its words lies in repeated three-word windows.
MAX_REPEAT_PERCENT = 50
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_FAILURE = 0.5
#: Bounds of the fitted prior's strength, in documents.
PRIOR_STRENGTH = (1.0, 1e6)

SPACE = "[\\x20\\x09-\\x0D]+"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_features(df: DataFrame, text: str = "_text", prefix: str = "") -> DataFrame:
    """df with the columns of FEATURES (with prefix) for the never null column text.

    Every step that is used more than once is a projection of its own, so that it is evaluated once per row. Repeated
    windows are found by sorting (hash, place) pairs: n log n, whatever repeats.
    """
    p = prefix
    out = df.withColumn("_words", F.array_remove(F.split(F.col(text), SPACE), "")).withColumn(p + "n_words", F.size("_words").cast("bigint"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn("_lines", lines).withColumns({
        p + "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        p + "n_symbols": (F.length(text) - F.length(F.regexp_replace(F.col(text), "[#*$%&|<>]+", ""))).cast("bigint"),
        p + "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_grams": F.when(
            F.size("_words") >= 3,
            F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))),
        ).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:int>>)")),
    }).drop("_lines", "_words")
    out = out.withColumn("_grams", F.sort_array("_grams"))
    near = lambda x, k: F.coalesce(x["h"] == F.get("_grams", k)["h"], F.lit(False))
    out = out.withColumn("_at", F.filter("_grams", lambda x, k: near(x, k - 1) | near(x, k + 1)))
    out = out.withColumn("_at", F.sort_array(F.transform("_at", lambda x: x["i"]))).drop("_grams")
    covered = F.transform("_at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - x, F.lit(3))))
    return out.withColumn(p + "n_repeat_words", F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, b: a + b)).drop("_at")


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def host_verdicts(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """(host, host_docs, host_failures, host_rate, host_kept) of a written table of judged documents.

    The prior's mean is the corpus' failure rate m; its strength is m (1 - m) / v - 1, where v is the variance of the
    hosts' rates weighted by their documents. Only the prior's two sums reach the driver.
    """
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.count_if(F.col(failed)).alias("host_failures"))
    s = hosts.agg(
        F.sum("host_docs").alias("n"),
        F.sum("host_failures").alias("f"),
        F.sum(F.col("host_failures").cast("double") * F.col("host_failures") / F.col("host_docs")).alias("q"),
    ).first()
    mean, strength = beta_prior(s["n"] or 0, s["f"] or 0, s["q"] or 0.0)
    rate = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= MAX_HOST_FAILURE)


def beta_prior(n: int, failures: int, squares: float) -> tuple[float, float]:
    """(mean, strength); squares: sum over hosts of failures^2 / documents."""
    low, high = PRIOR_STRENGTH
    if not n:
        return 0.0, low
    mean = failures / n
    variance = max(squares / n - mean * mean, 0.0)
    return mean, min(high, max(low, mean * (1 - mean) / variance - 1)) if variance > 1e-12 else high


def judge(docs: DataFrame, host: str = "source", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry's columns of docs (doc_id by default), FEATURES, base_failed, host_rate and kept.

    The base features are computed once and written to the shared folder with the carried columns; the host aggregate
    and the join back read that table. The join has one row per host on its right side and no hint: Spark broadcasts it
    if it is small and splits a hot host's rows otherwise.
    """
    carry = ["doc_id"] if carry is None else carry
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"), F.col(host).cast("string").alias("_host"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    base = with_features(base).drop("_text").withColumn("base_failed", base_failed())
    base = written(base, "quality")
    verdicts = host_verdicts(base, "_host", "base_failed").select(F.col("_host").alias("_h"), "host_rate", "host_kept")
    out = base.join(verdicts, F.col("_host").eqNullSafe(F.col("_h")))
    return out.select("_row.*", *[F.col(c) for c in FEATURES], "base_failed", F.round("host_rate", 6).alias("host_rate"), (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all columns of docs."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    base = with_features(base).drop("_text").withColumn("base_failed", base_failed()).drop(*FEATURES)
    base = written(base, "quality")
    verdicts = host_verdicts(base, "_host", "base_failed").filter("host_kept").select(F.col("_host").alias("_h"))
    return base.filter(~F.col("base_failed")).join(verdicts, F.col("_host").eqNullSafe(F.col("_h")), "left_semi").select("_row.*")
