"""URL block and allow lists as a sort-merge range join.

A host is turned round, label by label (blog.example.net -> net.example.blog.), so that a rule's host and all its
subdomains are one interval of keys: those that start with the rule's key. Urls are range partitioned and sorted by key,
path and id. Each partition is then swept once together with the sorted rules: a stack holds the rules whose intervals
are open, nested from the widest to the narrowest, and each url takes the longest of them whose path starts its own path.

Skew: the range key ends in path and id, so that one host's urls spread over as many partitions as they need. Rules are
sent to the tasks in sorted blocks of at most RULE_BLOCK, one sweep for each block, each bettering the one before.

Nulls and edge cases: a null url and one without `://` have an empty host and path, which no rule fits. Urls that no
rule fits get DEFAULT_VERDICT. Rows are judged one by one, repeated or with a null id alike. Of two equal rules block
wins. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host, then a path that starts with a slash.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
DEFAULT_VERDICT = "allow"
#: Rules in one broadcast block, about 100 bytes each.
RULE_BLOCK = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "(?s)^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Each label is followed by a dot, so that a key starts with another only if whole labels match."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def rule_rows(rules: list[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """Sorted (key, path, rule, verdict), a rule once."""
    rows = {}
    for verdict, rule in sorted(rules, reverse=True):  # of equal rules, block comes last
        host, slash, path = rule.partition("/")
        rows[rule] = (".".join(reversed(host.translate(str.maketrans(UPPER, LOWER)).split("."))) + ".", slash + path, rule, verdict)
    return sorted(rows.values())


def by_path(rules: list[tuple]) -> tuple[list[int], dict[str, tuple[str, str]]]:
    """The sizes of a host's rules' paths, longest first, and (rule, verdict) of each path; of equal paths the first."""
    paths: dict[str, tuple[str, str]] = {}
    for _, path, rule, verdict in rules:
        paths.setdefault(path, (rule, verdict))
    return sorted({len(p) for p in paths}, reverse=True), paths


def sweep(rules: list[tuple[str, str, str, str]]):
    """A function of Arrow batches, sorted by key within the partition, that fills rule and verdict."""

    def run(batches):
        import pyarrow as pa

        keys = [r[0] for r in rules]
        stack: list[tuple[str, list]] = []  # (key, its rules), each key a prefix of the next
        at, last = None, None
        for batch in batches:
            cols = batch.to_pydict()
            best, verdict = cols["rule"], cols["verdict"]
            for i, (key, path) in enumerate(zip(cols["key"], cols["path"], strict=True)):
                if key != last:
                    if at is None:  # the first key of the partition: open the intervals that began before it
                        dots = [j + 1 for j, c in enumerate(key) if c == "."][:-1]
                        stack = [(k, by_path(rules[a:b])) for k in (key[:j] for j in dots) if (a := bisect_left(keys, k)) < (b := bisect_right(keys, k))]
                        at = bisect_left(keys, key)
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    while at < len(keys) and keys[at] <= key:
                        end = bisect_right(keys, k := keys[at])
                        if key.startswith(k):
                            stack.append((k, by_path(rules[at:end])))
                        at = end
                    last = key
                for _, (sizes, paths) in stack:
                    # of a host's rules the longest path that starts the url's: one look for each size that paths have
                    for size in sizes:
                        if size <= len(path) and (found := paths.get(path[:size])):
                            if best[i] is None or len(found[0]) > len(best[i]):
                                best[i], verdict[i] = found
                            break
            yield pa.RecordBatch.from_pydict(cols, schema=batch.schema)

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, url: str = "url", block: int = RULE_BLOCK) -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    host, path = host_and_path(F.col(url).cast("string"))
    out = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    out = out.withColumns({"key": reversed_host(F.col("host")), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(parts, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    rows = rule_rows(RULES if rules is None else rules)
    for i in range(0, len(rows), block):
        out = out.mapInArrow(sweep(rows[i : i + block]), out.schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT_VERDICT)).alias("verdict"))
