"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of TIMES * q words or more
(LEAST at least) that no neighbouring word extends. Each scale w looks for the periods q of lo to w, with w at most 4/3 of lo. In a
run of such a period, fingerprints of w words repeat every q words and not before, so the smallest fingerprint of a period recurs at
that distance. It is a minimum of the w fingerprints behind it or before it, itself included, at two successive occurrences at least:
2.67 q fingerprints of the run leave room for that. So the minima of a scale whose next equal one is lo to w words away are the seeds
of its periods. Each seed is extended both ways by comparing words that far apart. Periods up to SHORT are found by direct lag scans. Of
candidates over the same words the one of the smallest period is the run.

Documents are scanned in one pass without a shuffle; documents of about the same length are scanned together.

Nulls and edge cases: a null text has no words and no runs. Every row is a document of its own, repeated ones and those of null id
too. Runs may overlap. A text of any length is scanned as a whole. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import small_batches

#: Words are what lies between these characters: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
TIMES, LEAST, SHORT = 4, 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def lag_scan(ids: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """(start, end, q) of the maximal stretches with period q that are long enough."""
    same = np.zeros(max(len(ids) - q, 0) + 2, np.int8)
    same[1:-1] = ids[q:] == ids[:-q] if len(ids) > q else 0
    step = np.diff(same)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + q
    long = ends - starts >= max(LEAST, TIMES * q)
    return [(int(a), int(b), q) for a, b in zip(starts[long], ends[long], strict=True)]


def fingerprints(doubled: np.ndarray, k: int, w: int) -> np.ndarray:
    """Hashes of w words from those of k words each, with k <= w <= 2 k."""
    n = len(doubled) - (w - k)
    return hashing.mix(doubled[:n] * np.uint64(3) + hashing.mix(doubled[w - k :]))


def minima(prints: np.ndarray, w: int) -> np.ndarray:
    """Positions of the fingerprints that are minima of the w behind them or before them, themselves included."""
    n, low, k = len(prints), np.append(prints, np.full(w, LAST)), 1
    while k < w:
        step = min(k, w - k)
        low = np.minimum(low[: len(low) - step], low[step:])
        k += step
    ahead = low[:n] == prints
    behind = prints == np.append(np.full(w - 1, LAST), low[: max(n - w + 1, 0)])[:n] if w > 1 else ahead
    return np.flatnonzero(ahead | behind)


def matching(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ids[at] on (step 1), or up to it (step -1), equal those lag words later."""
    n, size = 0, 64
    most = len(ids) - lag - at if step > 0 else at + 1
    while n < most:
        size = min(size, most - n)
        a = at + n if step > 0 else at - n - size + 1
        same = ids[a : a + size] == ids[a + lag : a + lag + size]
        if not same.all():
            return n + int((same if step > 0 else same[::-1]).argmin())
        n, size = n + size, 2 * size
    return n


def scan(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in ids, whose documents, of up to longest words, have no ids in common."""
    found = [r for q in range(1, SHORT + 1) if max(LEAST, TIMES * q) <= longest for r in lag_scan(ids, q)]
    lo, k, doubled = SHORT + 1, 1, hashing.mix(ids.astype(np.uint64) + np.uint64(1))
    while TIMES * lo <= longest:
        w = (4 * lo + 2) // 3
        while 2 * k <= w:
            doubled, k = fingerprints(doubled, k, 2 * k), 2 * k
        prints = fingerprints(doubled, k, w) if w > k else doubled
        at = minima(prints, w)
        at = at[np.argsort(prints[at], kind="stable")]
        apart = np.diff(at)
        seed = (prints[at[1:]] == prints[at[:-1]]) & (apart >= lo) & (apart <= w)
        covered = {}
        for period, m in sorted(zip(apart[seed].tolist(), at[:-1][seed].tolist(), strict=True)):
            if m < covered.get(period, 0):
                continue
            start = m - matching(ids, m - 1, period, -1) if m else 0
            end = m + matching(ids, m, period, 1) + period
            covered[period] = end - period
            if end - start >= TIMES * period:
                found.append((start, end, period))
        lo = w + 1
    best = {}
    for start, end, period in found:
        best[start, end] = min(period, best.get((start, end), period))
    return sorted((start, end, period) for (start, end), period in best.items())


def runs_of(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    out = [[] for _ in documents]
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    levels = np.frexp(sizes.astype(float))[1]
    for level in np.unique(levels[sizes >= LEAST]):
        some = np.flatnonzero(levels == level)
        ids, first = [], 0
        for d in some:
            known: dict[bytes, int] = {}
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in documents[d]), np.int64, sizes[d]) + first)
            first += len(known)
        begins = np.append(0, np.cumsum(sizes[some]))
        for start, end, period in scan(np.concatenate(ids), int(sizes[some].max())):
            d = int(np.searchsorted(begins, start, "right")) - 1
            out[some[d]].append((start - int(begins[d]), end - start, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: its runs by start, then period, and its words without a run's repetitions."""

    def find(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in small_batches(batches):
            documents = [(text or b"").split() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            runs = runs_of(documents)
            texts = [collapse(words, found) for words, found in zip(documents, runs, strict=True)]
            rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(find, f"doc_id bigint, runs {RUNS}, collapsed string")


def run_rows(docs: DataFrame) -> DataFrame:
    """doc_id, start, length and period of each run."""
    return periodic_runs(docs).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def collapsed_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text, with each run reduced to its first period."""
    return periodic_runs(docs).select("doc_id", F.col("collapsed").alias("text"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by h = crc32(doc_id), has its words from a on replaced by repetitions of the p words from a.

    With g = h / 10 and n words: a = g % n and p = 1 + (n - a) / (3 + g % 8), in whole numbers.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("g", F.when(h % 10 == 0, g))
    picked = picked.withColumn("words", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("words").cast("bigint"))
    a = F.col("g") % F.col("n")
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    picked = picked.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, p))
    head = F.slice("words", F.lit(1), F.col("a").cast("int"))
    tail = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - F.col("a") - 1), lambda i: F.get(F.col("words"), (F.col("a") + i % F.col("p")).cast("int")))
    return picked.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256 and collapsed_sha256 of each row, as edited by repeated_tails()."""
    found = periodic_runs(repeated_tails(docs))
    keys = F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))
    found = found.withColumn("top", F.array_min(keys))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    listed = F.concat_ws("", F.transform("runs", line))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.size")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-1000 * F.col("top.size") / F.col("top.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
