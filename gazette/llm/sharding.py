"""Byte-bounded shards by extendible hashing, with DataFrame functions alone.

A document's key is HASH_BITS bits of a hash. A bucket of depth d holds the keys that share their first d bits. The
directory starts with one bucket; only buckets over the byte limit are split, on one more bit, until every shard fits.
Keys are first summed into cells (a prefix deep enough that a cell is far below the limit), so that the loop works on a
small table; only cells that are too large themselves are split again by the documents' own keys.

Nulls and edge cases: a null text has 0 bytes. A single document over the limit is a shard of its own, of HASH_BITS
depth or less, and marked oversize; so are documents that share a whole key. Rows that repeat doc_id and text get
different keys, as each copy is numbered, so that a hot group of copies is split as well. A null doc_id is hashed as an
empty text. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_documents, written

MAX_BYTES = 1 << 20
HASH_BITS = 60
#: A cell's prefix has so many bits more than the shards would need if they were even.
CELL_BITS = 6


def hash_key(doc_id: Column, copy: Column) -> Column:
    """The first 60 bits of the md5 of doc_id as text (and, of repeated rows, the copy's number)."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(copy > 1, F.concat(F.lit("#"), copy.cast("string"))).otherwise(""))), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def prefix(key: str, depth: Column | int) -> Column:
    """The first depth bits of the key, as a number."""
    return F.call_function("shiftright", F.col(key), (F.lit(HASH_BITS) - depth).cast("int"))


def fits(limit: int) -> Column:
    """A bucket that isn't split: within the limit, or one document."""
    return (F.col("shard_bytes") <= limit) | (F.col("docs") == 1)


def directory(cells: DataFrame, limit: int, depth: int) -> DataFrame:
    """(depth, prefix, shard_bytes, docs) of the shards over cells (key: a key of the cell, bytes, docs), no deeper than depth.

    Each round sums the cells that are still in oversized buckets; the cells that fit leave the loop.
    """
    shards, open_cells = None, cells
    for d in range(depth + 1):
        sums = open_cells.groupBy(prefix("key", d).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("docs"))
        sums = written(sums.withColumn("depth", F.lit(d)), f"depth{d}")
        done = fits(limit) if d < depth else F.lit(True)
        shards = sums.filter(done) if shards is None else shards.unionByName(sums.filter(done))
        over = sums.filter(~fits(limit)).select("prefix")
        if d == depth or over.isEmpty():
            return shards
        open_cells = open_cells.withColumn("prefix", prefix("key", d)).join(over, "prefix", "left_semi").drop("prefix")
    return shards


def shard(docs: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """doc_id, n_bytes, shard (depth and prefix as bits), depth, shard_bytes and oversize of each row.

    The narrow table (doc_id, key, bytes) is written once; texts are never shuffled. Documents find their shard by one
    equi-join for all depths that the directory has: a row for each depth and document, at most a few of each.
    """
    keyed, repeats = keyed_documents(docs)
    rows = keyed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "_n")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))) if repeats else rows.withColumn("copy", F.lit(1))
    rows = written(rows.select("doc_id", "n_bytes", hash_key(F.col("doc_id"), F.col("copy")).alias("key")), "keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    deep = min(HASH_BITS, math.ceil(math.log2(max(1.0, total / limit))) + CELL_BITS)
    unit = 1 << (HASH_BITS - deep)
    cells = rows.groupBy((prefix("key", deep) * unit).alias("key")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    shards = written(directory(written(cells, "cells"), limit, deep), "directory")
    large = shards.filter(~fits(limit)).select("prefix")
    if deep < HASH_BITS and not large.isEmpty():  # rare: heavy documents whose keys start alike
        rest = rows.withColumn("prefix", prefix("key", deep)).join(large, "prefix", "left_semi").select("key", F.col("n_bytes").alias("bytes"), F.lit(1).cast("bigint").alias("docs"))
        whole = shards.join(large.withColumn("depth", F.lit(deep)), ["depth", "prefix"], "left_anti").select("prefix", "shard_bytes", "docs", "depth")
        shards = written(whole.unionByName(directory_from(rest, limit, deep)), "directory")
    depths = [r[0] for r in shards.select("depth").distinct().collect()]  # at most HASH_BITS + 1 numbers
    seen = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]) if depths else F.array(F.lit(0)))).withColumn("prefix", prefix("key", F.col("depth")))
    out = seen.join(shards, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("bigint").alias("depth"), F.col("shard_bytes").cast("bigint").alias("shard_bytes"), (F.col("shard_bytes") > limit).alias("oversize"))


def directory_from(cells: DataFrame, limit: int, start: int) -> DataFrame:
    """As directory(), for buckets of depth start that are known to be too large."""
    shards, open_cells = None, written(cells, "open")
    for d in range(start + 1, HASH_BITS + 1):
        sums = written(open_cells.groupBy(prefix("key", d).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("docs")).withColumn("depth", F.lit(d)), f"depth{d}")
        done = fits(limit) if d < HASH_BITS else F.lit(True)
        shards = sums.filter(done) if shards is None else shards.unionByName(sums.filter(done))
        over = sums.filter(~done).select("prefix")
        if over.isEmpty():
            break
        open_cells = open_cells.withColumn("prefix", prefix("key", d)).join(over, "prefix", "left_semi").drop("prefix")
    return shards.select("prefix", "shard_bytes", "docs", "depth")
