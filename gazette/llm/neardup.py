"""Near-duplicate documents by MinHash with tensored banding, confirmed on the full shingle sets.

A document's set holds its distinct two-word shingles (64-bit hashes; the width is a parameter). Instead of ITEMS^2 independent
tables, two collections of ITEMS items are drawn, each item WIDTH minhashes; a table's key combines a pair of items, one of each
collection. So ITEMS^2 tables of 2 WIDTH minhashes need 2 ITEMS WIDTH minhash values: their square root, but for a factor.

Documents of equal sets are one class, represented by its smallest id. Buckets of a single class are dropped; the others are
written once, a row for each class and bucket. Links are found in two steps, whose tables grow with those rows only:

1. Stars, in ROUNDS rounds of another order each: in every bucket that holds more than one component, the documents of other
   components than the bucket's first document's may be compared with it; a document takes the one that it meets in most
   buckets. The links that the full sets confirm are joined to components.
2. The documents that still share a bucket with another component are joined exactly, by prefixes: their shingles are put in one order,
   rare ones first, and two sets that are similar enough share a shingle of the smaller one's first ninth and the larger one's first
   fifth. So what many documents have in common comes last in all of them and makes no candidates, and the rows are a
   fifth of the sets at most, however many documents share a template. Documents that share such a shingle are compared across components
   only; set sizes, the shingles that are left behind the shared one and bitmaps (parities of the set's shares) exclude the others. First
   the nearest pair of each two components goes to the full sets, then all pairs that are left.

So every two documents that share a bucket are linked through others, compared on the full sets or excluded for certain. Nothing is
capped, and nothing depends on how rows are dealt to tasks. Components grow by the smallest label and pointer jumping.

Recall: two documents of similarity 0.8 share a bucket with a chance of 0.998 (0.85: 0.9999).

Nulls and edge cases: a null or blank text has an empty set and is linked with nothing. A text of one word has that word as
its set. Rows that repeat doc_id and text are one document, whose row is returned as often; see keyed_documents for null
and ambiguous ids: a component that holds a null id has the null id as its smallest. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import binary_text, few, keyed_documents, repeat_rows, small_batches, written

#: Similarity from which documents are linked, in percent.
PERCENT = 80
ITEMS, WIDTH = 10, 3
#: Words of a shingle.
WORDS = 2
#: Documents whose lists of partners, of some dozens at most, are broadcast; those of more are joined by a shuffle.
WANTED = 300_000
#: Rounds of stars.
ROUNDS = 2
#: Rows of a shingle that meet in a task, and 64-bit words of a set's bitmap.
BLOCK, BITMAP = 500, 16
#: A shingle of fewer documents counts as rare; of others, COMMON at most have a place by their count in the order of shingles. Any order is
#: right: a better one makes fewer candidates.
RARE, COMMON = 8, 1_000_000
#: Texts that a task compares with one parent, at most.
CHILDREN = 64
PART_BYTES = 1 << 19
SEED = 7


def shingle_sets(values: np.ndarray, offsets: np.ndarray, width: int = WORDS):
    """The sorted distinct hashes of each document's shingles of width words, in turn; of all its words if it has fewer."""
    for first, last in hashing.parts(offsets, PART_BYTES):
        base = offsets[first]
        data = hashing.lower(values[base : offsets[last]])
        cuts = offsets[first : last + 1] - base
        starts, ends = hashing.word_spans(data)
        # a word that runs on into the next document is cut there
        inner = np.unique(cuts[1:-1])
        glued = inner[np.isin(inner, starts, invert=True) & (np.searchsorted(starts, inner, "right") > np.searchsorted(ends, inner, "right"))]
        starts, ends = np.sort(np.concatenate([starts, glued])), np.sort(np.concatenate([ends, glued]))
        words = hashing.span_hashes(data, starts, ends)
        grams = words
        for k in range(1, width):
            grams = hashing.mix(grams[:-1] * np.uint64(3) + hashing.mix(words[k:])) if len(grams) > 1 else words[:0]
        at = np.searchsorted(starts, cuts)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
                continue
            few_words = words[a : min(a + 1, b)]
            for k in range(a + 1, b):
                few_words = hashing.mix(few_words * np.uint64(3) + hashing.mix(words[k : k + 1]))
            yield few_words


def minhash_parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = 2 * ITEMS * WIDTH
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """2 ITEMS items, each a hash of WIDTH minhashes."""
    low = np.full(len(times), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        h = shingles[None, a : a + 4096] * times[:, None] + plus[:, None]
        h ^= h >> np.uint64(29)
        h *= times[::-1, None]
        np.minimum(low, h.min(axis=1), out=low)
    items = low.reshape(2 * ITEMS, WIDTH)
    out = np.zeros(2 * ITEMS, np.uint64)
    for j in range(WIDTH):
        out = hashing.mix(out * np.uint64(31) + items[:, j])
    return out


def bitmap(shingles: np.ndarray) -> bytes:
    """The parities of BITMAP * 64 shares of the set: two sets differ in as many shingles as their bitmaps do in bits, at least."""
    odd = np.bincount((hashing.mix(shingles) % np.uint64(BITMAP * 64)).astype(np.int64), minlength=BITMAP * 64) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def features(keyed: DataFrame, width: int = WORDS) -> DataFrame:
    """(_k, n, h1, h2, items, bits): set size, a 128-bit hash of the set, the two collections and the bitmap."""

    def scan(batches):
        import pyarrow as pa

        times, plus = minhash_parameters()
        for batch in batches:
            ns, h1, h2, items, bits = [], [], [], [], []
            for s in shingle_sets(*binary_text(batch), width):
                ns.append(len(s))
                h1.append(hashing.mix(s).sum(dtype=np.uint64))
                h2.append(hashing.mix(s * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)).sum(dtype=np.uint64))
                items.append(signature(s, times, plus).tobytes() if len(s) else b"")
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int32()), *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)), pa.array(items, pa.binary()), pa.array(bits, pa.binary())], ["_k", "n", "h1", "h2", "items", "bits"])

    return keyed.select("_k", "text").mapInArrow(scan, "_k bigint, n int, h1 bigint, h2 bigint, items binary, bits binary")


def bucket_keys(items: np.ndarray) -> np.ndarray:
    """The keys of each document's ITEMS^2 buckets, in turn."""
    i, j = (x.ravel() for x in np.meshgrid(np.arange(ITEMS), np.arange(ITEMS), indexing="ij"))
    table = hashing.mix((np.arange(ITEMS * ITEMS) + 1).astype(np.uint64))
    return hashing.mix(items[:, i] * np.uint64(5) + hashing.mix(items[:, ITEMS + j]) + table).ravel().view(np.int64)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, _k, n): the buckets that hold more than one of reps, as a written table."""

    def form(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                key = bucket_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, 2 * ITEMS))
                out = pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.repeat(np.asarray(batch.column(c)), ITEMS * ITEMS)) for c in range(2))], ["key", "_k", "n"])
                for a in range(0, out.num_rows, 100_000):
                    yield out.slice(a, 100_000)

    rows = reps.select("_k", "n", "items").mapInArrow(form, "key bigint, _k bigint, n int")
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared")
    return written(rows.join(few(shared), "key", "left_semi"), "buckets")


def crowded(rows: DataFrame) -> DataFrame:
    """The (key, _k, n, group) of the buckets that hold more than one group, as a written table."""
    keys = written(rows.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b")).filter("a <> b").select("key"), "crowded")
    return written(rows.join(few(keys), "key", "left_semi"), "rows")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """(child, parent): each document with the first one of most of its buckets, if that is of another group and of fitting size."""
    first = rows.groupBy("key").agg(F.min_by(F.struct("_k", "n", "group"), F.xxhash64("_k", F.lit(turn))).alias("first"))
    fit = (F.col("group") != F.col("first.group")) & (PERCENT * F.greatest("n", "first.n") <= 100 * F.least("n", "first.n"))
    met = rows.join(first, "key").filter(fit).groupBy(F.col("_k").alias("child"), F.col("first._k").alias("parent")).agg(F.count(F.lit(1)).alias("met"))
    return met.groupBy("child").agg(F.max_by("parent", F.struct("met", "parent")).alias("parent"))


def confirmed(keyed: DataFrame, pairs: DataFrame, width: int = WORDS) -> DataFrame:
    """The (child, parent) of the written table pairs whose sets are similar enough.

    A parent's children are dealt in groups of about CHILDREN, and its text goes once to each group; a child's text goes once to each of its
    parents. The ids of the texts needed are broadcast if they are few, else the texts are shuffled.
    """
    many = pairs.groupBy("parent").agg(F.ceil(F.count(F.lit(1)) / CHILDREN).alias("parts"))
    split = pairs.join(many, "parent").select("child", "parent", F.pmod(F.xxhash64("child"), F.col("parts")).alias("part"))
    ends = split.select(F.col("child").alias("_k"), F.struct("parent", "part").alias("to")).unionByName(split.select(F.col("parent").alias("_k"), F.struct("parent", "part").alias("to")))
    wanted = written(ends.groupBy("_k").agg(F.collect_set("to").alias("to")), "wanted")
    texts = keyed.select("_k", "text").join(few(wanted, WANTED), "_k")
    rows = texts.select(F.explode("to").alias("to"), "_k", "text").select(F.col("to.parent").alias("to"), F.col("to.part").alias("part"), "_k", "text")
    rows = rows.withColumn("child", F.col("_k") != F.col("to")).select("to", "part", "child", "_k", "text")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "to", "part").sortWithinPartitions("to", "part", "child", "_k")

    def compare(batches):
        import pyarrow as pa

        mother, own = None, None
        for batch in batches:
            out = []
            to, part, child, doc = (batch.column(c).to_pylist() for c in range(4))
            for t, p, is_child, k, s in zip(to, part, child, doc, shingle_sets(*binary_text(batch), width), strict=True):
                if not is_child:
                    mother, own = (t, p), s
                    continue
                if mother != (t, p):
                    raise ValueError("a parent's text is missing")
                small, large = sorted((len(s), len(own)))
                if 100 * small < PERCENT * large:
                    continue
                both = int(np.isin(s, own, assume_unique=True).sum()) if small else 0
                if small and 100 * both >= PERCENT * (small + large - both):
                    out.append((k, t))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["child", "parent"])

    return rows.mapInArrow(compare, "child bigint, parent bigint")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of the links with the smallest node that it reaches. Each round is written.

    A round gives each node the smallest label among its neighbours and itself, then that label's own label.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    while True:
        told = edges.join(labels, edges.y == labels.node).groupBy("x").agg(F.min("component").alias("m"))
        low = labels.join(told, labels.node == told.x).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        new = written(low.join(jump, "c").select("node", F.least("c", "further").alias("component"), (F.least("c", "further") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "component")
        if new.filter("moved").isEmpty():
            return labels


def grouped(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """rows with the group of _k: its component, or itself."""
    if joined is None:
        return rows.withColumn("group", F.col("_k"))
    return rows.join(joined.select(F.col("node").alias("_k"), F.col("component").alias("group")), "_k", "left").withColumn("group", F.coalesce("group", "_k"))


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles of RARE documents or more of (_k, text, ...) with their counts; if they are over COMMON, the most frequent ones."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for part in small_batches([batch], limit=PART_BYTES * 8):
                sets = list(shingle_sets(*binary_text(part), width))
                tokens, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n, pa.int64())], ["token", "n"])

    counts = texts.select("_k", "text").mapInArrow(count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    counts, least = written(counts.filter(F.col("n") >= RARE), "counts"), RARE
    while counts.filter(F.col("n") >= least).count() > COMMON:
        least *= 2
    found = counts.filter(F.col("n") >= least).toArrow()
    tokens, n = np.asarray(found.column("token")).view(np.uint64), np.asarray(found.column("n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the order of their counts, as many as a larger set needs, and how many of them a smaller one needs.

    A set of n that is similar to one at least as large shares 8 n / 9 shingles with it (at 0.8), and one at most as large 4 n / 5.
    """
    n = len(shingles)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], shingles), len(common[0]) - 1)
        counts = np.where(common[0][at] == shingles, common[1][at], 0)
        shingles = shingles[np.lexsort((shingles, counts))]
    as_larger = n + (-PERCENT * n // 100) + 1
    as_smaller = n + (-2 * PERCENT * n // (100 + PERCENT)) + 1
    return shingles[:as_larger], as_smaller


def prefixes(keyed: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """(key, _k, n, rest, short): the prefixes of the documents of members (_k), as a written table.

    rest counts the shingles from this one on; short tells whether it is in the smaller set's prefix. Shingles that are in no smaller set's
    prefix, or in one document's only, are left out.
    """
    texts = keyed.select("_k", "text").join(few(members), "_k")
    common = keyed.sparkSession.sparkContext.broadcast(common_shingles(texts, width))

    def form(batches):
        import pyarrow as pa

        for batch in batches:
            for part in small_batches([batch], limit=PART_BYTES * 8):
                keys, sizes, rests, shorts, counts = [], [], [], [], []
                for s in shingle_sets(*binary_text(part), width):
                    first, short = prefix(s, common.value) if len(s) else (s, 0)
                    keys.append(first)
                    counts.append(len(first))
                    sizes.append(len(s))
                    rests.append(len(s) - np.arange(len(first)))
                    shorts.append(np.arange(len(first)) < short)
                if not counts:
                    continue
                doc = np.repeat(np.asarray(part.column(0)), counts)
                columns = [np.concatenate(keys).view(np.int64), doc, np.repeat(np.array(sizes, np.int32), counts), np.concatenate(rests).astype(np.int32), np.concatenate(shorts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "_k", "n", "rest", "short"])

    rows = written(texts.select("_k", "text").mapInArrow(form, "key bigint, _k bigint, n int, rest int, short boolean"), "prefixes")
    some = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bool_or("short").alias("short")).filter("c > 1 AND short")
    return written(rows.join(few(written(some.select("key"), "keys")), "key", "left_semi"), "shared")


def between_groups(rows: DataFrame) -> DataFrame:
    """The rows, with their group, of the shingles that several groups share and a smaller set's prefix has."""
    keys = rows.groupBy("key").agg(F.min("group").alias("a"), F.max("group").alias("b"), F.bool_or("short").alias("c")).filter("a <> b AND c").select("key")
    return written(rows.join(few(written(keys, "keys")), "key", "left_semi"), "rows")


def cells(rows: DataFrame) -> DataFrame:
    """The between_groups() rows dealt in cells: (cell, unit, group, n, _k, rest).

    In a cell, rows of unit 0 meet those of unit 1: a shingle's rows in short prefixes meet all of its rows of other components. Of more than
    BLOCK rows, those of the largest component meet the others only, and both sides are dealt in blocks, each two of which have a cell.
    """
    named = ["cell", "unit", "group", "n", "_k", "rest"]
    sizes = rows.groupBy("key", "group").agg(F.count(F.lit(1)).alias("c"), F.count_if("short").alias("s"))
    sizes = sizes.groupBy("key").agg(F.sum("c").alias("rows"), F.sum("s").alias("shorts"), F.max_by(F.struct("group", "c", "s"), F.struct("c", "group")).alias("main"))
    hot = written(sizes.filter(F.col("rows") > BLOCK), "hot")
    side = lambda df, unit: df.select(F.col("key").alias("cell"), F.lit(unit).cast("bigint").alias("unit"), "group", "n", "_k", "rest")
    small = rows.join(few(hot.select("key")), "key", "left_anti")
    out = side(small.filter("short"), 0).unionByName(side(small, 1))
    if hot.isEmpty():
        return out
    blocks = lambda n: F.greatest(F.lit(1).cast("bigint"), F.ceil(n / BLOCK))
    m = F.col("main")
    # the largest component's short prefixes meet the others; the others' short prefixes meet all
    families = [("main", F.col("group") == m["group"], F.col("group") != m["group"], m["s"], F.col("rows") - m["c"]), ("rest", F.col("group") != m["group"], F.lit(True), F.col("shorts") - m["s"], F.col("rows"))]
    big = rows.join(few(hot), "key")
    for name, left, right, n_left, n_right in families:
        dealt = big.filter((n_left > 0) & (n_right > 0)).withColumns({"b": blocks(n_left), "c": blocks(n_right)})
        to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
        own = lambda n: F.pmod(F.xxhash64("_k", "key"), n)
        cell = F.xxhash64("key", F.lit(name), "x", "y")  # noqa: B023
        one = dealt.filter(left & F.col("short")).withColumn("x", own(F.col("b"))).withColumn("y", to(F.col("c"))).withColumns({"cell": cell, "unit": F.lit(0).cast("bigint")})
        two = dealt.filter(right).withColumn("y", own(F.col("c"))).withColumn("x", to(F.col("b"))).withColumns({"cell": cell, "unit": F.lit(1).cast("bigint")})
        out = out.unionByName(one.select(named)).unionByName(two.select(named))
    return out


def fitting_pairs(cell: np.ndarray, unit: np.ndarray, group: np.ndarray, n: np.ndarray, rest: np.ndarray, bits: np.ndarray, at_once: int = 1 << 20):
    """(i, j, distance), in parts, of rows, sorted by cell and unit, of one cell and other units and groups that can be similar enough.

    Refused are only pairs whose set sizes or bitmaps exclude the similarity, or the shingles that are left if this one is the first that
    they share: if it isn't, they meet at that one. The distance is the bitmaps', over the sum of the sizes.
    """
    cell_end = np.searchsorted(cell, cell, "right")
    last = np.append((cell[1:] != cell[:-1]) | (unit[1:] != unit[:-1]), True)
    unit_end = np.flatnonzero(last)[np.cumsum(np.append(0, last[:-1]))] + 1
    partners = np.append(0, np.cumsum(cell_end - unit_end))
    for a, b in hashing.parts(partners, at_once):
        count = cell_end[a:b] - unit_end[a:b]
        i = np.repeat(np.arange(a, b), count)
        j = np.arange(len(i)) - np.repeat(partners[a:b] - partners[a], count) + unit_end[i]
        both = n[i] + n[j]
        fit = (group[i] != group[j]) & (PERCENT * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j]))
        fit &= (100 + PERCENT) * np.minimum(rest[i], rest[j]) >= PERCENT * both
        i, j, both = i[fit], j[fit], both[fit]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        fit = apart <= both - 2 * -(-PERCENT * both // (100 + PERCENT))  # what two sets of the similarity differ in, at most
        yield i[fit], j[fit], apart[fit] / both[fit]


def cell_pairs(rows: DataFrame, bits: DataFrame, every: bool) -> DataFrame:
    """(child, parent) of the between_groups() rows that are of other groups and can be similar enough.

    Every such pair, or else the nearest one of each two groups. bits has the bitmap of each _k.
    """

    def meet(batches):
        import pyarrow as pa

        held = None  # the rows of the cell that the last batch ended in
        for batch in itertools.chain(batches, [None]):
            cols = held
            if batch is not None:
                cols = [*(np.asarray(batch.column(c)).astype(np.int64) for c in range(6)), np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64).reshape(-1, BITMAP)]
                if held is not None:
                    cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            end = int(np.searchsorted(cols[0], cols[0][-1])) if batch is not None else len(cols[0])
            held, cols = [c[end:] for c in cols], [c[:end] for c in cols]
            cell, unit, group, n, doc, rest, bits = cols
            for i, j, apart in fitting_pairs(cell, unit, group, n, rest, bits):
                low, high = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
                child, parent = np.maximum(doc[i], doc[j]), np.minimum(doc[i], doc[j])
                one, two = (child, parent) if every else (low, high)
                order = np.lexsort((parent, child, apart, two, one))
                one, two = one[order], two[order]
                keep = order[np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(order)]]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (child, parent, low, high, apart.astype(float))], ["child", "parent", "low", "high", "apart"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells(rows).join(bits.select("_k", "bits"), "_k").select("cell", "unit", "group", "n", "_k", "rest", "bits")
    pairs = dealt.repartition(parts, "cell").sortWithinPartitions("cell", "unit").mapInArrow(meet, "child bigint, parent bigint, low bigint, high bigint, apart double")
    if every:
        return pairs.select("child", "parent").distinct()
    return pairs.groupBy("low", "high").agg(F.min_by(F.struct("child", "parent"), F.struct("apart", "child", "parent")).alias("p")).select("p.child", "p.parent")


def find(keyed: DataFrame, width: int = WORDS) -> DataFrame:
    """(_k, n, component) of each document of keyed_documents()."""
    table = written(features(keyed, width), "features")
    classes = written(table.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("_k").alias("rep")), "classes")
    reps = table.join(classes.select(F.col("rep").alias("_k")), "_k", "left_semi")
    rows = buckets(reps)
    links, joined, tried = None, None, None

    def look(pairs: DataFrame) -> bool:
        """Confirms pairs that haven't been tried yet, joins the links and tells whether a pair was left to try."""
        nonlocal links, joined, tried
        pairs = written(pairs if tried is None else pairs.join(tried, ["child", "parent"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return False
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = written(confirmed(keyed, pairs, width), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            joined = components(links, "child", "parent")
        return True

    some = rows
    for turn in range(ROUNDS):
        some = grouped(rows, None) if joined is None else crowded(grouped(rows, joined))
        ends = stars(some, turn)
        look(ends.select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).distinct())
    some = crowded(grouped(some.drop("group"), joined))
    members = written(some.select("_k").distinct(), "members")
    if not members.isEmpty():
        shared = prefixes(keyed, members, width)
        for every in (False, True):
            look(cell_pairs(between_groups(grouped(shared, joined)), table, every))
    if joined is None:
        return table.select("_k", F.col("n").cast("bigint").alias("n"), F.coalesce(F.lit(None).cast("bigint"), "_k").alias("component")) if classes.isEmpty() else with_classes(table, classes.select("n", "h1", "h2", F.col("rep").alias("component")))
    return with_classes(table, classes.join(joined, classes.rep == joined.node, "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component")))


def with_classes(table: DataFrame, final: DataFrame) -> DataFrame:
    return table.join(final, ["n", "h1", "h2"], "left").select("_k", F.col("n").cast("bigint").alias("n"), F.coalesce("component", "_k").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    keyed, odd = keyed_documents(docs)
    found = find(keyed, width)
    if not odd:
        return found.select(F.col("_k").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("_k") == F.col("component")).alias("kept"))
    names = keyed.select(F.col("_k").alias("component"), F.col("doc_id").alias("component_id"))
    out = found.join(keyed.select("_k", "doc_id", "_n"), "_k").join(names, "component")
    return repeat_rows(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_n"))


def keep_documents(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """One row of each component, with all columns of docs: the one of its smallest id.

    Of rows that repeat its doc_id and text, the one whose columns as JSON come first.
    """
    keyed, odd = keyed_documents(docs)
    found = written(find(keyed, width), "components")
    if not odd:
        gone = found.filter("_k <> component").select(F.col("_k").alias("doc_id"))
        return docs.join(few(written(gone, "gone")), "doc_id", "left_anti").select([docs[f"`{c}`"] for c in docs.columns])
    stay = keyed.join(found.filter("_k = component").select("_k"), "_k", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("words"))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("_id")) & F.col("words").eqNullSafe(F.col("_text")), "left_semi")
    return rows.groupBy("id", "words").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
