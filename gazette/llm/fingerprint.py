"""Document fingerprints by a homomorphic multiset hash, with DataFrame functions alone.

Each paragraph (line with its end) is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. So it doesn't depend on the paragraphs' order, and a paragraph is inserted or
deleted by adding or subtracting its vector, without the rest of the text.

A paragraph's vector has two parts. SUM_LANES lanes, modulo 2^62, are hashes of the whole paragraph: equal sums mean equal
multisets of paragraphs. SKETCH_LONGS longs hold LANES_IN_LONG lanes each, modulo 2^30: each sentence in the paragraph adds one hash bit to
each lane. Less their mean these lanes are a random projection of the multiset of sentences, so the cosine of two
fingerprints' lanes estimates how alike the documents are. A last number counts sentences, modulo 2^31.

Nulls and edge cases: a null text is an empty one, whose vector is zero; two such are alike (1), an empty and another
aren't (0). Rows that repeat doc_id and text are one document, whose row is returned as often; see keyed_documents for
null and ambiguous ids. A table of one document has itself as next. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_documents, ordinals, repeat_rows, written

SUM_LANES, SKETCH_LONGS, LANES_IN_LONG = 8, 30, 2
#: Bits of a lane, and from one lane of a long to the next; the bit between takes the carry.
LANE, STEP = 30, 31
SUM_MASK = (1 << 62) - 1
LANE_MASK = sum(((1 << LANE) - 1) << (STEP * i) for i in range(LANES_IN_LONG))
LANE_BITS = sum(1 << (STEP * i) for i in range(LANES_IN_LONG))
COUNT_MASK = (1 << 31) - 1
WIDTH = SUM_LANES + SKETCH_LONGS + 1

PARAGRAPH = "[^\\n]*\\n|[^\\n]+"
SENTENCE = "[^.!?|\\n]*[.!?|\\n]+|[^.!?|\\n]+"


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """The lane-wise sum or difference of two fingerprint vectors (arrays of WIDTH longs)."""
    masks = F.array(*[F.lit(m) for m in [SUM_MASK] * SUM_LANES + [LANE_MASK] * SKETCH_LONGS + [COUNT_MASK]])
    ones = F.array(*[F.lit(m) for m in [SUM_MASK + 1] * SUM_LANES + [LANE_BITS << LANE] * SKETCH_LONGS + [COUNT_MASK + 1]])
    if sign > 0:
        return F.transform(F.arrays_zip(a.alias("x"), b.alias("y"), masks.alias("m")), lambda z: (z["x"] + z["y"]).bitwiseAND(z["m"]))
    # the lane's modulus, a bit that is clear in x, keeps the borrow inside the lane
    return F.transform(F.arrays_zip(a.alias("x"), b.alias("y"), masks.alias("m"), ones.alias("o")), lambda z: (z["x"].bitwiseOR(z["o"]) - z["y"]).bitwiseAND(z["m"]))


def vector(text: Column) -> Column:
    """The fingerprint vector of a text: an array of WIDTH longs."""
    paragraphs = F.regexp_extract_all(text, F.lit(PARAGRAPH), 0)
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), 0)
    zero = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    hashed = lambda p: F.transform(F.array(*[F.lit(i) for i in range(SUM_LANES)]), lambda i: F.xxhash64(i, p).bitwiseAND(SUM_MASK))
    sums = F.aggregate(paragraphs, zero(SUM_LANES), lambda a, p: F.zip_with(a, hashed(p), lambda x, y: (x + y).bitwiseAND(SUM_MASK)))
    shifts = F.array(*[F.lit(i) for i in range(SKETCH_LONGS)])
    bits = lambda h: F.transform(shifts, lambda i: F.call_function("shiftright", h, i).bitwiseAND(LANE_BITS))
    sketch = F.aggregate(F.transform(sentences, lambda s: F.xxhash64(s)), zero(SKETCH_LONGS), lambda a, h: F.zip_with(a, bits(h), lambda x, y: (x + y).bitwiseAND(LANE_MASK)))
    return F.concat(sums, sketch, F.array(F.size(sentences).cast("bigint").bitwiseAND(COUNT_MASK)))


def text_of(vec: Column) -> Column:
    """The fingerprint as a string: its lanes in hexadecimal."""
    return F.lower(F.array_join(F.transform(vec, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def lanes(vec: Column) -> Column:
    """The sketch's lanes less their mean, doubled: an array of 60 longs in [-2^30, 2^30)."""
    count = F.element_at(vec, WIDTH)
    parts = F.flatten(F.transform(F.slice(vec, SUM_LANES + 1, SKETCH_LONGS), lambda x: F.transform(F.array(*[F.lit(STEP * i) for i in range(LANES_IN_LONG)]), lambda i: F.call_function("shiftright", x, i).bitwiseAND((1 << LANE) - 1))))
    return F.transform(parts, lambda c: ((2 * c - count) + (1 << LANE)).bitwiseAND((2 << LANE) - 1) - (1 << LANE))


def cosine(a: Column, b: Column) -> Column:
    """Of two lane arrays, from 0 to 1; two zero arrays are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).when(dot(a, a) + dot(b, b) == 0, 1.0).otherwise(0.0)


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out, the likeness of the fingerprint vectors a and b: 1 if they are equal."""
    step = df.withColumns({"_x": lanes(F.col(a)), "_y": lanes(F.col(b))})
    return step.withColumn(out, F.when(F.col(a) == F.col(b), 1.0).otherwise(F.round(cosine(F.col("_x"), F.col("_y")), 6))).drop("_x", "_y")


def neighbours(keyed: DataFrame) -> DataFrame:
    """A written table (_k, n_chars, of, half): each document, and the one (of) it is next to in descending order, with half of that one's length."""
    placed = written(ordinals(keyed.select("_k", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars")), "_k"), "order")
    n = placed.count()
    # the next document in descending order has the ordinal before, and the first the last
    before = placed.select(F.col("_k").alias("of"), F.floor(F.col("n_chars") / 2).cast("bigint").alias("half"), F.pmod(F.col("_ord") - 1, F.lit(max(n, 1))).alias("_ord"))
    return written(placed.join(before, "_ord").drop("_ord"), "neighbours")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    Texts are shuffled once, by key; the same exchange serves the documents and, cut to the half that the other
    document needs, their neighbours.
    """
    keyed, repeats = keyed_documents(docs)
    near = neighbours(keyed)
    # the same two columns on both sides, so that the exchange is reused
    texts = keyed.select("_k", F.coalesce("text", F.lit("")).alias("text")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k")
    given = texts.join(near, "_k").select(F.col("of").alias("_k"), F.substring(F.col("text"), F.lit(1), F.col("half").cast("int")).alias("_head"), vector(F.col("text")).alias("_next"))
    out = texts.join(given, "_k").withColumns({"n_chars": F.length("text").cast("bigint"), "_own": vector(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    out = out.withColumn("_edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.col("_head")))
    out = out.withColumns({"_changed": vector(F.col("_edited")), "edited_sha256": F.sha2(F.col("_edited"), 256)}).drop("text", "_head", "_edited")
    out = with_likeness(with_likeness(out, "_own", "_changed", "near_edited"), "_own", "_next", "near_next")
    out = out.select(F.col("_k").alias("doc_id"), "n_chars", "edited_sha256", text_of(F.col("_own")).alias("fingerprint"), text_of(F.col("_changed")).alias("edited_fingerprint"), "near_edited", "near_next")
    if not repeats:
        return out
    names = keyed.select(F.col("_k").alias("_id"), F.col("doc_id").alias("_name"), "_n")
    return repeat_rows(out.join(names, F.col("doc_id") == F.col("_id")).withColumn("doc_id", F.col("_name")).drop("_id", "_name"))
