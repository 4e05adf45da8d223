"""Spelling variants of a corpus' words by PartEnum signatures of letter multisets.

Words that differ by one inserted, deleted or replaced letter have letter multisets that differ in two elements at most. A multiset
is a binary vector over (letter, its how manieth occurrence); the dimensions are dealt to PARTS parts, so that two such vectors agree
on all parts but two. A signature is what a vector holds in one choice of all parts but two: every choice is enumerated, so that two
near words share a signature for certain. As one edit also leaves one half of a word as it is, a signature counts for words of the
same untouched half only: the first or last half of the shorter word. That loses no pair and parts the many words of equal letters.

Blocks of words of one half are counted first; the larger a block, the more parts its words are dealt to. Both words of a pair lie in
the same block, so both are enumerated alike. Words that share a signature meet in a task and are verified letter by letter. A
signature that still has more than BLOCK words is dealt in cells, in which each two of its blocks meet, so that no task gets it whole.

A word's form is its near word of the largest count, if that has RATIO times the word's count or more. Roots are found by pointer
jumping along the forms; only words whose root isn't final yet are shuffled again.

Nulls and edge cases: a null text has no words. A null doc_id takes part like any other (its runs are not edited). Repeated rows count
each. Equal counts are settled by code-point order. A word of any length is handled; words of over LONG letters are compared singly.
An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import small_batches, written

#: Runs of letters A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8: a letter is one code point below 256.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Parts of the vectors in a block of at most so many words; blocks of more have MOST_PARTS.
PARTS = {16: 2, 256: 3, 2048: 4, 16384: 6}
MOST_PARTS = 8
#: Words of a signature that meet in one task.
BLOCK = 4096
#: Letters of a word that is compared together with others.
LONG = 64
#: Different words that a task holds before it hands on their counts, and pairs that it compares at once.
HELD, AT_ONCE = 300_000, 1 << 18
#: Every run whose hash DIVISOR divides loses a letter, in the query.
DIVISOR = 97


def drop_letter(run: bytes, before: int, divisor: int = DIVISOR) -> bytes:
    """The run without its letter h % length if divisor divides h, the crc32 of the text hashed before and the run."""
    h = zlib.crc32(run, before)
    if h % divisor:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def runs_of(text: bytes):
    """The runs of letters with their counts; a long text's are counted in portions."""
    if len(text) < 4 << 20:
        return Counter(LETTERS.findall(text.lower()))
    found, matches = Counter(), LETTERS.finditer(text.lower())
    while part := [m.group() for m in itertools.islice(matches, 100_000)]:
        found.update(part)
    return found


def count_words(docs: DataFrame, edit: bool = False, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the distinct words of the whole corpus. Each task counts its own words, then the counts are summed.

    With edit, each run is first changed as by drop_letter(), hashed behind its document's id and a colon.
    """

    def count(batches):
        import pyarrow as pa

        def rows(held):
            names = [w for w in held if len(w) >= min_letters and len(w.decode()) >= min_letters]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()).cast(pa.string()), pa.array([held[w] for w in names], pa.int64())], ["word", "n"])

        held = Counter()
        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist(), strict=True):
                if not text:
                    continue
                found = runs_of(text)
                if edit and doc is not None:
                    before = zlib.crc32(b"%d:" % doc)
                    for run, n in found.items():
                        held[drop_letter(run, before)] += n
                else:
                    held.update(found)
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        yield rows(held)

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def letter_parts(words: list[bytes], parts: int) -> np.ndarray:
    """What each word's vector holds in each part, as a hash: words (of one byte a letter) x parts."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    order = np.argsort(row << 8 | data, kind="stable")
    key = (row << 8 | data)[order]
    first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(first, at, 0))
    letter = key & 255
    dimension = hashing.mix((letter << 32 | nth).astype(np.uint64) + np.uint64(1))
    # neighbours in the alphabet and further occurrences of a letter go to other parts
    part = (letter + (letter >> 3) + nth) % parts
    ends = np.append(0, np.cumsum(sizes))
    out = np.empty((len(words), parts), np.uint64)
    for p in range(parts):
        sums = np.append(np.uint64(0), np.cumsum(np.where(part == p, dimension, np.uint64(0))))
        out[:, p] = sums[ends[1:]] - sums[ends[:-1]]
    return out


def signatures(words: list[bytes], parts: int) -> np.ndarray:
    """words x choices: a hash of each choice of all parts but two."""
    held = letter_parts(words, parts)
    choices = list(itertools.combinations(range(parts), parts - 2))
    out = np.empty((len(words), len(choices)), np.uint64)
    for c, choice in enumerate(choices):
        mixed = np.full(len(words), c + 1, np.uint64)
        for p in choice:
            mixed = hashing.mix(mixed * np.uint64(31) + held[:, p])
        out[:, c] = mixed
    return out


def halves(words: DataFrame) -> DataFrame:
    """(half, longer, word, n): each word in its four blocks.

    In a block of size m, words of m letters meet each other and words of m + 1 letters (longer): those of the same first m / 2
    letters, or of the same last m - m / 2 letters.
    """
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(F.lit(False), F.lit(True))).alias("longer"))
    m = F.col("size") - F.col("longer").cast("int")
    first = (m / 2).cast("int")
    front = F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring(F.col("word"), F.lit(1), first).alias("letters"))
    back = F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring(F.col("word"), F.col("size") - (m - first) + 1, m - first).alias("letters"))
    rows = rows.withColumn("key", F.explode(F.array(front, back)))
    return rows.select(F.xxhash64("key.m", "key.side", "key.letters").alias("half"), "longer", "word", "n")


def enumerated(rows: DataFrame) -> DataFrame:
    """(signature, large, longer, word, n): the words of halves(), of blocks with parts, each with every choice of all parts but two."""

    def form(batches):
        import pyarrow as pa

        for batch in batches:
            parts, half = np.asarray(batch.column(1)), np.asarray(batch.column(0)).astype(np.uint64)
            for p in np.unique(parts):
                rows = np.flatnonzero(parts == p)
                found = signatures([w.encode("latin-1") for w in batch.column(4).take(pa.array(rows)).to_pylist()], int(p))
                found = hashing.mix(found + hashing.mix(half[rows])[:, None])
                taken = batch.take(pa.array(np.repeat(rows, found.shape[1])))
                out = pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), *(taken.column(c) for c in (2, 3, 4, 5))], ["signature", "large", "longer", "word", "n"])
                for a in range(0, out.num_rows, 50_000):
                    yield out.slice(a, 50_000)

    return rows.select("half", "parts", "large", "longer", "word", "n").mapInArrow(form, "signature bigint, large boolean, longer boolean, word string, n bigint")


def laid_out(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' sizes and their first and last LONG letters, forwards and backwards, as rows of equal width."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = int(min(sizes.max(initial=1), LONG))
    forwards = b"".join([w[:width].ljust(width, b"\0") for w in words])
    backwards = b"".join([w[: -width - 1 : -1].ljust(width, b"\0") for w in words])
    return sizes, *(np.frombuffer(x, np.uint8).reshape(-1, width) for x in (forwards, backwards))


def single_edits(words: np.ndarray, laid: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words[i] and words[j] differ by one edit: all letters but one of the longer word lie in their common ends."""
    sizes, *ways = laid
    longest = np.maximum(sizes[i], sizes[j])
    width, ends = ways[0].shape[1], np.zeros(len(i), np.int64)
    for letters in ways:
        apart = letters[i] != letters[j]
        first = apart.argmax(axis=1)
        ends += np.where(apart[np.arange(len(i)), first], first, width)
    fits = np.abs(sizes[i] - sizes[j]) < 2
    out = fits & (ends >= longest - 1) & (ends < 2 * width)
    for p in np.flatnonzero(fits & (longest > LONG)):
        x, y = (np.frombuffer(words[k[p]], np.uint8) for k in (i, j))
        n = min(len(x), len(y))
        out[p] = words[i[p]] != words[j[p]] and common(x[:n] == y[:n]) + common(x[::-1][:n] == y[::-1][:n]) >= longest[p] - 1
    return out


def common(equal: np.ndarray) -> int:
    return len(equal) if equal.all() else int(equal.argmin())


def cells(rows: DataFrame) -> DataFrame:
    """(cell, block, longer, word, n, pair): rows with the cells of their signatures, usually one. Of more than BLOCK words, each two blocks have a cell."""
    hot = written(rows.filter("large").groupBy("signature").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK).select("signature", F.ceil(F.col("c") / BLOCK).alias("blocks")), "hot")
    small = rows.join(hot, "signature", "left_anti").select(F.col("signature").alias("cell"), F.lit(0).alias("block"), "longer", "word", "n", F.lit(False).alias("pair"))
    if hot.isEmpty():
        return rows.select(F.col("signature").alias("cell"), F.lit(0).alias("block"), "longer", "word", "n", F.lit(False).alias("pair"))
    big = rows.join(hot, "signature").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    big = big.select(F.xxhash64("signature", low, high).alias("cell"), (F.col("block") > F.col("other")).cast("int").alias("block"), "longer", "word", "n", (low != high).alias("pair"))
    return small.unionByName(big)


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): each two near words of the written table (word, n), both ways, once or more."""

    def meet(batches):
        import pyarrow as pa

        def pairs(cols):
            cell, block, longer, word, n, pair = cols
            laid = laid_out(word)
            end = np.searchsorted(cell, cell, "right")
            at = np.arange(len(cell))
            counts = end - at - 1
            for a, b in hashing.parts(np.append(0, np.cumsum(counts)), AT_ONCE):
                i = np.repeat(at[a:b], counts[a:b])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.append(0, np.cumsum(counts[a:b]))[:-1], counts[a:b])
                # longer words don't meet each other here; in a cell of two blocks, only words of different blocks do
                fit = ~(longer[i] & longer[j]) & (~pair[i] | (block[i] != block[j]))
                i, j = i[fit], j[fit]
                near = single_edits(word, laid, i, j)
                i, j = i[near], j[near]
                one, two = np.concatenate([i, j]), np.concatenate([j, i])
                names = [[w.decode("latin-1") for w in word[x]] for x in (one, two)]
                yield pa.RecordBatch.from_arrays([pa.array(names[0], pa.string()), pa.array(names[1], pa.string()), pa.array(n[two], pa.int64())], ["word", "other", "other_n"])

        held = None  # the rows of the cell that the last batch ended in
        for batch in itertools.chain(batches, [None]):
            cols = held
            if batch is not None:
                names = np.empty(batch.num_rows, object)
                names[:] = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
                cols = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), names, np.asarray(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False).astype(bool)]
                if held is not None:
                    cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
            if cols is None or not len(cols[0]):
                continue
            end = int(np.searchsorted(cols[0], cols[0][-1])) if batch is not None else len(cols[0])
            held = [c[end:] for c in cols]
            if end:
                yield from pairs([c[:end] for c in cols])

    rows = halves(words)
    sizes = rows.groupBy("half").agg(F.count(F.lit(1)).alias("c"), F.count(F.when(~F.col("longer"), 1)).alias("own")).filter("own > 0 AND c > 1")
    parts = F.lit(MOST_PARTS)
    for limit in sorted(PARTS, reverse=True):
        parts = F.when(F.col("c") <= limit, PARTS[limit]).otherwise(parts)
    rows = rows.join(sizes.select("half", parts.alias("parts"), (F.col("c") > BLOCK).alias("large")), "half")
    rows = cells(written(enumerated(rows), "signatures"))
    met = rows.repartition("cell").sortWithinPartitions("cell").select("cell", "block", "longer", "word", "n", "pair")
    return met.mapInArrow(meet, "word string, other string, other_n bigint")


def add_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of (word, form) that have a form: the last word along the forms. Each round doubles the steps."""
    ahead = forms.select(F.col("word").alias("root"), F.lit(True).alias("open"))
    roots = written(forms.select("word", F.col("form").alias("root")).join(ahead, "root", "left").select("word", "root", F.coalesce("open", F.lit(False)).alias("open")), "roots")
    while not roots.filter("open").isEmpty():
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("open").alias("still"))
        moved = roots.filter("open").join(onward, "root").select("word", F.col("further").alias("root"), F.col("still").alias("open"))
        roots = written(roots.filter("NOT open").unionByName(moved), "roots")
    return roots.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of (word, n), whose words are distinct."""
    words = written(words.select("word", "n"), "words")
    pairs = near_words(words).repartition("word").groupBy("word", "other").agg(F.first("other_n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("order"), "other"))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("fits", F.coalesce(-F.col("best.order") >= ratio * F.col("n"), F.lit(False)))
    form = F.when(F.col("fits"), F.col("best.other"))
    form_n = F.when(F.col("fits"), -F.col("best.order"))
    found = written(found.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), form_n.alias("form_n")), "forms")
    roots = add_roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, edit: bool = False) -> DataFrame:
    """The variants of the words of docs; edit as for count_words()."""
    return variants(count_words(docs, edit))
