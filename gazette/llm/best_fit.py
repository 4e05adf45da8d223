"""Packing of documents into as few sequences as possible: a configuration linear program over the length histogram.

Pass 1 encodes each document once and writes its ids. A document of more than a window's tokens is cut into full windows, which are
sequences of their own, and a shorter first piece. The shorter pieces of each length are numbered: in their partition while it is
encoded, over all by the sums of the partitions before it. What the driver gets is the histogram, one count for each length.

A configuration is a multiset of lengths that fit into one window. plan() solves the linear program over configurations that covers
the histogram: multiplicative weights price the lengths, a knapsack's dynamic program finds for each length the best configuration
that holds it, and the weights of what is covered fall. The fractions are rounded to whole configurations as far as the pieces last;
the few pieces left go best-fit decreasing. Its time depends on the window alone, not on the number of documents.

Pass 2 looks up each piece's place by its length and number, in a task, and gives it the digest of its ids.

Nulls and edge cases: a null or empty text is a document of its end id alone. Every row is a document of its own, repeated ones and
those of null id too. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import add_offsets, few, small_batches, written
from .token_count import SAFE, VOCABULARY

RANKS = "byte_bpe_50k.tiktoken"
END_ID = 2
WINDOW = 1024
#: Characters without white space, or spaces or line ends in a row, from which on a text goes to the library.
LONG = 400
#: The share of a length that one step covers at most; how fast weights fall; the steps at most; and the share of the tokens left that
#: a step must cover, else configurations with twice the gap are let in, up to MOST_GAP tokens.
SHARE, RATE, STEPS, PROGRESS, MOST_GAP = 0.05, 4.0, 900, 0.002, 32
#: Rows of numbers before each partition that are broadcast; more are joined by a shuffle.
OFFSETS = 500_000


class Ids:
    """Ids, as bytes of 16-bit integers, of texts."""

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        with open(ranks, "rb") as f:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def is_plain(self, text: str) -> bool:
        """Whether the text has no characters, special strings or long words over which the two libraries can differ."""
        if not SAFE.fullmatch(text) or any(s in text for s in self.special) or " " * LONG in text or "\n" * LONG in text:
            return False
        return max(map(len, text.split()), default=0) < LONG

    def encode(self, text: str | None, end: bytes) -> bytes:
        """Plain texts are merged by the same vocabulary's ranks, which is faster; all others by the library."""
        if not text:
            return end
        if self.is_plain(text):
            return self.plain.encode_to_numpy(text).astype("<u2").tobytes() + end
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes() + end


@functools.cache
def ids_of(path: str, ranks: str) -> Ids:
    return Ids(path, ranks)


def knapsack(lengths: np.ndarray, prices: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The best price that fits in each room up to the window, and the length, as its place, to put there first (-1: none fits).

    lengths fall; of equal prices the longest length is taken.
    """
    best, first = np.zeros(window + 1), np.full(window + 1, -1)
    fitting = np.searchsorted(-lengths, -np.arange(window + 1)).tolist()
    for room in range(int(lengths[-1]), window + 1):
        a = fitting[room]
        priced = best[room - lengths[a:]] + prices[a:]
        i = int(priced.argmax())
        best[room], first[room] = priced[i], a + i
    return best, first


def configurations(counts: np.ndarray, window: int) -> dict[tuple[int, ...], float]:
    """Configurations, as falling lengths, with fractions: together they hold at most counts[l] pieces of each length l, and nearly all.

    Each step prices the lengths anew and takes, for each length, the best configuration that holds it, as far as the step's share of
    each length lasts. At first only full configurations are let in, later those with a gap.
    """
    lengths = np.flatnonzero(counts)[::-1]
    total = counts[lengths].astype(float)
    left, found, gap = total.copy(), defaultdict(float), 0
    for _ in range(STEPS):
        open_ = np.flatnonzero(left > 1e-9)
        if not len(open_) or gap > MOST_GAP:
            break
        # a length's weight is its share of all tokens, falling with what is covered
        size, covered = lengths[open_], 1 - left[open_] / total[open_]
        _, first = knapsack(size, size * np.exp(-RATE * (covered - covered.min())), window)
        budget = np.minimum(left[open_], SHARE * total[open_])
        used = budget.copy()
        for i in range(len(open_)):
            held, room = [i], window - int(size[i])
            while first[room] >= 0:
                held.append(int(first[room]))
                room -= int(size[held[-1]])
            items, times = np.unique(held, return_counts=True)
            amount = float((budget[items] / times).min())
            if room <= gap and amount > 0:
                budget[items] -= amount * times
                found[tuple(size[sorted(held)].tolist())] += amount
        used -= budget
        if float(used @ size) < PROGRESS * float(left[open_] @ size):
            gap = max(1, 2 * gap)
        left[open_] -= used
    return found


def best_fit(counts: np.ndarray, window: int) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing over a histogram: equal bins are handled together."""
    rooms: list[int] = []
    bins: dict[int, list[list]] = defaultdict(list)

    def put(held: tuple[int, ...], n: int, room: int) -> None:
        if not bins[room]:
            bisect.insort(rooms, room)
        bins[room].append([held, n])

    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else window
            each = min(room // length, n)
            held, most = bins[room][-1] if at < len(rooms) else ((), n)
            used = min(most, n // each)
            if at < len(rooms):
                bins[room][-1][1] -= used
                if not bins[room][-1][1]:
                    bins[room].pop()
                if not bins[room]:
                    rooms.pop(at)
            put(held + (length,) * each, used, room - each * length)
            n -= used * each
    found: dict[tuple[int, ...], int] = defaultdict(int)
    for some in bins.values():
        for held, n in some:
            found[held] += n
    return found


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, times): whole configurations that hold exactly counts[l] pieces of each length l."""
    left, whole, carry = counts.astype(np.int64).copy(), defaultdict(int), 0.0
    for held, amount in sorted(configurations(counts, window).items(), key=lambda x: (-x[1], x[0])):
        items, times = np.unique(held, return_counts=True)
        n = min(int(amount + carry), int((left[items] // times).min()))
        carry = min(amount + carry - n, 1.0)
        if n > 0:
            left[items] -= n * times
            whole[held] += n
    for held, n in best_fit(left, window).items():
        whole[held] += n
    return sorted(whole.items())


def places(whole: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of each length go: sorted length << 40 | first number; its first sequence, pieces in a sequence and offset."""
    rows, taken, sequence = [], defaultdict(int), 0
    for held, n in whole:
        offset = 0
        for length in sorted(set(held), reverse=True):
            each = held.count(length)
            rows.append((length << 40 | taken[length], taken[length], sequence, each, offset))
            taken[length] += each * n
            offset += each * length
        sequence += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def encoded(docs: DataFrame, path: str, ranks: str, end_id: int, window: int) -> DataFrame:
    """(_p, doc_id, short, number, full, before, ids): each row's ids with the length of its shorter piece (0: none), how many of that length and
    how many full windows its partition has before it, and its own full windows."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, part = ids_of(path, ranks), TaskContext.get().partitionId()
        end, seen, before = int(end_id).to_bytes(2, "little"), [0] * window, 0
        for batch in small_batches(batches):
            ids = [known.encode(text, end) for text in batch.column(1).to_pylist()]
            rows = []
            for x in ids:
                full, short = divmod(len(x) // 2, window)
                rows.append((short, seen[short], full, before))
                seen[short] += 1
                before += full
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column(0), *columns, pa.array(ids, pa.binary())], ["_p", "doc_id", "short", "number", "full", "before", "ids"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(encode, "_p int, doc_id bigint, short bigint, number bigint, full bigint, before bigint, ids binary")


def pack_best(docs: DataFrame, path: str | None = None, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    spark = docs.sparkSession
    table = written(encoded(docs, path or public_tokenizers.path(VOCABULARY), ranks or public_tokenizers.path(RANKS), end_id, window), "ids")
    sizes = table.groupBy("short", "_p").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("short").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written(sizes.withColumn("past", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("bigint")), "sizes")
    counts = np.zeros(window + 1, np.int64)
    for short, c in sizes.filter("short > 0").groupBy("short").agg(F.sum("c")).collect():  # fewer rows than a window has tokens
        counts[short] = c
    whole = plan(counts, window)
    first_full = sum(n for _, n in whole)
    where = spark.sparkContext.broadcast(places(whole))
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def cut(batches):
        import zlib

        import pyarrow as pa

        keys, numbers, sequences, each, offsets = where.value
        for batch in batches:
            short, number, full = (np.asarray(batch.column(c)) for c in (1, 2, 3))
            at = np.maximum(np.searchsorted(keys, short << 40 | number, "right") - 1, 0)
            if len(keys):
                group, copy = np.divmod(number - numbers[at], each[at])
                sequence, offset = sequences[at] + group, offsets[at] + copy * short
            else:
                sequence = offset = np.zeros(len(short), np.int64)
            rows = []
            docs, all_ids = batch.column(0).to_pylist(), batch.column(4)
            for i, doc in enumerate(docs):
                ids = np.frombuffer(all_ids[i].as_buffer(), "<u2").astype("<u4")
                begin, piece = 0, 0
                if short[i]:
                    begin = int(short[i])
                    rows.append((doc, 0, 0, begin, zlib.crc32(ids[:begin].tobytes()), int(sequence[i]), int(offset[i])))
                    piece = 1
                for k in range(piece, piece + (len(ids) - begin) // window):
                    rows.append((doc, k, begin, window, zlib.crc32(ids[begin : begin + window].tobytes()), first_full + int(full[i]) + k - piece, 0))
                    begin += window
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if j == 1 else pa.int64()) for j, c in enumerate(columns)], [x.split()[0] for x in kinds.split(", ")])

    table = add_offsets(table, F.col("full")).join(few(sizes.select("short", "_p", "past"), OFFSETS), ["short", "_p"])
    return table.select("doc_id", "short", (F.col("past") + F.col("number")).alias("number"), (F.col("_off") + F.col("before")).alias("full"), "ids").mapInArrow(cut, kinds)
