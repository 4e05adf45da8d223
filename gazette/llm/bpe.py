"""Byte-level BPE encoding and decoding, with the merges as a Spark expression.

A block of documents (BLOCK_BYTES of text) becomes one row: the words (matches of the pattern) that its task hasn't met
before and, for each document, its words' numbers. Spark higher-order functions then fold the ranked merges over each word's bytes: every step
looks up the ranks of all neighbouring pieces in a literal rank map and joins the first pair of the lowest rank. The
blocks are put together again from the words' ids, and decoding concatenates the binary pieces that the ids stand for. No text
is shuffled, and a task merges a word once. The words of a bounded sample of the documents, of which each task would meet the frequent ones,
are merged by the same fold beforehand and broadcast; the sample only saves work, as all other words are merged where they stand.

The rank map is a literal array in which the rows of all left ids lie across each other, so that one look finds a pair of neighbours; a lookup in
a Spark map reads all of it. The fold's work grows with the square of a word's length: words of more than LONG_WORD bytes, such as a
megabyte without a space, are merged in the task by a heap of neighbouring pairs.

Nulls and edge cases: a null or empty text has no ids and decodes to an empty text. Rows are encoded one by one, repeated
or with a null id alike. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .token_count import SAFE, SPLIT

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK_BYTES = 2 << 20
#: Words of a sample of the documents that are merged beforehand and sent to all tasks, at most; the sample has one document in SAMPLE_STEP by
#: the hash of doc_id, or about SAMPLE_DOCS of more.
SHARED, SAMPLE_STEP, SAMPLE_DOCS = 400_000, 16, 200_000
#: Distinct words that a task numbers before it starts again.
WORDS = 1_000_000
LONG_WORD = 512
#: Above all ids.
NO_ID = 1 << 16
#: An entry of two_tables that no pair has.
EMPTY = 0
#: The starts of rows in the rank map are below START. What its lookup gives is below JOINABLE if two pieces can be joined; NO_PAIR is an entry of none.
START, JOINABLE, NO_PAIR = 1 << 20, 1 << 36, 1 << 50
#: What stands before the ids of a word that no merge is left for.
DONE = -1


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id + 1) << 32 | right id << 16 -> id, for the last merge of every piece of more than one byte.

    A piece inside a word comes about by the merges that it takes alone, as long as none of them crosses its ends. So it has one last
    merge, and no other two pieces that spell it ever stand side by side.
    """
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("ids of more than 16 bits")
    found = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], NO_ID), i) for i in range(len(parts) - 1))
            if low == NO_ID:
                break  # merges don't lead to this piece
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found[ranks[parts[0]] + 1 << 32 | ranks[parts[1]] << 16] = rank
    return found


def two_tables(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Cuckoo hashing: a pair is in the first table at pair % its length, or in the second. An entry is pair | id, or EMPTY."""
    size = max(64, 4 * len(pairs))
    while True:
        tables = [EMPTY] * (size | 1), [EMPTY] * ((size | 1) + 2)
        for pair, rank in pairs.items():
            entry, side = pair | rank, 0
            for _ in range(500):
                at = (entry >> 16 << 16) % len(tables[side])
                entry, tables[side][at] = tables[side][at], entry
                if entry == EMPTY:
                    break
                side = 1 - side
            if entry != EMPTY:
                break
        else:
            return tables
        size = size * 5 // 4


def dealt_rows(pairs: dict[int, int]) -> dict[int, int]:
    """Where the row of each left id starts in one array, so that no place start + right id is two pairs': the longest rows are placed first."""
    import numpy as np

    rows: dict[int, list[int]] = {}
    for pair in pairs:
        rows.setdefault((pair >> 32) - 1, []).append(pair >> 16 & 0xFFFF)
    taken, starts, at, size = np.zeros(START, bool), {}, 0, 0
    for left, rights in sorted(rows.items(), key=lambda row: (-len(row[1]), row[0])):
        # rows of about one length don't look again where the one before found no place
        at, size = at if len(rights).bit_length() == size else 0, len(rights).bit_length()
        places = np.array(rights)
        while True:
            if at + 64 + 65536 > START:
                raise ValueError("too many merges")
            free = ~taken[places[:, None] + np.arange(at, at + 64)].any(0)
            if free.any():
                break
            at += 64
        at += int(free.argmax())
        taken[places + at] = True
        starts[left] = at
    return starts


@functools.cache
def rank_arrays(path: str) -> tuple[list[int], list[int]]:
    """The array of RankMap, and the pieces of the bytes by their ids."""
    ranks = read_ranks(path)
    pairs = pair_table(ranks)
    starts = dealt_rows(pairs)
    lower = [i << 20 | starts.get(i, 0) for i in range(max(ranks.values()) + 1)]
    table = [NO_PAIR] * (max(starts.values(), default=0) + len(lower))
    for pair, joined in pairs.items():
        left = (pair >> 32) - 1
        table[starts[left] + (pair >> 16 & 0xFFFF)] = (left << 36 | lower[left]) ^ lower[joined]
    return table, [i << 36 | lower[i] for i in range(max(r for piece, r in ranks.items() if len(piece) == 1) + 1)]


class RankMap:
    """The literal rank map as one array, and the lookup of a pair of neighbours in it.

    A piece is id << 36 | id << 20 | start, with the start of the row of its id. A pair's entry is at start + right id: the left piece, XOR the
    joined piece without its upper id. So it gives the joined piece to its own left piece, and JOINABLE or more to any other.
    """

    def __init__(self, path: str):
        self.table, self.singles = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in rank_arrays(path))

    def pieces(self, ids: Column) -> Column:
        """The pieces of bytes, given by their ids."""
        return F.transform(ids, lambda i: F.get(self.singles, i.cast("int")))

    def joined(self, left: Column, right: Column) -> Column:
        return F.get(self.table, (left.bitwiseAND(START - 1) + F.shiftright(right, 36)).cast("int")).bitwiseXOR(left)

    def whole(self, lower: Column) -> Column:
        return lower.bitwiseOR(F.shiftleft(F.shiftright(lower, 20), 36))


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """The ids of a word, given as the ids of its bytes (an array of bigint); at most LONG_WORD of them.

    A step looks up all neighbours and joins the first pair of the lowest rank; a word of n bytes takes n - 1 steps at most. A word without
    such a pair is put behind DONE, which ends the work of all further steps.
    """

    def near(p: Column) -> Column:
        # with their places, which tell equal pairs apart; the last piece has no neighbour and gives null, which array_min() leaves out
        return F.transform(p, lambda x, i: F.shiftleft(ranks.joined(x, F.get(p, i + 1)), 10).bitwiseOR(i))

    def step(p: Column) -> Column:
        # array_min(...) evaluated once; get(transform(...), 0) would derive the type anew for every row
        return F.aggregate(F.array(F.array_min(near(p))), p, lambda p, low: F.when(low < JOINABLE << 10, join(p, ranks.whole(F.shiftright(low, 10)), low.bitwiseAND(1023).cast("int"))).otherwise(F.concat(F.array(F.lit(DONE).cast("bigint")), p)))

    def join(p: Column, piece: Column, at: Column) -> Column:
        return F.filter(F.transform(p, lambda x, i: F.when(i == at, piece).otherwise(x)), lambda x, i: i != at + 1)

    done = lambda p: F.get(p, F.lit(0)) == DONE
    merged = F.aggregate(F.slice(word, F.lit(2), F.size(word)), ranks.pieces(word), lambda p, _: F.when(done(p), p).otherwise(step(p)), lambda p: F.when(done(p), F.slice(p, F.lit(2), F.size(p))).otherwise(p))
    return F.transform(merged, lambda x: F.shiftright(x, 36))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n, for one long word: a heap of pairs over a linked list of pieces."""
    ends, after, before = list(range(1, len(word) + 1)), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if ends[i] < 0 or j >= len(word) or ends[j] != end:
            continue  # one of the two has changed since
        ends[i], after[i], ends[j] = end, after[j], -1
        if after[i] < len(word):
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:end])) is not None:
            heapq.heappush(heap, (r, k, end))
    return [ranks[word[i : ends[i]]] for i in range(len(word)) if ends[i] > 0]


BLOCK = T.StructType([
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("spans", T.BinaryType()),  # int64 ends of the documents in codes
    T.StructField("codes", T.BinaryType()),  # int32 numbers of words
    T.StructField("first", T.IntegerType()),  # the number of the first new word; 0 where numbering starts again
    T.StructField("words", T.ArrayType(T.ArrayType(T.LongType()))),  # the new words, as the ids of their bytes
    T.StructField("long_words", T.ArrayType(T.ArrayType(T.LongType()))),  # the ids of those that are too long for the fold, else null
])


@functools.cache
def splitter(pattern: str):
    import regex

    return regex.compile(pattern).findall


def split(text: str, any_split, own: bool) -> list[str]:
    return SPLIT.findall(text) if own and SAFE.fullmatch(text) else any_split(text)


class Shared:
    """The words that all tasks know: their numbers, and the ids of all, one after another. Sent as arrays, read once a worker."""

    def __init__(self, words: list[str], ends, values):
        import numpy as np

        self.text, self.spaces, self.ends, self.values = "".join(words), np.cumsum([len(w) for w in words], dtype=np.int64), np.asarray(ends, np.int64), np.asarray(values, np.int32)

    @functools.cached_property
    def numbers(self) -> dict[str, int]:
        at = [0, *self.spaces.tolist()]
        return {self.text[a:b]: i for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))}


class Numbers(dict):
    """The numbers of words in the order in which they are met, from first on."""

    def __init__(self, first: int):
        self.first = first

    def __missing__(self, word: str) -> int:
        n = self[word] = self.first + len(self)
        return n


class Blocks:
    """Blocks of documents as numbers of words: first those of shared, then the task's own, which start anew after WORDS of them."""

    def __init__(self, path: str, pattern: str, shared: dict[str, int]):
        import numpy as np

        self.ranks, self.any_split, self.own = read_ranks(path), splitter(pattern), pattern == public_tokenizers.PATTERN
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.shared, self.words = shared, Numbers(len(shared))
        self.start()

    def start(self) -> None:
        if len(self.words) >= WORDS:
            self.words.clear()
        self.doc_ids, self.codes, self.bytes, self.first = [], [], 0, len(self.words)

    def add(self, doc_id: int | None, text: str) -> None:
        import numpy as np

        known, shared = self.words, self.shared.get
        self.codes.append(np.array([known[w] if (n := shared(w)) is None else n for w in split(text, self.any_split, self.own)], np.int32))
        self.doc_ids.append(doc_id)
        self.bytes += len(text)

    def batch(self):
        import itertools

        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        new = [w.encode() for w in itertools.islice(self.words, self.first, None)]
        longs = [merge_long(w, self.ranks) if len(w) > LONG_WORD else None for w in new]
        short = [b"" if x else w for w, x in zip(new, longs, strict=True)]
        schema = to_arrow_schema(BLOCK)
        one = [[self.doc_ids], [np.cumsum([len(c) for c in self.codes], dtype=np.int64).tobytes()], [b"".join(c.tobytes() for c in self.codes)], [self.first]]
        columns = [pa.array(x, f.type) for x, f in zip(one, schema, strict=False)]
        # the words' bytes as one array, for which lists of lists would be slow
        bytes_ = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, short)]).astype(np.int32)), pa.array(self.single[np.frombuffer(b"".join(short), np.uint8)]))
        for lists, name in ((bytes_, "words"), (pa.array(longs, pa.list_(pa.int64())), "long_words")):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(new)], pa.int32()), lists).cast(schema.field(name).type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class Encodings:
    """The ids of the words met so far, put together to the documents'."""

    def __init__(self, shared: Shared):
        self.shared = shared
        self.reset()

    def reset(self) -> None:
        import numpy as np

        ends = self.shared.ends
        self.sizes = np.diff(ends, prepend=0)
        self.starts, self.values = ends - self.sizes, self.shared.values

    def learn(self, folded, longs) -> None:
        """Arrow lists of ids; where longs isn't null it has the word's."""
        import numpy as np

        for lists in (folded, longs):
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            starts = len(self.values) + np.cumsum(sizes) - sizes
            self.values = np.concatenate([self.values, np.asarray(lists.flatten()).astype(np.int32)])
            if lists is folded:
                at = len(self.starts)
                self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
            else:
                given = np.flatnonzero(sizes)
                self.starts[at + given], self.sizes[at + given] = starts[given], sizes[given]

    def ids(self, codes):
        """(ids of the words one after another, and where each word's end)."""
        import numpy as np

        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[codes] - (ends - sizes), sizes)
        return self.values[at], ends


def shared_words(docs: DataFrame, path: str, pattern: str) -> Shared:
    """The words of the sample, merged: all, or about SHARED of those in the most of its documents."""
    step = max(SAMPLE_STEP, docs.count() // SAMPLE_DOCS)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.col("text").cast("string").alias("text"))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        any_split, own, found = splitter(pattern), pattern == public_tokenizers.PATTERN, Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(w for w in set(split(text.as_py() or "", any_split, own)) if len(w) <= LONG_WORD // 4)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    single = read_ranks(path)
    single = [single[bytes([i])] for i in range(256)]

    def to_bytes(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(single, np.int64)
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            ends = np.cumsum([0, *map(len, words)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(table[np.frombuffer(b"".join(words), np.uint8)]))], ["word", "bytes"])

    table = written(sample.mapInArrow(count, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "words")
    # how many words there are of each count: few rows, as counts are of documents of the sample
    held, kept = 0, table
    for c, n in table.groupBy("c").count().orderBy(F.desc("c")).collect():
        if held + n > SHARED:
            # of the words of this count as many as there is room for, by their hash
            kept = table.filter((F.col("c") > c) | (F.col("c") == c) & (F.pmod(F.xxhash64("word"), F.lit(n)) < SHARED - held))
            break
        held += n
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept.select("word").repartition(parts, "word").mapInArrow(to_bytes, "word string, bytes array<bigint>")
    found = written(rows.select("word", fold_merges(F.col("bytes"), RankMap(path)).alias("ids")), "shared").toArrow().combine_chunks()
    if not found.num_rows:
        return Shared([], [], [])
    ids = found.column("ids").combine_chunks()
    ids = ids.chunk(0) if hasattr(ids, "num_chunks") else ids
    return Shared(found.column("word").to_pylist(), ids.offsets.to_numpy()[1:] - ids.offsets[0].as_py(), ids.flatten().to_numpy())


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, block: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (array of int) and ids_bytes (little-endian unsigned 32-bit) of each row."""
    path = path or public_tokenizers.path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(shared_words(docs, path, pattern))

    def number_words(batches):
        blocks = Blocks(path, pattern, shared.value.numbers)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blocks.add(doc_id, text.as_py() or "")
                if blocks.bytes >= block:
                    yield blocks.batch()
                    blocks.start()
        if blocks.doc_ids:
            yield blocks.batch()

    def put_together(batches):
        import numpy as np
        import pyarrow as pa

        known = Encodings(shared.value)
        for rows in batches:
            for row in range(rows.num_rows):
                one = {n: rows.column(i)[row] for i, n in enumerate(rows.schema.names)}
                if not one["first"].as_py():
                    known.reset()
                known.learn(one["word_ids"].values, one["long_words"].values)
                ids, word_ends = known.ids(np.frombuffer(one["codes"].as_buffer(), np.int32))
                ends = np.concatenate([[0], np.concatenate([[0], word_ends])[np.frombuffer(one["spans"].as_buffer(), np.int64)]])
                doc_ids = one["doc_ids"].values
                for a in range(0, len(doc_ids), 500):
                    cut = ends[a : a + 501]
                    some = ids[cut[0] : cut[-1]]
                    lists = pa.ListArray.from_arrays(pa.array((cut - cut[0]).astype(np.int32)), pa.array(some))
                    blobs = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(((cut - cut[0]) * 4).astype(np.int32)), pa.py_buffer(some.astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([doc_ids[a : a + 500], lists, blobs], ["doc_id", "ids", "ids_bytes"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = base.mapInArrow(number_words, BLOCK)
    ranks = RankMap(path)
    blocks = blocks.select("doc_ids", "spans", "codes", "first", "long_words", F.transform("words", lambda w: fold_merges(w, ranks)).alias("word_ids"))
    return blocks.mapInArrow(put_together, "doc_id bigint, ids array<int>, ids_bytes binary")


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes that an array of ids stands for: its binary pieces, concatenated."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    pieces_of = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces_of[rank] = piece
    table = F.from_json(F.lit(json.dumps([base64.b64encode(x).decode() for x in pieces_of])), "array<binary>")
    # array_join() takes strings; a binary value becomes one without a change or a check of its bytes
    return F.array_join(F.transform(ids, lambda i: F.get(table.cast("array<string>"), i)), "").cast("binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    out = encode(docs, path)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("ids_bytes", 256).alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
