"""Exact substring deduplication: every byte covered by a string of MIN_BYTES that also starts earlier is removed.

A corpus-wide suffix array isn't built. Each window of MIN_BYTES bytes belongs to the smallest hash of its GRAM-byte substrings, so
that equal windows belong to equal hashes; the windows of a text that lie side by side and belong to one hash form a
piece. Only pieces whose hash occurs with another piece can hold a repeat. Three exchanges find them:

1. Pieces (hash of the smallest gram, hash of the piece, place) are grouped by gram. A piece that occurred before is removed as a
   whole. Pieces that share their gram with other ones are to be compared.
2. The texts meet their documents' pieces, by document, and give the bytes of those that are to be compared.
3. Pieces of the same gram meet again. Each task takes whole groups up to BWT_BYTES, makes the Burrows-Wheeler transform
   of their concatenation, and expands intervals breadth-first: starting from the empty string, each interval of suffixes
   with a common prefix is extended backwards by every byte before it, and the boundaries found in round l are those where
   neighbouring suffixes share exactly l bytes. The expansion stops at MIN_BYTES: what then has no boundary between it
   shares at least that much, and all windows of such an interval but the earliest are repeats.

Finally texts and removed ranges meet by document; the texts' exchange is that of step 2.

Hot groups: a batch's equal pieces are reduced to their first before they are shuffled. A gram with more than
GROUP pieces sends single windows instead, keyed by their own hashes and reduced to a slice's first. Windows of one key stream
through their task in the order of their places: it holds the first, compares the others with it byte by byte, and they are repeats.

Order: a document of smaller id is earlier, in a document the smaller place. Nulls and edge cases: a null text has 0
bytes. Texts under MIN_BYTES are never cut. Matches never cross documents. Rows that repeat doc_id and text are one document, whose row is
returned as often and isn't a repeat of itself; see keyed_documents for null and ambiguous ids. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import binary_text, keyed_documents, repeat_rows, small_batches

MIN_BYTES = 100
GRAM = 32
#: Windows in a piece, at most; longer runs are split.
RUN = 256
#: Pieces of one gram that are compared in one task, at most.
GROUP = 2000
BWT_BYTES = 1 << 20
PART_BYTES = 1 << 19
#: Bytes of text of which a task holds the pieces at a time.
SLICE_BYTES = 4 << 20

REMOVED, COMPARE, SINGLE = 0, 1, 2


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram bytes from every place, by doubling; gram is a power of two."""
    h, n, base = hashing.BYTE[data], 1, np.array(hashing.BASE)
    while n < gram:
        h = h[:-n] * base + h[n:] if len(h) > n else h[:0]
        base = np.multiply(base, base)
        n *= 2
    return hashing.mix(h)


def sliding(least, h: np.ndarray, width: int) -> np.ndarray:
    """The least (np.minimum or np.maximum) of each width values side by side."""
    n = 1
    while 2 * n <= width:
        h = least(h[:-n], h[n:])
        n *= 2
    return least(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def occur_twice(grams: np.ndarray, low: np.ndarray, width: int, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pieces (starts, length) hold their smallest gram more than once, so that their own windows may repeat."""
    edge = np.zeros(width - 1, np.uint64)
    # no window's smallest gram is above a gram that it holds, so the largest of them tells whether it is one's smallest
    at = np.flatnonzero(sliding(np.maximum, np.concatenate([edge, low, edge]), width) == grams)
    begin, end = np.searchsorted(at, starts), np.searchsorted(at, starts + length + width - 1)
    sizes = end - begin
    turn = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    which = np.repeat(np.arange(len(starts)), sizes)
    same = grams[at[begin[which] + turn]] == low[starts][which]
    return np.bincount(which[same], minlength=len(starts)) > 1


def pieces_of(data: np.ndarray, cuts: np.ndarray, size: int, gram: int):
    """(document, start, windows, gram's hash, piece's hash) of the pieces of the texts between cuts.

    The number of windows is negative if the gram occurs twice in the piece.
    """
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = gram_hashes(data, gram)
    low = sliding(np.minimum, grams, size - gram + 1)
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[: len(low)]
    whole = cuts[doc + 1] - np.arange(len(low)) >= size  # the window ends in its document
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    new &= whole
    starts = np.flatnonzero(new)
    # a run lasts to the next start or the first window that leaves its document
    limit = np.minimum(np.append(starts[1:], len(low)), cuts[doc[starts] + 1] - size + 1)
    length = limit - starts
    if len(length) and length.max() > RUN:
        times = -(-length // RUN)
        turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, limit = np.repeat(starts, times) + turn * RUN, np.repeat(limit, times)
        length = np.minimum(limit - starts, RUN)
    whole = hashing.span_hashes(data, starts, starts + length + size - 1)
    length = np.where(occur_twice(grams, low, size - gram + 1, starts, length), -length, length)
    return doc[starts], starts - cuts[doc[starts]], length, low[starts], whole


def first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Which of the sorted rows differ in a key from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return hashing.mix(doc.astype(np.uint64) * np.uint64(0x10001) + start.astype(np.uint64)).view(np.int64)


def find_pieces(size: int, gram: int):
    """Step 1, before the exchange: kind, key, piece, doc, start, n; a batch's repeated pieces are removed at once."""

    def run(batches):
        import pyarrow as pa

        for batch in small_batches(batches, limit=SLICE_BYTES):
            ids = np.asarray(batch.column(0))
            values, offsets = binary_text(batch)
            found = []
            for a, b in hashing.parts(offsets, PART_BYTES):
                doc, *rest = pieces_of(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, gram)
                found.append((ids[a + doc], *rest))
            if not found:
                continue
            doc, start, n, low, whole = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((start, doc, whole, low))
            doc, start, n, low, whole = (c[order] for c in (doc, start, n, low, whole))
            first = first_of_each(low, whole)
            key = np.where(first, low.view(np.int64), spread(doc, start))
            kind = np.where(first, COMPARE, REMOVED).astype(np.int8)
            out = pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, key, whole.view(np.int64), doc, start.astype(np.int32), n.astype(np.int16))], ["kind", "key", "piece", "doc", "start", "n"])
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

    return run


def judge_pieces(batches):
    """Step 1, after the exchange, sorted by key, piece, doc and start: kind, key, doc, start, n.

    A gram's distinct pieces are held until there are more than GROUP of them, or the gram ends.
    """
    import pyarrow as pa

    held = None  # distinct pieces of the last gram so far: key, piece, doc, start, n
    hot = None  # the last gram, if it has too many

    def out(kind, key, doc, start, n):
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int8(kind), key.shape) if np.isscalar(kind) else kind), *(pa.array(c) for c in (key, doc, start, np.abs(n)))], ["kind", "key", "doc", "start", "n"])

    for batch in batches:
        kind, *cols = (np.asarray(c) for c in batch.columns)
        gone = kind == REMOVED
        if gone.any():
            key, _, doc, start, n = (c[gone] for c in cols)
            yield out(REMOVED, key, doc, start, n)
        cols = [c[~gone] for c in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        key, piece, doc, start, n = cols
        first = first_of_each(key, piece)
        if not first.all():
            again = ~first
            yield out(REMOVED, spread(doc[again], start[again]), doc[again], start[again], n[again])
        key, piece, doc, start, n = (c[first] for c in cols)
        last = int(np.searchsorted(key, key[-1]))
        yield from decide(out, hot, key[:last], doc[:last], start[:last], n[:last])
        tail = [c[last:] for c in (key, piece, doc, start, n)]
        if hot is not None and hot != tail[0][0]:
            hot = None
        if hot is not None or len(tail[0]) > GROUP:
            hot = tail[0][0]
            yield out(SINGLE, *(tail[i][:-1] for i in (0, 2, 3, 4)))
            tail = [c[-1:] for c in tail]  # repeats of it may follow
        held = tail
    if held is not None:
        yield from decide(out, hot, held[0], held[2], held[3], held[4])


def decide(out, hot, key, doc, start, n):
    """Pieces of whole grams: one alone is unique unless it holds the gram twice; large groups are compared by window."""
    if not len(key):
        return
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.repeat(np.diff(np.append(new, len(key))), np.diff(np.append(new, len(key))))
    large = (count > GROUP) | (key == hot if hot is not None else False)
    some = (count > 1) | large | (n < 0)
    if some.any():
        kind = np.where(large, SINGLE, COMPARE).astype(np.int8)[some]
        yield out(kind, key[some], doc[some], start[some], n[some])


def cut_bytes(size: int):
    """Step 2: of documents with their lists of pieces, the removed ranges and the bytes to compare (key, doc, start, n, bytes).

    Single windows are keyed by their own hash and marked by n = 0; of a batch's equal ones only the first is compared.
    """

    def run(batches):
        import pyarrow as pa

        names = ["key", "doc", "start", "n", "bytes"]
        for batch in small_batches(batches, limit=SLICE_BYTES):
            values, offsets = binary_text(batch)
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            flat = lists.flatten()
            kind, key, start, n = (np.asarray(flat.field(i)) for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            doc, at = np.asarray(batch.column(0))[row], offsets[row] + start
            gone = np.flatnonzero(kind == REMOVED)
            gone = gone[np.lexsort((start[gone], row[gone]))]
            if len(gone):  # side by side: one range
                r, s, e = row[gone], start[gone].astype(np.int64), start[gone].astype(np.int64) + n[gone]
                new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != e[:-1])))
                ends = e[np.append(new[1:], len(s)) - 1]
                d, s = doc[gone][new], s[new]
                yield from rows_of(names, spread(d, s), d, s, ends - s, None)
            some = np.flatnonzero(kind == COMPARE)
            if len(some):
                yield from rows_of(names, key[some], doc[some], start[some], n[some], [values[a : a + k + size - 1].tobytes() for a, k in zip(at[some], n[some].astype(np.int64), strict=True)])
            some = np.flatnonzero(kind == SINGLE)
            if len(some):
                times = n[some].astype(np.int64)
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                d, s, a = np.repeat(doc[some], times), np.repeat(start[some].astype(np.int64), times) + turn, np.repeat(at[some], times) + turn
                base = a.min()
                h = hashing.span_hashes(values[base : a.max() + size], a - base, a - base + size)
                order = np.lexsort((s, d, h))
                d, s, a, h = (c[order] for c in (d, s, a, h))
                first = first_of_each(h)
                yield from rows_of(names, spread(d[~first], s[~first]), d[~first], s[~first], np.ones((~first).sum(), np.int64), None)
                yield from rows_of(names, h[first].view(np.int64), d[first], s[first], np.zeros(first.sum(), np.int64), [values[i : i + size].tobytes() for i in a[first]])

    def rows_of(names, key, doc, start, n, blobs):
        for i in range(0, len(key), 20_000):
            cut = slice(i, i + 20_000)
            yield pa_batch(names, key[cut], doc[cut], start[cut], n[cut], blobs[cut] if blobs is not None else None)

    def pa_batch(names, key, doc, start, n, blobs):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(n, np.int32)), pa.array(blobs, pa.binary()) if blobs is not None else pa.nulls(len(key), pa.binary())], names)

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of text in the order of their first depth symbols or more, then of their places.

    Prefix doubling of what is still tied. Symbols take 9 bits; a key of 63 bits has the first seven.
    """
    n, h = len(text), 7
    padded = np.zeros(n + h, np.int64)
    padded[:n] = text
    key = padded[:n]
    for i in range(1, h):
        key = key << 9 | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    head = first_of_each(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while h < depth:
        tied = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in groups of several
        if not len(tied):
            break
        at = order[tied]
        own, following = rank[at], np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        again = np.argsort(own << 32 | following, kind="stable")
        at, own, following = at[again], own[again], following[again]
        order[tied], head[tied] = at, first_of_each(own, following)
        rank[at] = np.maximum.accumulate(np.where(head[tied], tied, 0))
        h *= 2
    return order


def common_prefix_groups(text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): the suffixes in order, and where a suffix shares fewer than size symbols with the one before.

    text ends in a symbol below all others. Breadth-first backward extension on the Burrows-Wheeler transform: the
    interval of suffixes that begin with w gives, for each symbol c before them, that of cw. In round l such an interval's
    end is a boundary of l - 1 common symbols, unless it was found before; only intervals that find one are followed.
    """
    n = len(text)
    order = suffix_order(text, size + 1)
    transform = text[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    to = np.empty(n, np.int64)  # where the suffix one symbol longer stands
    to[by_symbol] = np.arange(n)
    starts_with = transform[by_symbol]
    head = np.zeros(n + 1, bool)
    low = np.flatnonzero(first_of_each(starts_with))
    high = np.append(low[1:], n)
    head[low] = head[n] = True
    for _ in range(1, size):
        if not len(low):
            break
        sizes = high - low
        at = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        target = to[at]
        again = np.argsort(target, kind="stable")
        target, which = target[again], np.repeat(np.arange(len(low)), sizes)[again]
        begin = np.flatnonzero(first_of_each(target - np.arange(len(target)), which, starts_with[target]))
        ends = target[np.append(begin[1:], len(target)) - 1] + 1
        new = ~head[ends]
        head[ends] = True
        low, high = target[begin][new], ends[new]
    return order, head[:n]


def repeated_windows(blobs: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the windows of the pieces that are equal to an earlier one among them."""
    sizes = np.array([len(b) + 1 for b in blobs])
    at = np.cumsum(sizes) - sizes
    text = np.zeros(sizes.sum() + 1, np.int64)
    text[:-1] = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
    text[:-1] += 2
    text[at + sizes - 1] = 1
    order, head = common_prefix_groups(text, size)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    owner = np.full(len(text), -1, np.int64)  # of the places where a window starts
    owner[np.repeat(at, n) + turn] = np.repeat(np.arange(len(n)), n)
    group = np.cumsum(head)
    kept = owner[order] >= 0
    place, group = order[kept], group[kept]
    who = owner[place]
    d, s = doc[who], start[who] + place - at[who]
    again = np.lexsort((s, d, group))
    later = ~first_of_each(group[again])
    return d[again][later], s[again][later]


class Windows:
    """Single windows, as they come sorted by key, doc and start: holds the different windows of the last key, nearly always one."""

    def __init__(self):
        self.key, self.firsts = None, set()

    def repeats(self, key: np.ndarray, blobs: list[bytes]) -> np.ndarray:
        """Which windows equal an earlier one."""
        again = np.zeros(len(key), bool)
        for i, (k, b) in enumerate(zip(key.tolist(), blobs, strict=True)):
            if k != self.key:
                self.key, self.firsts = k, {b}
            elif b in self.firsts:
                again[i] = True
            else:
                self.firsts.add(b)
        return again


def compare_pieces(size: int):
    """Step 3, sorted by key, doc and start: the removed ranges (doc, start, n), those from before and those found."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []  # keys, docs, starts, windows and bytes not yet compared
        held_bytes = 0
        windows = Windows()

        def out(doc, start, n):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(n, np.int32))], ["doc", "start", "n"])

        def compare(key, doc, start, n, blobs):
            cuts = np.flatnonzero(first_of_each(key))
            weight = np.cumsum([len(b) for b in blobs])
            a = 0
            while a < len(key):  # whole groups, of about BWT_BYTES
                b = int(np.searchsorted(weight, (weight[a - 1] if a else 0) + BWT_BYTES, "right"))
                after = cuts[cuts > max(b, a)]
                b = int(after[0]) if len(after) else len(key)
                d, s = repeated_windows(blobs[a:b], doc[a:b], start[a:b], n[a:b], size)
                a = b
                if len(d):
                    o = np.lexsort((s, d))
                    d, s = d[o], s[o]
                    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)))
                    ends = s[np.append(new[1:], len(s)) - 1] + 1
                    yield out(d[new], s[new], ends - s[new])

        for batch in batches:
            key, doc, start, n = (np.asarray(batch.column(i)) for i in range(4))
            blobs = batch.column(4)
            old = np.asarray(blobs.is_null())
            if old.any():
                yield out(doc[old], start[old], n[old])
            single = np.flatnonzero(~old & (n == 0))
            if len(single):
                again = single[windows.repeats(key[single], blobs.take(pa.array(single)).to_pylist())]
                yield out(doc[again], start[again], np.ones(len(again), np.int32))
            some = np.flatnonzero(~old & (n > 0))
            if not len(some):
                continue
            held.append((key[some], doc[some], start[some].astype(np.int64), n[some].astype(np.int64), blobs.take(pa.array(some)).to_pylist()))
            held_bytes += sum(map(len, held[-1][4]))
            if held_bytes > BWT_BYTES:
                *cols, texts = join(held)
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                if last:
                    yield from compare(*(c[:last] for c in cols), texts[:last])
                held = [(*(c[last:] for c in cols), texts[last:])]
                held_bytes = sum(map(len, texts[last:]))
        if held:
            *cols, texts = join(held)
            yield from compare(*cols, texts)

    def join(held):
        return (*(np.concatenate(c) for c in list(zip(*held, strict=True))[:4]), [b for h in held for b in h[4]])

    return run


def removed_ranges(texts: DataFrame, direct: DataFrame, size: int, gram: int) -> DataFrame:
    """(_k, removed): per document the ranges of window starts that are repeats. texts: direct, partitioned by _k."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = direct.mapInArrow(find_pieces(size, gram), "kind tinyint, key bigint, piece bigint, doc bigint, start int, n smallint")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "piece", "doc", "start")
    rows = rows.mapInArrow(judge_pieces, "kind tinyint, key bigint, doc bigint, start int, n smallint")
    lists = rows.groupBy(F.col("doc").alias("_k")).agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("pieces"))
    rows = texts.join(lists, "_k").mapInArrow(cut_bytes(size), "key bigint, doc bigint, start int, n int, bytes binary")
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "doc", "start")
    rows = rows.mapInArrow(compare_pieces(size), "doc bigint, start int, n int")
    return rows.groupBy(F.col("doc").alias("_k")).agg(F.collect_list(F.struct("start", "n")).alias("removed"))


def covered(length: int, ranges, size: int) -> np.ndarray:
    """Which bytes lie in a removed window."""
    step = np.zeros(length + 1, np.int64)
    start, n = (np.asarray(ranges.field(i)).astype(np.int64) for i in range(2))
    np.add.at(step, start, 1)
    np.add.at(step, start + n + size - 1, -1)
    return np.cumsum(step[:-1]) > 0


def with_ranges(keyed: DataFrame, size: int, gram: int) -> DataFrame:
    """_k, text and removed of the keyed documents."""
    if size < gram or gram & (gram - 1):
        raise ValueError("gram must be a power of two, at most size")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the filter that an inner join adds stands here for the outer join too, so that both read one exchange
    direct = keyed.select("_k", "text").filter("_k is not null")
    texts = direct.repartition(parts, "_k")
    return texts.join(removed_ranges(texts, direct, size, gram), "_k", "left").select("_k", "text", "removed")


def digests(docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    keyed, odd = keyed_documents(docs)

    def digest(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            values, offsets = binary_text(batch)
            rows = []
            for i, ranges in enumerate(batch.column(2)):
                own = values[offsets[i] : offsets[i + 1]]
                gone, spans = 0, 0
                if ranges.is_valid:
                    cut = covered(len(own), ranges.values, size)
                    gone, spans = int(cut.sum()), int(np.count_nonzero(np.diff(np.append(False, cut).astype(np.int8)) == 1))
                    own = own[~cut]
                rows.append((int(offsets[i + 1] - offsets[i]), gone, spans, hashlib.sha256(own.tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_ranges(keyed, size, gram).mapInArrow(digest, "_k bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    if not odd:
        return out.withColumnRenamed("_k", "doc_id")
    return repeat_rows(out.join(keyed.select("_k", "doc_id", "_n"), "_k")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def kept_texts(keyed: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(_k, text) with what is left of each text. A character that loses some of its bytes is dropped with them."""

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            values, offsets = binary_text(batch)
            texts = []
            for i, ranges in enumerate(batch.column(2)):
                own = values[offsets[i] : offsets[i + 1]]
                if ranges.is_valid:
                    own = own[~covered(len(own), ranges.values, size)]
                texts.append(own.tobytes().decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_k", "text"])

    return with_ranges(keyed, size, gram).mapInArrow(keep, "_k bigint, text string")


def shorten_documents(docs: DataFrame, size: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """The rows of docs without repeated bytes in text, with all columns of docs; n_chars, if there, is counted anew.

    The other columns travel as one struct, so that none of them can clash with a column of this module.
    """
    keyed, odd = keyed_documents(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row")
    if odd:
        rows = docs.select(row, F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_words"))
        keys = keyed.select("_k", F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))
        full = rows.join(keys, F.col("_id").eqNullSafe(F.col("_doc_id")) & F.col("_words").eqNullSafe(F.col("_text"))).select("_k", "_row")
    else:
        full = docs.select(F.col("doc_id").cast("bigint").alias("_k"), row)
    out = full.join(kept_texts(keyed, size, gram), "_k")
    new = {"text": F.col("text"), **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
