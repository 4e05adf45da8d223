"""Packing of documents into fixed windows of tokens: concatenate and cut.

Pass 1 encodes each document once and writes its ids with the partition, the tokens before it in the partition and its
own count. The partitions' totals, one row each, are summed up to global offsets. Pass 2 cuts every document where its
global range crosses a multiple of the window: a record for each piece. All windows but the last are full.

Nulls and edge cases: a null or empty text is a document of its end id alone. Every row is a document of its own,
repeated ones and those of null id too. A document longer than a window is cut into several pieces. An empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_offsets, small_batches, written

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW = 4096
#: A worker forgets the encodings it has remembered when there are this many.
REMEMBERED = 1_000_000


#: Texts of these characters are split here as by the library's own pattern, once they are lower-cased.
SAFE = re.compile("[\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in this kind of vocabulary: itself if it is shown, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Words(dict):
    """Ids, as bytes of 16-bit integers, of the words met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.letters = byte_letters()

    def learn(self, new: set[str]) -> None:
        """Each new word goes to the library's merges, spelt in the vocabulary's letters."""
        merge, letters = self.tokenizer.model.tokenize, self.letters
        for word in new:
            spelt = word if word.isascii() else "".join(letters[b] for b in word.encode())
            self[word] = b"".join([t.id.to_bytes(2, "little") for t in merge(spelt)])

    def encode_all(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """The texts' ids and end. Texts of other characters or with special strings go to the library as a whole."""
        cut = [SPLIT.findall(x.lower()) if SAFE.fullmatch(x) and "<|" not in x else None for x in ((t or "") for t in texts)]
        met = set().union(*filter(None, cut))
        if new := met - self.keys():
            if len(self) + len(new) > REMEMBERED:
                self.clear()
                new = met
            self.learn(new)
        odd = self.tokenizer.encode_batch_fast([x for x, c in zip(texts, cut, strict=True) if c is None], add_special_tokens=False)
        odd = iter(odd)
        return [b"".join(map(self.__getitem__, c) if c is not None else (i.to_bytes(2, "little") for i in next(odd).ids)) + end for c in cut]


@functools.cache
def words(path: str) -> Words:
    return Words(path)


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(_p, doc_id, before, doc_tokens, ids): each row's ids with its partition and the tokens before it there."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, part, before = words(path), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(2, "little")
        for batch in small_batches(batches):
            ids = known.encode_all(batch.column(1).to_pylist(), end)
            starts, sizes = [], []
            for x in ids:
                starts.append(before)
                sizes.append(len(x) // 2)
                before += len(x) // 2
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["_p", "doc_id", "before", "doc_tokens", "ids"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(encode, "_p int, doc_id bigint, before bigint, doc_tokens bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece."""
    table = add_offsets(written(encoded(docs, path or public_tokenizers.path(VOCABULARY), end_id), "ids"), F.col("doc_tokens"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc, first, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(first + start, window)
                    n = min(window - offset, len(ids) - start)
                    rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), sequence, offset))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)

    table = table.select("doc_id", (F.col("_off") + F.col("before")).alias("first"), "ids")
    return table.mapInArrow(cut, ", ".join(f"{n} bigint" for n in names))
