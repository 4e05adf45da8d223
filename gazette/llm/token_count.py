"""Token counts by a byte-level BPE vocabulary of the tokenizers library, with a shortcut for whole tokens.

Offline, once per Python worker, every vocabulary string is put through the library on its own: those that come back as
the one token they spell, from one pre-token, form the set of whole tokens. A text's pre-tokens that are in the set count
1 without any merging; only the others go through the merges, once per distinct string and worker.

Nulls and edge cases: a null text counts as an empty one, with 0 bytes and 0 tokens. Repeated rows are counted row by
row, rows of null doc_id too. Special strings inside a text are handled as the library does by default. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "byte_bpe_50k.json"
MAX_TOKENS = 1024
#: A worker forgets the counts it has remembered when there are this many.
REMEMBERED = 600_000
#: Texts of these characters alone are split by SPLIT as by the library's own pattern.
SAFE = re.compile("[\\x20-\\x7e\\nÀ-ÖØ-öø-ſ]*")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\\sA-Za-z0-9À-ÖØ-öø-ſ]+|\\s+(?!\\S)|\\s+")


def pieces(text: str) -> list[str] | None:
    """The text cut before each space and line end; None unless all white space is such single characters between others.

    Text may be cut there, as no pre-token spans such a place and none looks beyond it. A piece's leading space is left
    out. The first piece has no space before it: it is marked by a line end, as a piece after a line end is.
    """
    words = text.split()
    n = len(words)
    if n != text.count(" ") + text.count("\n") + 1 or sum(map(len, words)) + n - 1 != len(text):
        return None
    return ("\n" + text).replace("\n", " \n")[1:].split(" ")


class Counts(dict):
    """Tokens of each piece that was met; learn() adds pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.whole_tokens()

    def whole_tokens(self) -> frozenset[str]:
        """The strings of safe characters that the library encodes as exactly the one token which spells them."""
        t = self.tokenizer
        strings = {t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())} - set(self.special)
        strings = sorted(s for s in strings if SAFE.fullmatch(s) and SPLIT.findall(s) == [s])
        return frozenset(s for s, n in zip(strings, self.merged(strings), strict=True) if n == 1)

    def merged(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        """Whole tokens count 1; the other pre-tokens, and texts that can't be split here, go to the library, each once."""
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        parts = {}
        for piece in new:
            text = piece if piece[:1] == "\n" else " " + piece
            plain = SAFE.fullmatch(text) and not any(s in text for s in self.special)
            parts[piece] = SPLIT.findall(text) if plain else [text]
        rest = list({x for xs in parts.values() for x in xs} - self.whole)
        size = dict(zip(rest, self.merged(rest), strict=True))
        self.update((piece, sum(size.get(x, 1) for x in xs)) for piece, xs in parts.items())

    def count_all(self, texts: list[str]) -> list[int]:
        cut = [pieces(x) if x else [] for x in texts]
        met = set().union(*filter(None, cut))
        if new := met - self.keys():
            self.learn(new if len(self) + len(new) <= REMEMBERED else met)
        odd = iter(self.merged([x for x, c in zip(texts, cut, strict=True) if c is None]))
        # the line end before the first piece is one whole token
        return [next(odd) if c is None else sum(map(self.__getitem__, c)) - bool(c) for c in cut]


@functools.cache
def counts(path: str) -> Counts:
    return Counts(path)


def count_tokens(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row. One pass without a shuffle."""
    path = path or public_tokenizers.path(VOCABULARY)

    def tokens(batches):
        import pyarrow as pa

        known = counts(path)
        for batch in small_batches(batches):
            n = pa.array(known.count_all(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = base.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    out = base.mapInArrow(tokens, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
