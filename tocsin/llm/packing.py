"""Packing by power-of-two decomposition: no sequence crosses documents.

A document of n tokens is cut, in order, into as many full windows as fit and
then into the binary digits of the rest, largest first. Every piece is a
sequence of its own whose length is a power of two, so nothing is padded, and
equal lengths form the buckets that training batches are drawn from. Each
document is packed by itself: there is no shuffle.

The ids are those of the ``tokenizers`` library. Its model sees every distinct
word once per task; a text is then a join of remembered words. Cutting a text
at ASCII white space first is exact, because the tokenizer's own pattern never
crosses white space and normalisation does not join it to its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tocsin.llm.arrow import Batches, raw, slices
from tocsin.llm.memo import Memo

WINDOW = 4096
END = 2
CACHE_WORDS = 250_000  # remembered words per generation and Python worker
ROWS = 500
#: Below are no combining marks: composed normalisation leaves such words as they are.
LATIN = 0x250


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit integers, exactly those of ``Tokenizer.encode``."""

    #: A word of letters with or without punctuation after it. Digits, apostrophes and what else
    #: the pattern treats apart go to the library as they are.
    PLAIN = re.compile(r"([^\W\d_]+)([.,!?:;*%$&#|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words = Memo(self._word, CACHE_WORDS)
        self.stems = Memo(self._stem, CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: str) -> bytes:
        letters = stem if stem.isascii() else "".join([self.alphabet[b] for b in stem.encode()])
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def _word(self, raw_word: bytes) -> bytes:
        """Ids of a run of text without ASCII white space."""
        word = raw_word.decode("utf-8", "replace")
        plain = self.PLAIN.fullmatch(word)
        if not plain or not plain[1].isalpha() or not (word.isascii() or ord(max(word)) < LATIN):
            return self._whole(word)
        stem = plain[1].lower()
        if len(stem) != len(plain[1]):  # lower case that takes a mark apart
            return self._whole(word)
        return self.stems(stem) + self.stems(plain[2]) if plain[2] else self.stems(stem)

    def encode(self, text: bytes) -> bytes:
        return b"".join(self.words.all(text.split()))


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)


def cuts(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full windows, then binary digits, largest first."""
    pieces = [(at, window) for at in range(0, n - window + 1, window)]
    at, rest = n - n % window, n % window
    while rest:
        length = 1 << (rest.bit_length() - 1)
        pieces.append((at, length))
        at, rest = at + length, rest - length
    return pieces


def _pieces(tokenizer: str, end: int, window: int, key: str, text: str):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer).encode
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, ROWS):
                keys, starts, lengths, totals, ids = [], [], [], [], []
                for at, body in enumerate(raw(part.column(text))):
                    stream = encode(body) + tail
                    total = len(stream) // 4
                    for start, length in cuts(total, window):
                        keys.append(at)
                        starts.append(start)
                        lengths.append(length)
                        totals.append(total)
                        ids.append(stream[4 * start : 4 * (start + length)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(key).take(pa.array(keys, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(totals, pa.int64()),
                        pa.array([x.bit_length() - 1 for x in lengths], pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    [key, "start", "length", "doc_tokens", "bucket", "ids"],
                )

    return task


def pack(
    docs: DataFrame, tokenizer: str, end: int = END, window: int = WINDOW, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents: key, start, length, doc_tokens, bucket, ids.

    ``ids`` are little-endian unsigned 32-bit integers, ``bucket`` is the
    binary logarithm of the length, ``window`` a power of two. ``end`` follows
    every document's ids, so a null or empty text is one piece of one token.
    Every row is packed by itself, so repeated rows and null keys keep their
    pieces. Other columns of the input are not read. An empty table gives an
    empty one.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        _pieces(tokenizer, end, window, key, text),
        f"`{key}` {kind}, start long, length long, doc_tokens long, bucket int, ids binary",
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per sequence length."""
    pieces.write.partitionBy("bucket").parquet(path)
