"""How the tokens of two tokenizers go together, document by document and over the corpus.

Tokens of both are laid over the same bytes, and cut into groups wherever both
end. A link is a pair of tokens that end together; how often a pair of ids is
linked in the corpus tells which is the usual counterpart.

Texts are tokenized once, and their ids are written. The distinct pairs of a
first alignment get a minimal perfect hash in buckets. A pass over the
documents adds up one dense vector of counts per task, indexed by the hash and
verified by key; the vectors are summed as a tree, some tasks at a time. Then a
second pass aligns the documents again and looks up their counts. With very
many distinct pairs both passes are repeated for some buckets at a time, so a
task never holds more than :data:`PASS_KEYS` of them.

Tokenizing remembers words: neither tokenizer reaches across blanks and line
ends that follow a visible character. Aligning works on whole batches: marks on
the bytes where tokens end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, raw, slices
from tocsin.llm.memo import Memo
from tocsin.llm.perfect_hash import BUCKET_KEYS, PerfectHash, bucket_of, build
from tocsin.llm.pieces import BLANK, PieceEncoder
from tocsin.session import materialize

PASS_KEYS = 2_000_000
CHUNK_KEYS = 1 << 14
CACHE_WORDS = 100_000
LONGEST_REMEMBERED = 64
ROWS = 200
CHAIN = 4  # passes that look up counts before the table is written
#: Fixed value: how the byte-level tokenizer splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORDS = re.compile(r"[ \n]+[^ \n]*")
#: Blanks that may not be cut before, as they follow other white space.
UNUSUAL = re.compile(r"[^\S \n][ \n]")


class ByteLevel:
    """Ids and token bytes of a byte-level tokenizer file, without special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        special = self.library.get_added_tokens_decoder()
        self.surface = {i: bytes([byte[c] for c in t]) for t, i in model["vocab"].items() if i not in special}
        # Merges in the order of ids are what the faster library takes for granted.
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        self.fast = None
        if merged == sorted(merged) and len(merged) + 256 == len(self.surface):
            ranks = {t: i for i, t in self.surface.items()}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and len(text) < 10_000:  # its pattern matcher gives up on very long runs
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Tokens:
    """Ids of both tokenizers: A of a blank and the text, B of the text."""

    def __init__(self, byte_level: str, pieces: str):
        self.a = ByteLevel(byte_level)
        encoder = PieceEncoder(pieces)
        self.b, self.cuttable = encoder.library, encoder.cuttable
        self.b_surface = encoder.surface
        self.blank = self.b.piece_to_id(BLANK.decode())
        self.length_a = np.zeros(max(self.a.surface) + 1, np.int64)
        for i, t in self.a.surface.items():
            self.length_a[i] = len(t)
        self.length_b = np.array([len(t) for t in self.b_surface], np.int64)
        #: How ids are packed.
        self.kind = np.dtype("<u2" if max(len(self.length_a), len(self.length_b)) <= 1 << 16 else "<u4")
        self.known = Memo(self._word, CACHE_WORDS)

    def _words(self, text: str) -> list[str]:
        """Parts of a text that begins with a blank."""
        if not self.cuttable:
            return [text]
        parts = WORDS.findall(text)
        if not UNUSUAL.search(text):
            return parts
        joined = [parts[0]]
        for part in parts[1:]:
            if joined[-1][-1].isspace():
                joined[-1] += part
            else:
                joined.append(part)
        return joined

    def _word(self, word: str) -> tuple[bytes, bytes] | tuple[()]:
        """Ids of a part; nothing if its bytes are not given back."""
        a = self.a.encode(word)
        if word == " ":
            b = [self.blank]
        elif word[0] == " ":
            b = self.b.encode(word[1:], num_threads=1)
        else:  # the library's blank, which stands alone before a line end, is not part of it
            b = self.b.encode(word, num_threads=1)[1:]
        own, other = [self.a.surface.get(i, b"") for i in a], [self.b_surface[i] for i in b]
        text = word.encode()
        if b"".join(own) != text or b"".join(other) != text or not all(own) or not all(other):
            return ()
        return np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()

    def __call__(self, raw_text: bytes) -> tuple[bytes, bytes]:
        """Packed ids of a text; none if both do not give its bytes back."""
        if not raw_text or BLANK in raw_text:
            return b"", b""
        words = self._words(" " + raw_text.decode("utf-8", "replace"))
        if max(map(len, words)) <= LONGEST_REMEMBERED:
            found = self.known.all(words)
        else:
            found = [self.known(w) if len(w) <= LONGEST_REMEMBERED else self._word(w) for w in words]
        if not all(found):
            return b"", b""
        return b"".join([w[0] for w in found]), b"".join([w[1] for w in found])


@cache
def tokens(byte_level: str, pieces: str) -> Tokens:
    """One per Python worker."""
    return Tokens(byte_level, pieces)


@cache
def spelled(byte_level: str, pieces: str) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with the sign that follows: within a group, then at its end."""
    own = tokens(byte_level, pieces)
    a, b = range(len(own.length_a)), range(len(own.length_b))
    return (
        np.array([f"{i}{sign}" for sign in ",|" for i in a], object),
        np.array([f"{i}{sign}" for sign in ",;" for i in b], object),
    )


class Alignment:
    """All texts of a batch at once, laid over their bytes end to end."""

    def __init__(self, own: Tokens, a: list[bytes], b: list[bytes]):
        self.a, self.b = (np.frombuffer(b"".join(x), own.kind).astype(np.int64) for x in (a, b))
        self.size_a, self.size_b = (np.array([len(x) // own.kind.itemsize for x in y], np.int64) for y in (a, b))
        end_a, end_b = np.cumsum(own.length_a[self.a]), np.cumsum(own.length_b[self.b])
        marks = np.zeros((2, (end_a[-1] if len(end_a) else 0) + 1), bool)
        marks[0, end_a] = marks[1, end_b] = True
        self.shared_a, self.shared_b = marks[1, end_a], marks[0, end_b]
        self.last_a, self.last_b = np.flatnonzero(self.shared_a), np.flatnonzero(self.shared_b)
        #: One pair of ids for every group, as no token is empty.
        self.pairs = self.a[self.last_a] * len(own.length_b) + self.b[self.last_b]
        ends = np.cumsum(self.size_a)
        self.n_groups = np.diff(np.append(0, np.cumsum(self.shared_a))[np.append(0, ends)])

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of what pairs have, by text."""
        ends = np.append(0, np.cumsum(self.n_groups))
        return np.diff(np.append(0, np.cumsum(values, dtype=np.int64))[ends])

    def groups(self, signs: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """Groups of every text as ``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(self.a) + len(self.b), object)
        group_a, group_b = np.cumsum(self.shared_a) - self.shared_a, np.cumsum(self.shared_b) - self.shared_b
        before = np.append(0, self.last_b + 1)
        out[np.arange(len(self.a)) + before[group_a]] = signs[0][self.a + self.shared_a * (len(signs[0]) // 2)]
        out[np.arange(len(self.b)) + self.last_a[group_b] + 1] = signs[1][self.b + self.shared_b * (len(signs[1]) // 2)]
        ends = np.append(0, np.cumsum(self.size_a + self.size_b)).tolist()
        return ["".join(out[i:j].tolist())[:-1] for i, j in zip(ends, ends[1:])]


def _tokenized(paths: tuple[str, str]):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = tokens(*paths)
        for batch in batches:
            for part in slices(batch, ROWS):
                a, b = zip(*[own(t) for t in raw(part.column(1))])
                zero = pa.array(np.zeros(part.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary()), zero, zero],
                    ["key", "a", "b", "n_best", "count_sum"],
                )

    return task


def _aligned(paths: tuple[str, str], part: pa.RecordBatch) -> Alignment:
    return Alignment(tokens(*paths), *[part.column(part.schema.get_field_index(c)).to_pylist() for c in ("a", "b")])


def _distinct(paths: tuple[str, str]):
    """Distinct pairs of this task."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        held, new = np.empty(0, np.int64), []
        for batch in batches:
            for part in slices(batch, ROWS):
                new.append(np.unique(_aligned(paths, part).pairs))
                if sum(map(len, new)) > max(len(held), 1 << 18):
                    held, new = np.unique(np.concatenate([held, *new])), []
                if len(held) > PASS_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["pair"])
                    held = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([held, *new])))], ["pair"])

    return task


def _in_buckets(n_buckets: int):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column(0)
            yield pa.RecordBatch.from_arrays([pair, pa.array(bucket_of(pair.to_numpy(), n_buckets))], ["pair", "bucket"])

    return task


def _built(rows: pa.Table) -> pa.Table:
    sizes, words, keys = build(rows.column("pair").to_numpy())
    bucket = rows.column("bucket")[0].as_py()
    return pa.table([[bucket], [sizes], [words], [keys]], names=["bucket", "sizes", "words", "keys"])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type, whose width is the first byte."""
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _counted(paths: tuple[str, str], shared):
    """One dense vector of counts, in chunks, for this task."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        table = shared.value
        counts = np.zeros(len(table), np.int64)
        for batch in batches:
            for part in slices(batch, ROWS):
                place = table.places(_aligned(paths, part).pairs)
                np.add.at(counts, place[place >= 0], 1)
        chunks = range(0, len(counts), CHUNK_KEYS)
        packed = [(at // CHUNK_KEYS, _narrow(counts[at : at + CHUNK_KEYS])) for at in chunks if counts[at : at + CHUNK_KEYS].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in packed], pa.int64()), pa.array([p for _, p in packed], pa.binary())], ["chunk", "counts"]
        )

    return task


def _summed(rows: pa.Table) -> pa.Table:
    total = 0
    for packed in rows.column("counts"):
        total = total + _wide(packed.as_py())
    return pa.table([rows.column("chunk").slice(0, 1), [_narrow(total)]], names=["chunk", "counts"])


def tree_sum(vectors: DataFrame) -> DataFrame:
    """Sum of the vectors of all tasks, chunk by chunk: first over groups of about the root of their number."""
    groups = max(1, round(vectors.rdd.getNumPartitions() ** 0.5))
    schema = "chunk long, counts binary"
    some = vectors.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("chunk", "some")
    return some.applyInArrow(_summed, schema).groupBy("chunk").applyInArrow(_summed, schema)


def _looked_up(paths: tuple[str, str], shared, last: bool):
    """Adds the counts of one pass to ``n_best`` and ``count_sum``; the last one gives the whole result."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        table, counts, best = shared.value
        for batch in batches:
            for part in slices(batch, ROWS):
                laid = _aligned(paths, part)
                place = table.places(laid.pairs)
                own = np.zeros(len(place), np.int64)
                own[place >= 0] = counts[place[place >= 0]]
                is_best = (place >= 0) & (own == best[laid.pairs % len(best)])
                sums = [part.column(at).to_numpy() + laid.per_text(x) for at, x in ((3, is_best), (4, own))]
                sums = [pa.array(x) for x in sums]
                if not last:
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], *sums], part.schema.names)
                    continue
                n_groups = pa.array(laid.n_groups)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(laid.size_a), pa.array(laid.size_b), n_groups, n_groups, *sums,
                        pa.array(laid.groups(spelled(*paths)), pa.string()),
                    ],
                    ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )

    return task


def tokenize(docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written ids of both tokenizers: key, ``a`` and ``b`` (packed integers), and two counters at zero."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, a binary, b binary, n_best long, count_sum long"
    return materialize(docs.select(key, text).mapInArrow(_tokenized((byte_level, pieces)), schema), "tokens")


class PairCounts:
    """Perfect hashes of the distinct pairs of tokenized texts, pass by pass, and their counts.

    ``passes`` is a list of (hash, counts); ``best`` has the highest count of every B id.
    """

    def __init__(self, tokenized: DataFrame, byte_level: str, pieces: str, pass_keys: int = PASS_KEYS, bucket_keys: int = BUCKET_KEYS):
        self.paths = (byte_level, pieces)
        context, texts = tokenized.sparkSession.sparkContext, tokenized.select("a", "b")
        pairs = materialize(texts.mapInArrow(_distinct(self.paths), "pair long").distinct(), "pairs")
        self.n_pairs = pairs.count()
        n_buckets = max(1, -(-self.n_pairs // bucket_keys))
        built = pairs.mapInArrow(_in_buckets(n_buckets), "pair long, bucket long").groupBy("bucket")
        built = materialize(built.applyInArrow(_built, "bucket long, sizes array<bigint>, words binary, keys binary"), "hash")
        at_once = max(1, pass_keys // bucket_keys)
        self.passes: list[tuple[PerfectHash, np.ndarray]] = []
        self.best = np.zeros(len(tokens(*self.paths).length_b), np.int64)
        for first in range(0, n_buckets, at_once):
            rows = built.filter(F.col("bucket").between(first, first + at_once - 1)).collect()
            own = {r.bucket: (r.sizes, bytes(r.words), bytes(r["keys"])) for r in rows}
            table = PerfectHash.of(n_buckets, first, own, min(at_once, n_buckets - first))
            counts = np.zeros(len(table), np.int64)
            vectors = texts.mapInArrow(_counted(self.paths, context.broadcast(table)), "chunk long, counts binary")
            for chunk in tree_sum(vectors).collect():
                at = chunk.chunk * CHUNK_KEYS
                counts[at : at + CHUNK_KEYS] = _wide(bytes(chunk.counts))
            np.maximum.at(self.best, table.keys % len(self.best), counts)
            self.passes.append((table, counts))


def align(
    docs: DataFrame, byte_level: str, pieces: str, key: str = "doc_id", text: str = "text",
    pass_keys: int = PASS_KEYS, bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """One row per row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A is the byte-level tokenizer file ``byte_level`` on a blank and the text,
    B the piece model ``pieces`` on the text; strings of special tokens are
    plain text. ``groups`` lists decimal ids as ``a1,a2|b1;a3|b2,b3``.
    ``n_best`` are links whose count is the highest of their B id (ties
    included), ``count_sum`` adds up the counts of all links. Texts that are
    null, empty or not given back by both tokenizers (such as texts with a
    visible blank) have zeros and empty ``groups``. Every row counts, repeated
    ones too; keys may be null and are carried along, other columns are not
    read. An empty table gives an empty one. One text must fit a task's memory.
    """
    context, kind = docs.sparkSession.sparkContext, docs.schema[key].dataType.simpleString()
    table = tokenize(docs, byte_level, pieces, key, text)
    counted = PairCounts(table, byte_level, pieces, pass_keys, bucket_keys)
    for i, (hashed, counts) in enumerate(counted.passes, 1):
        last = i == len(counted.passes)
        shared = context.broadcast((hashed, counts, counted.best))
        schema = f"key {kind}, a binary, b binary, n_best long, count_sum long"
        if last:
            schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
        table = table.mapInArrow(_looked_up(counted.paths, shared, last), schema)
        if not last and i % CHAIN == 0:
            table = materialize(table, "looked-up")
    return table.withColumnRenamed("key", key)
