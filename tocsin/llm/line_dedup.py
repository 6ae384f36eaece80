"""Lines that repeat across documents are kept in one document only.

Identity of a line is a 128-bit BLAKE2b digest of its key, so no line text is
ever shuffled. Whether a digest may be a repeat is decided with two Bloom
filters per slice of the hash space: the first holds what was seen once, the
second what was seen again while already in the first. Digests are cut to one
entry per Arrow batch before they travel, so a line held by a third of all
documents arrives once per batch. A slice answers every batch with those of its
hashes that pass the second filter, and only these occurrences are shuffled for
the exact count and the choice of the first document. The number of slices
grows with the lines, so a slice is small whatever the size of the table, and
neither hashes nor filters ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, kinds, raw, unpacked, whole_row
from tocsin.session import materialize, scratch_path

MIN_LENGTH = 10
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_ID = 2**63 - 1
BITS_PER_HASH = 16
PROBES = 4
SLICE = 1 << 20  # hashes of a slice, at most on average; a task takes about four
DIGEST = 16


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def long_enough(key: bytes, length: int) -> bool:
    """At least ``length`` code points."""
    return len(key) >= length and (len(key) >= 4 * length or len(key.decode("utf-8", "replace")) >= length)


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=DIGEST).digest()


class Bloom:
    """Bit set with ``PROBES`` positions per 64-bit hash."""

    def __init__(self, hashes: int):
        self.size = np.uint64(max(64, hashes * BITS_PER_HASH))
        self.bits = np.zeros(int(self.size) // 8 + 1, np.uint8)

    def _positions(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(17)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) % self.size for i in range(PROBES)])

    def add(self, hashes: np.ndarray) -> None:
        at = self._positions(hashes).ravel()
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self._positions(hashes)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _occurrences(min_length: int):
    """Per Arrow batch one row: digests of the lines of its documents, with the documents' ids.

    ``task`` and ``batch`` number the row.
    """

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            digests, ids = [], []
            for doc, text in zip(batch.column("_id").to_pylist(), raw(batch.column("_text"))):
                keys = {k for k in map(line_key, text.split(b"\n")) if long_enough(k, min_length)}
                digests += [digest(k) for k in keys]
                ids += [doc] * len(keys)
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own], pa.int64()),
                        pa.array([number], pa.int64()),
                        pa.array([b"".join(digests)]),
                        pa.array([np.array(ids, "<i8").tobytes()]),
                    ],
                    ["task", "batch", "digests", "ids"],
                )

    return task


def _hashes(digests: bytes) -> np.ndarray:
    """First half of every digest."""
    return np.frombuffer(digests, "<u8")[::2]


def _slices(n: int):
    """Hashes of a batch, each once, cut by slice of the hash space; the odd part was met in two documents."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("task", "batch", "digests", "ids")))
            for own, number, digests, ids in rows:
                hashes, docs = _hashes(digests), np.frombuffer(ids, "<i8")
                order = np.lexsort((docs, hashes))
                hashes, docs = hashes[order], docs[order]
                start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                end = np.concatenate([start[1:], [len(hashes)]]) - 1
                unique, again = hashes[start], docs[start] != docs[end]
                part = (unique % np.uint64(n)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                unique, again, part = unique[order], again[order], part[order]
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                cut = list(zip(edges[:-1], edges[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own] * len(cut), pa.int64()),
                        pa.array([number] * len(cut), pa.int64()),
                        pa.array([int(part[a]) for a, _ in cut], pa.int32()),
                        pa.array([unique[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([unique[a:b][again[a:b]].tobytes() for a, b in cut], pa.binary()),
                    ],
                    ["task", "batch", "slice", "hashes", "again"],
                )

    return task


def _suspects(batches: Batches) -> Iterator[pa.RecordBatch]:
    """For every batch its hashes that may occur twice: no repeat is missed, few others pass."""
    names, blocks, again = [], [], []
    for batch in batches:
        names += zip(batch.column("task").to_pylist(), batch.column("batch").to_pylist())
        blocks += [np.frombuffer(x, "<u8") for x in batch.column("hashes").to_pylist()]
        again += [np.frombuffer(x, "<u8") for x in batch.column("again").to_pylist()]
    total = sum(map(len, blocks))
    if not total:
        return
    once, twice = Bloom(total), Bloom(total)
    for block, known in zip(blocks, again):
        twice.add(block[once.has(block)])
        twice.add(known)
        once.add(block)
    for (task, number), block in zip(names, blocks):
        hit = block[twice.has(block)]
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task]), pa.array([number]), pa.array([hit.tobytes()])], ["task", "batch", "hashes"]
            )


def _pick(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Occurrences (digest, id) whose hash is among the ``suspects`` of their batch."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("digests", "ids", "suspects")))
        for digests, ids, suspects in rows:
            hit = np.isin(_hashes(digests), np.frombuffer(b"".join(suspects), "<u8"))
            docs, keys = np.frombuffer(ids, "<i8")[hit], np.frombuffer(digests, f"V{DIGEST}")[hit]
            cells = pa.Array.from_buffers(pa.binary(DIGEST), len(keys), [None, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([cells.cast(pa.binary()), pa.array(docs)], ["digest", "id"])


def _in_buckets_of_tasks(df: DataFrame, n: int) -> DataFrame:
    """``df`` written in ``n`` buckets of ``task`` without a shuffle: a task's rows lie in one bucket anyway."""
    spark, name = df.sparkSession, f"tocsin_{uuid4().hex}"
    df.write.bucketBy(n, "task").option("path", scratch_path(spark, "lines")).saveAsTable(name)
    return spark.table(name)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, digests): for every document the lines that an earlier document holds.

    Documents are ordered by id, an integer; rows that share an id are one
    document, and a null id is one document after all others.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_text"))
    occurrences = narrow.mapInArrow(_occurrences(min_length), "task long, batch long, digests binary, ids binary")
    seen = _in_buckets_of_tasks(occurrences, n)
    lines = seen.agg(F.coalesce(F.sum(F.length("digests")), F.lit(0))).first()[0] // DIGEST
    slices = 4 * max(n, -(-lines // (4 * SLICE)))
    sliced = seen.mapInArrow(_slices(slices), "task long, batch long, slice int, hashes binary, again binary")
    answers = sliced.repartition(slices // 4, "slice").mapInArrow(_suspects, "task long, batch long, hashes binary")
    # All answers to a task are 8 bytes for each of its lines at most; each batch takes its own.
    told = answers.groupBy(F.col("task").alias("asked")).agg(F.collect_list(F.struct("batch", "hashes")).alias("told"))
    own = F.filter("told", lambda x: x["batch"] == F.col("batch"))
    asked = seen.join(told, F.col("task") == F.col("asked")).select(
        "digests", "ids", F.transform(own, lambda x: x["hashes"]).alias("suspects")
    )
    found = materialize(asked.mapInArrow(_pick, "digest binary, id long"), "suspected-lines")
    # Written, so that both sides of the join are plain exchanges: a line held by very many
    # documents is then split over tasks where the adaptive plan finds it.
    first = found.groupBy("digest").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    first = materialize(first.filter("_first <> _last").select("digest", "_first"), "confirmed-lines")
    return (
        found.join(first, "digest")
        .filter(F.col("id") != F.col("_first"))
        .groupBy("id")
        .agg(F.collect_set("digest").alias("digests"))
    )


def _cut(min_length: int, columns: list[str], text: str):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, totals, dropped = [], [], []
            rows = batch.column("row")
            for body, gone in zip(raw(rows.field(columns.index(text))), batch.column("gone").to_pylist()):
                lines = body.split(b"\n")
                totals.append(len(lines))
                if gone:
                    gone = set(gone)
                    lines = [
                        x for x in lines if not (long_enough(k := line_key(x), min_length) and digest(k) in gone)
                    ]
                    body = b"\n".join(lines)
                kept.append(body)
                dropped.append(totals[-1] - len(lines))
            own = unpacked(rows, columns, {text: pa.array(kept, pa.binary()).cast(pa.string())})
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())],
                [*columns, "n_lines", "n_dropped"],
            )

    return task


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH
) -> DataFrame:
    r"""Every row with its text cut, plus ``n_lines`` (before) and ``n_dropped``.

    Lines are split at ``\n``. Two lines are the same if they agree after
    stripping ASCII white space at both ends and lower-casing A-Z; lines of
    fewer than ``min_length`` code points after that always stay. A repeated
    line stays wherever the document with the smallest id holds it, also
    several times there, and goes everywhere else.

    Null and empty text count as one empty line and come back empty. Ids are
    integers. Rows that share an id are one document, so a repeated row loses nothing to its twin.
    A null id counts as the largest. All other columns stay; columns called
    ``n_lines`` or ``n_dropped`` are replaced. An empty table stays empty.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(whole_row(columns).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"))
    gone = repeated_lines(docs, key, text, min_length)
    joined = rows.join(gone, F.col("key") == F.col("id"), "left").select("row", F.col("digests").alias("gone"))
    return joined.mapInArrow(
        _cut(min_length, columns, text), f"{kinds(docs, columns)}, n_lines long, n_dropped long"
    )
