"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint is eight bytes. Two fingerprints that differ in at most four
bits differ in at most four bytes, so at least four bytes agree in place. The
index posts a fingerprint under combinations of three positions: twenty
combinations cover every set of four agreeing positions, so each such pair
meets in at least one posting list, and a list of 24-bit keys stays short
where one of 8-bit keys would hold a 256th of the corpus. Inside a list, pairs
are tallied by the number of bytes that agree in place; those with the
guaranteed minimum are verified bit by bit.

Equal fingerprints are one entry of the index, however many documents share
it. A list hands on a spanning forest of its links, never all pairs, and long
lists are cut into blocks that are compared two by two in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, forest, groups, raw, whole_row
from tocsin.llm.components import components
from tocsin.llm.skew import hot_keys, join_hot
from tocsin.session import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
LIST_BLOCK = 4096  # longer posting lists are compared block by block
PAIRS_AT_ONCE = 1 << 20
WHOLE, FIRST, SECOND = 2, 0, 1  # rows of a whole list, or of one of the two blocks of a pair


def covering_triples(n: int = BYTES) -> list[tuple[int, int, int]]:
    """Position triples such that any four positions contain one of them.

    Positions are dealt to three classes in a ring. Four positions hold either
    three of one class, or two of one class and one of the next, or two of a
    class and two of the class before, whose two and one fit the other way.
    """
    kind = [i % 3 for i in range(n)]
    found = []
    for t in combinations(range(n), 3):
        count = [sum(kind[i] == c for i in t) for c in range(3)]
        if 3 in count or any(count[c] == 2 and count[(c + 1) % 3] == 1 for c in range(3)):
            found.append(t)
    return found


TRIPLES = covering_triples()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 majority bits over the hashes of a text's word shingles, repeats included.

    A-Z is lower-cased and words are what ASCII white space leaves; a text of
    fewer words is one shingle, one without words is 0. A bit is set where
    over half of the hashes set it, so a tie leaves it unset.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(view[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())], np.uint64
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, shingle) for x in raw(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["id", "print"])

    return task


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print) per row; null text is empty. The print is the fingerprint as a signed integer."""
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(_fingerprints(shingle), f"id {kind}, print long")


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _list_key(value: Column, number: int, triple: tuple[int, int, int]) -> Column:
    """Number of the triple and its three bytes in one integer."""
    key = F.lit(number << 24).cast("long")
    for place, position in enumerate(triple):
        key = key + F.shiftleft(_byte(value, position), 8 * place)
    return key


def _compare(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs agree in enough bytes and then differ in few enough bits."""
    differ = a ^ b
    agreeing = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    hit = agreeing >= BYTES - max_bits
    hit[hit] = np.bitwise_count(differ[hit]) <= max_bits
    return hit


def _list_links(prints: np.ndarray, side: np.ndarray, offsets: np.ndarray, max_bits: int):
    """Links inside lists as positions (a, smallest linked to a): a forest, not all pairs.

    Every row is compared with the one that follows at distance 1, 2, ... in
    its list, for all lists at once. The rows of one block of a pair of blocks
    are not compared among themselves.
    """
    length = np.repeat(np.diff(offsets), np.diff(offsets))
    place = np.arange(len(prints)) - np.repeat(offsets[:-1], np.diff(offsets))
    ends_a, ends_b = [], []
    rows, distance = np.arange(len(prints)), 1
    while True:
        rows = rows[place[rows] + distance < length[rows]]
        if not len(rows):
            break
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            a = rows[at : at + PAIRS_AT_ONCE]
            b = a + distance
            wanted = (side[a] != side[b]) | (side[a] == WHOLE)
            a, b = a[wanted], b[wanted]
            hit = _compare(prints[a], prints[b], max_bits)
            ends_a.append(a[hit])
            ends_b.append(b[hit])
        distance += 1
        if sum(map(len, ends_a)) > PAIRS_AT_ONCE:  # keep a forest of what is known so far
            a, b = np.concatenate(ends_a), np.concatenate(ends_b)
            label = forest(a, b, len(prints))
            a = np.flatnonzero(label != np.arange(len(prints)))
            ends_a, ends_b = [a], [label[a]]
    if not ends_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = forest(np.concatenate(ends_a), np.concatenate(ends_b), len(prints))
    a = np.flatnonzero(label != np.arange(len(prints)))
    return a, label[a]


def _links(max_bits: int):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table, offsets in groups(batches, "part"):
            prints = table.column("print").to_numpy().view(np.uint64)
            side = table.column("side").to_numpy()
            a, b = _list_links(prints, side, offsets, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[a].view(np.int64)), pa.array(prints[b].view(np.int64))], ["a", "b"]
                )

    return task


def similar_prints(prints: DataFrame, max_bits: int = MAX_BITS, block: int = LIST_BLOCK) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs within ``max_bits`` bits do.

    ``prints`` has one row per distinct fingerprint in column ``print``.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the index covers up to {MAX_BITS} bits")
    spark = prints.sparkSession
    lists = F.array(*[_list_key(F.col("print"), n, t) for n, t in enumerate(TRIPLES)])
    posted = prints.select("print", F.explode(lists).alias("list"))
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    long_lists = materialize(
        sizes.filter(F.col("n") > block).select("list", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "long-lists",
    )
    # Lists up to one block keep their key. A longer one becomes a list for every pair of its
    # blocks: each row goes to all pairs that its block takes part in.
    cut = posted.join(long_lists, "list", "left")
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    other = F.explode(
        F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    cut = cut.select("print", "list", own.alias("own"), other.alias("other")).select(
        "print",
        F.when(F.col("other") < 0, F.col("list"))
        .otherwise(
            F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(
                F.lit(-(2**63)).cast("long")
            )
        )
        .alias("part"),
        F.when((F.col("other") < 0) | (F.col("own") == F.col("other")), F.lit(WHOLE))
        .when(F.col("own") < F.col("other"), F.lit(FIRST))
        .otherwise(F.lit(SECOND))
        .cast("byte")
        .alias("side"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(n, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(_links(max_bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of ``docs``: the key, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``max_bits`` bits are
    linked; a component is what links reach, named by its smallest key. Texts
    without words (null, empty, blank) have fingerprint 0 and are linked like
    any other. A null key takes part and names no component; a component of
    null keys only is null. Repeated rows share a fingerprint. Other columns
    are not read. An empty table gives an empty one.
    """
    found = materialize(fingerprints(docs, key, text, shingle), "prints")
    counted = found.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    distinct = materialize(counted, "distinct-prints")
    roots = components(similar_prints(distinct.select("print"), max_bits))
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.select("print", "root").join(named, "root").select("print", "component_id"), "classes")
    # A print that a third of all rows share stays where its rows are.
    hot = hot_keys(distinct, "print", "rows")
    return join_hot(found, classes, "print", hot).select(
        F.col("id").alias(key), as_hex(F.col("print")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of every class of near duplicates, with all its columns: that with the smallest key.

    A row is told apart by its key and the digest of its text, so rows that
    repeat both are one row, a key with two texts can stay for both, and rows
    with a null key come after all others but can stay too.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("key"), F.md5(body.cast("binary")).alias("text"))
    named = docs.select(whole_row(docs.columns).alias("row"), row.alias("name"), F.col(text).alias("text"))
    classes = near_duplicates(named, "name", "text", shingle, max_bits)
    first = classes.filter(F.col("name") == F.col("component_id")).select("name").distinct()
    return named.join(first, "name", "left_semi").dropDuplicates(["name"]).select("row.*")
