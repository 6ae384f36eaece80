"""The most frequent n-grams of a corpus without shuffling its n-grams.

Every task keeps a bounded summary: counts of at most ``capacity`` terms. When
the summary overflows, the count of the first term that does not fit is taken
off all others and added to the task's error, and terms without a rest are
forgotten. So a term's true count lies between what is left of it and that plus
the error, in one task and, added up, over all of them. Terms whose upper bound
reaches the last place of the top are counted again, exactly; nothing else can
belong to it. Summaries without an overflow are exact, and the second pass is
not needed. If the error is so large that even a forgotten term could reach the
top, the summary is taken again with four times the capacity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.functions.text import tokens
from tocsin.session import materialize

CAPACITY = 1 << 18
GROWTH = 4
#: Bits of the filter of candidates: at most 16 MB, whatever their number.
FILTER_BITS = 1 << 27
FLUSH = 1 << 19
#: So many candidates are sent as they are and counted in Arrow; of more, a filter.
LISTED = 1 << 20
SLICE = 1 << 22  # bytes of text looked up at a time, and the rest of a document
_SUMMARY = "term string, cnt long, df long, err long"


def _documents(batches: Iterable[pa.RecordBatch], lo: int, hi: int) -> Iterator[list[str]]:
    """N-grams of every document, from its words joined by blanks."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = text.split(" ") if text else []
            grams = words if lo == 1 else []
            for n in range(max(lo, 2), hi + 1):
                grams = grams + list(map(" ".join, zip(*[words[i:] for i in range(n)])))
            yield grams


def _rows(cnt: dict[str, int], df: dict[str, int], err: int) -> pa.RecordBatch:
    """The counted terms, and one row without a term that holds the error."""
    terms = list(cnt)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*terms, None], pa.string()),
            pa.array([*cnt.values(), 0], pa.int64()),
            pa.array([*[df[t] for t in terms], 0], pa.int64()),
            pa.array([*[0] * len(terms), err], pa.int64()),
        ],
        ["term", "cnt", "df", "err"],
    )


def _summary(lo: int, hi: int, capacity: int):
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnt, df, err = Counter(), Counter(), 0
        for grams in _documents(batches, lo, hi):
            cnt.update(grams)
            df.update(set(grams))
            if len(cnt) > 2 * capacity:
                taken = int(np.partition(np.fromiter(cnt.values(), np.int64, len(cnt)), -capacity - 1)[-capacity - 1])
                cnt = Counter({t: n - taken for t, n in cnt.items() if n > taken})
                df = Counter({t: df[t] for t in cnt})
                err += taken
        yield _rows(cnt, df, err)

    return task


def _tree(terms: list[str], hi: int) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """The words of the terms; by length, the sorted keys of their beginnings and the term that each one is, or -1.

    A beginning is known by its place among those of its length, its key is the place without the last word times the
    number of words, plus that word.
    """
    split = [t.split(" ") for t in terms]
    words = sorted({w for ws in split for w in ws})
    code = {w: i for i, w in enumerate(words)}
    place, of = np.array([code[ws[0]] for ws in split], "int64"), np.arange(len(terms))
    size = np.array([len(ws) for ws in split])
    keys, ends = [], []
    for n in range(1, hi + 1):
        if n > 1:
            of = of[size[of] >= n]
            key = place[of] * len(words) + np.array([code[split[i][n - 1]] for i in of.tolist()], "int64")
            keys.append(np.unique(key))
            place[of] = np.searchsorted(keys[-1], key)
        else:
            keys.append(np.arange(len(words)))
        whole = of[size[of] == n]
        ends.append(np.full(len(keys[-1]), -1))
        ends[-1][place[whole]] = whole
    return words, keys, ends


def _listed(batches: Iterable[pa.RecordBatch], lo: int, hi: int, terms: pa.Array) -> pa.RecordBatch:
    """Exact counts of the given terms, which are looked up word by word as numbers."""
    words, keys, ends = _tree(terms.to_pylist(), hi)
    known, n_terms = pa.array(words, pa.string()), len(terms)
    cnt, df = np.zeros(n_terms, "int64"), np.zeros(n_terms, "int64")
    for batch in batches:
        texts = batch.column(0)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64"))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(texts)]
        for first, last in zip(cuts, cuts[1:]):
            lists = pc.split_pattern(texts.slice(first, last - first), " ")
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype("int64")
            code = pc.fill_null(pc.index_in(pc.list_flatten(lists), value_set=known), -1).to_numpy(zero_copy_only=False)
            start, place = np.flatnonzero(code >= 0), code[code >= 0].astype("int64")
            for n in range(1, hi + 1):
                if n > 1:
                    # Beginnings that go on in their document, with a word that is known.
                    on = start + n - 1 < len(code)
                    start, place = start[on], place[on]
                    after = code[start + n - 1]
                    on = (doc[start] == doc[start + n - 1]) & (after >= 0)
                    start, key = start[on], place[on] * len(words) + after[on]
                    place = np.searchsorted(keys[n - 1], key)
                    on = place < len(keys[n - 1])
                    on[on] = keys[n - 1][place[on]] == key[on]
                    start, place = start[on], place[on]
                if n >= lo:
                    term = ends[n - 1][place]
                    pair = doc[start[term >= 0]] * n_terms + term[term >= 0]
                    pair, times = np.unique(pair, return_counts=True)
                    cnt += np.bincount(pair % max(n_terms, 1), times, n_terms).astype("int64")
                    df += np.bincount(pair % max(n_terms, 1), minlength=n_terms)
    seen = np.flatnonzero(cnt)
    return pa.RecordBatch.from_arrays(
        [terms.take(pa.array(seen)), pa.array(cnt[seen]), pa.array(df[seen]), pa.array(np.zeros(len(seen), "int64"))],
        ["term", "cnt", "df", "err"],
    )


def _exact(lo: int, hi: int, shared):
    """Exact counts of this task, for the listed terms or all that pass the filter."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(shared.value, pa.Array):
            yield _listed(batches, lo, hi, shared.value)
            return
        bits, cnt, df, known, hits = shared.value, Counter(), Counter(), set(), set()
        for grams in _documents(batches, lo, hi):
            if len(known) > FLUSH:
                known, hits = set(), set()
            new = set(grams) - known
            known |= new
            hits.update(t for t in new if _in_filter(bits, t))
            wanted = list(filter(hits.__contains__, grams))
            cnt.update(wanted)
            df.update(set(wanted))
            if len(cnt) > FLUSH:
                yield _rows(cnt, df, 0)
                cnt, df = Counter(), Counter()
        yield _rows(cnt, df, 0)

    return task


def _places(term: str, size: int) -> tuple[int, int]:
    import hashlib

    mark = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=16).digest(), "little")
    return mark % size, (mark >> 64) % size


def _in_filter(bits: np.ndarray, term: str) -> bool:
    a, b = _places(term, len(bits) * 8)
    return bool(bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1)


def _filter_of(candidates: DataFrame, n: int) -> np.ndarray:
    """Two bits per candidate; built from partial filters of the tasks."""
    size = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [p for batch in batches for t in batch.column(0).to_pylist() for p in _places(t, size)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(places).astype(np.int64))], ["place"])

    words = candidates.select("term").mapInArrow(partial, "place long").groupBy(F.shiftright("place", 5).alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 31 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size >> 5, "<u4")  # at most FILTER_BITS, like what is collected
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def frequent_terms(
    docs: DataFrame, size: int, kept: Column | None = None, sure: Column | None = None, lo: int = 1, hi: int = 2,
    text_col: str = "clean_text", keep_marks: bool = False, capacity: int = CAPACITY,
) -> DataFrame:
    """``(term, cnt, df)`` that hold the ``size`` most frequent terms with ``kept``, exactly counted.

    ``kept`` is a condition on ``df`` (all terms if none is given), ``sure`` the
    same as a condition on ``df`` and ``df_most``, its bounds from a summary.
    The result also has less frequent terms; the caller cuts. One row of
    ``docs`` is one document.
    """
    spark = docs.sparkSession
    # Written, as every pass reads them.
    words = materialize(docs.select(F.array_join(tokens(text_col, keep_marks), " ").alias("words")), "words")
    while True:
        parts = materialize(words.mapInArrow(_summary(lo, hi, capacity), _SUMMARY), "summary")
        err = parts.agg(F.coalesce(F.sum("err"), F.lit(0))).first()[0]
        merged = parts.filter("term is not null").groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
        if not err:
            return merged if kept is None else merged.filter(kept)
        merged = materialize(merged, "merged")
        safe = merged.withColumn("df_most", F.col("df") + err)
        safe = safe if sure is None else safe.filter(sure)
        # The last place of the top is at least this often; ``size`` counts are sorted by Spark's top rows.
        floor = safe.select("cnt").orderBy(F.desc("cnt")).limit(size).agg(F.count("*").alias("n"), F.min("cnt").alias("cnt")).first()
        if floor["n"] == size and floor["cnt"] > err:
            break
        capacity *= GROWTH
    candidates = materialize(merged.filter(F.col("cnt") + err >= floor["cnt"]), "candidates")
    n = candidates.count()
    listed = candidates.select("term").toArrow().column(0).combine_chunks() if n <= LISTED else _filter_of(candidates, n)
    counted = words.mapInArrow(_exact(lo, hi, spark.sparkContext.broadcast(listed)), _SUMMARY).filter("term is not null")
    counted = counted.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))
    return counted if kept is None else counted.filter(kept)
