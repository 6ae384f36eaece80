"""Ranked lexical search with a tree over items and trees over documents.

Every item and document is a sparse vector over the terms of the items. Items
are sorted by their commonest terms and grouped by eights, and again, into a
tree; a task does the same with every batch of documents that it reads. A node
holds, term by term, the largest weight below it. The product of two nodes'
maxima bounds every score between them, so a pair of nodes is left out as a
whole when its bound is below the weakest of the items' k-th best scores.
Otherwise both nodes are split, down to single items and leaves of documents,
where scores are added up exactly in 64-bit integers. A bound that equals the
k-th score is not left out, since ties go to the smaller document.

A first wave, one document in :data:`WAVE`, gives every item a k-th score to
begin with; the second wave takes all other documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, raw, slices
from tocsin.session import materialize

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: (item, term) pairs that are searched for in one pass over the documents, and sent to every worker.
BLOCK_PAIRS = 250_000
WAVE = 32
FANOUT = 8
LEAF = 16
BATCH_DOCS = 4096
BATCH_PAIRS = 1_000_000
SCORED_PAIRS = 1 << 16
ROWS = 500


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


@dataclass
class Sparse:
    """Rows of (term, value), terms ascending in each row."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the cells of some rows, and where each row begins among them."""
        size = self.start[rows + 1] - self.start[rows]
        begin = np.append(0, np.cumsum(size))
        return np.repeat(self.start[rows] - begin[:-1], size) + np.arange(begin[-1]), begin

    def dot(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Products of some rows with dense vectors (along the last axis)."""
        at, begin = self.cells(rows)
        product = dense[..., self.term[at]] * self.value[at]
        total = np.zeros((*product.shape[:-1], product.shape[-1] + 1), np.int64)
        np.cumsum(product, axis=-1, out=total[..., 1:])
        return total[..., begin[1:]] - total[..., begin[:-1]]

    def take(self, rows: np.ndarray) -> Sparse:
        at, begin = self.cells(rows)
        return Sparse(begin, self.term[at], self.value[at])

    def maxima(self, fanout: int) -> Sparse:
        """Largest value of every term over each ``fanout`` consecutive rows."""
        n = -(-len(self) // fanout)
        node = np.repeat(np.arange(len(self)) // fanout, np.diff(self.start))
        order = np.lexsort((self.term, node))
        node, term = node[order], self.term[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])))[: len(node)]
        value = np.maximum.reduceat(self.value[order], first) if len(first) else self.value
        return Sparse(np.searchsorted(node[first], np.arange(n + 1)), term[first], value)


def tree(leaves: Sparse, *fanouts: int) -> list[Sparse]:
    """Levels from the leaves up to a single node; the last fan-out goes on."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].maxima(fanouts[min(len(levels), len(fanouts)) - 1]))
    return levels


class Best:
    """The k best (score, document) of every item so far, and the k-th score where there is one."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = np.maximum(floor, 1), k
        self.held = [np.empty(0, np.int64)] * 3
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        self.new.append((item, score, doc))

    def settle(self) -> None:
        """Drop what is not among the k best and raise the floors."""
        if not self.new:
            return
        item, score, doc = (np.concatenate(c) for c in zip(self.held, *self.new))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        begin = np.searchsorted(item, np.arange(len(self.floor)))
        keep = np.arange(len(item)) - begin[item] < self.k
        self.held, self.new = [item[keep], score[keep], doc[keep]], []
        last = np.arange(len(item)) - begin[item] == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])


class Search:
    """Dual-tree search of one block of items in batches of documents."""

    def __init__(self, items: list[Sparse], weights: np.ndarray, floor: np.ndarray, k: int):
        self.items, self.weights = items, weights
        self.best = Best(floor, k)
        self.dense = np.zeros(len(weights), np.int64)
        self.block = np.zeros((LEAF, len(weights)), np.int64)
        self.pairs = self.left_out = 0

    def batch(self, docs: Sparse, keys: np.ndarray) -> None:
        """``docs`` are rows that hold a term each; they are sorted by their rarest one."""
        rarest = np.maximum.reduceat(self.weights[docs.term] << 32 | docs.term, docs.start[:-1])
        order = np.argsort(rarest, kind="stable")
        self.docs, self.keys = docs.take(order), keys[order]
        self.levels = tree(self.docs, LEAF, FANOUT)
        if len(self.levels) == 1:
            self.levels.append(self.docs.maxima(LEAF))
        top = len(self.items) - 1
        self._descend(len(self.levels) - 1, 0, top, np.arange(len(self.items[top])))
        self.best.settle()

    def _floors(self) -> list[np.ndarray]:
        floors = [self.best.floor]
        for level in self.items[1:]:
            floors.append(np.minimum.reduceat(floors[-1], np.arange(len(level)) * FANOUT))
        return floors

    def _reached(self, nodes: np.ndarray, level: int, maxima: np.ndarray) -> np.ndarray:
        """Item nodes whose bound does not fall below their weakest item's floor."""
        kept = nodes[self.items[level].dot(nodes, maxima) >= self.floors[level][nodes]]
        self.pairs += len(nodes)
        self.left_out += len(nodes) - len(kept)
        return kept

    def _below(self, nodes: np.ndarray, level: int) -> np.ndarray:
        children = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return children[children < len(self.items[level - 1])]

    def _descend(self, height: int, node: int, level: int, nodes: np.ndarray) -> None:
        if height > 1 or node % FANOUT == 0:
            self.best.settle()
            self.floors = self._floors()
        own = self.levels[height]
        cells = slice(own.start[node], own.start[node + 1])
        terms = own.term[cells]
        self.dense[terms] = own.value[cells]
        nodes = self._reached(nodes, level, self.dense)
        while height == 1 and level and len(nodes):
            level, nodes = level - 1, self._below(nodes, level)
            nodes = self._reached(nodes, level, self.dense)
        self.dense[terms] = 0
        if not len(nodes):
            return
        if height == 1:
            self._score(node, nodes)
            return
        if level:
            level, nodes = level - 1, self._below(nodes, level)
        for child in range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[height - 1]))):
            self._descend(height - 1, child, level, nodes)

    def _score(self, leaf: int, items: np.ndarray) -> None:
        """Exact scores of all documents of a leaf for some items."""
        first, end = leaf * LEAF, min((leaf + 1) * LEAF, len(self.docs))
        cells = slice(self.docs.start[first], self.docs.start[end])
        row = np.repeat(np.arange(end - first), np.diff(self.docs.start[first : end + 1]))
        terms = self.docs.term[cells]
        self.block[row, terms] = self.docs.value[cells]
        size = np.cumsum(np.diff(self.items[0].start)[items])
        for part in np.split(items, np.searchsorted(size, np.arange(SCORED_PAIRS, size[-1], SCORED_PAIRS))):
            score = self.items[0].dot(part, self.block[: end - first])
            doc, item = np.nonzero(score >= self.best.floor[part])
            self.best.offer(part[item], score[doc, item], self.keys[first + doc])
        self.block[row, terms] = 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _item_terms(batches: Batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, counts = [], []
        for text in raw(batch.column(1)):
            found: dict[bytes, int] = {}
            for t in terms_of(text):
                found[t] = found.get(t, 0) + 1
            terms.append(list(found))
            counts.append(list(found.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(terms, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64()))],
            ["item", "terms", "counts"],
        )


def _doc_terms(shared):
    """Number of terms of every document, and (term, tf) of those that items hold."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            for part in slices(batch, ROWS):
                n, places, ids = [], [], []
                for at, text in enumerate(raw(part.column(1))):
                    terms = terms_of(text)
                    n.append(len(terms))
                    found = [t for t in map(known, terms) if t is not None]
                    ids += found
                    places.append(len(found))
                cell = np.repeat(np.arange(len(n), dtype=np.int64) << 32, places) + np.array(ids, np.int64)
                cell, tf = np.unique(cell, return_counts=True)
                cut = np.searchsorted(cell >> 32, np.arange(len(n) + 1))
                ids, tf = (cell & 0xFFFFFFFF).astype("<i4"), tf.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                        pa.array([tf[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    ],
                    ["doc", "n", "ids", "tf"],
                )

    return task


def _frequencies(n_terms: int):
    """Documents of this task by term."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], ["term", "df"])

    return task


def _search(shared, k: int):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        items, weights, floor, n_docs, n_all = shared.value
        search = Search(items, weights, floor, k)
        keys, n, ids, tf, pairs = [], [], [], [], 0

        def flush() -> None:
            size = np.array([len(x) // 4 for x in ids])
            term, count = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (ids, tf))
            m = 75 + 25 * np.array(n, np.int64) * n_docs // n_all
            docs = Sparse(np.append(0, np.cumsum(size)), term, impacts(count, np.repeat(m, size)))
            search.batch(docs, np.array(keys, np.int64))
            for held in (keys, n, ids, tf):
                held.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                for held, value in zip((keys, n, ids, tf), row):
                    held.append(value)
                pairs += len(row[2]) // 4
                if len(keys) == BATCH_DOCS or pairs > BATCH_PAIRS:
                    flush()
                    pairs = 0
        if keys:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in search.best.held], ["nth", "score", "doc"])

    return task


def _blocks(items: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Items dealt to blocks of at most ``most`` pairs; an item beyond that is a block of its own."""
    size = F.size("terms")
    n = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // most))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum(size).alias("pairs"), F.count("*").alias("n"))
        if n > 1 << 20 or sizes.filter((F.col("pairs") > 2 * most) & (F.col("n") > 1)).isEmpty():
            return dealt, n
        n *= 2


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text",
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The ``k`` best documents of every item: the item's id, rank, the document's key, score.

    Terms, weights and scores are integers as the registered query states
    them; only scores above 0 are ranked, ties go to the smaller key. Keys of
    documents are integers; a document without one counts in the statistics
    and is not ranked. Null and empty texts have no terms: such items have no
    rows, such documents do not count. Repeated documents are ranked row by
    row; repeated items (same id and text) count once, items that share an id
    only are ranked apart. Other columns are not read; empty tables give an
    empty one. Items are searched for in blocks of about ``block_pairs``
    distinct (item, term) pairs, each a pass over the documents; one item and
    one document must fit a task's memory.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    wanted = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    wanted = wanted.mapInArrow(_item_terms, f"item {kind}, terms array<binary>, counts array<bigint>")
    dealt, n_blocks = _blocks(materialize(wanted.filter(F.size("terms") > 0), "items"), block_pairs)
    ranked = []
    for block in range(n_blocks):
        rows = dealt.filter(F.col("block") == block).select("item", "terms", "counts").toArrow().combine_chunks()
        if rows.num_rows:
            ranked.append(_ranked(docs, rows, k, kind))
    schema = f"item {kind}, rank int, doc long, score long"
    best = reduce(DataFrame.unionByName, ranked) if ranked else spark.createDataFrame([], schema)
    return best.withColumnsRenamed({"item": item, "doc": key})


def _ranked(docs: DataFrame, rows: pa.Table, k: int, kind: str) -> DataFrame:
    """The result for one block of items."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    terms, counts = rows.column("terms").to_pylist(), rows.column("counts").to_pylist()
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in terms for t in own}))}
    table = materialize(
        docs.mapInArrow(_doc_terms(context.broadcast(vocabulary)), "doc long, n long, ids binary, tf binary").filter("n > 0"), "terms"
    )
    n_docs, n_all = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = table.select("ids").mapInArrow(_frequencies(len(vocabulary)), "term long, df long")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long").alias("w")
    known = df.groupBy("term").agg(F.sum("df").alias("df")).select("term", "df", weight).toPandas()
    weights, frequency = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    weights[known["term"]], frequency[known["term"]] = known["w"], known["df"]

    own = [np.array(sorted((vocabulary[t], c) for t, c in zip(*x)), np.int64) for x in zip(terms, counts)]
    # Items of one language and kind begin with the same common terms.
    common = [sorted(x[:, 0], key=lambda t: -frequency[t])[:3] for x in own]
    order = sorted(range(len(own)), key=lambda i: common[i])
    term = np.concatenate([own[i][:, 0] for i in order])
    value = np.concatenate([own[i][:, 1] for i in order]) * weights[term]
    leaves = Sparse(np.append(0, np.cumsum([len(own[i]) for i in order])), term, value)
    levels = tree(leaves, FANOUT)

    found = table.filter("doc is not null and length(ids) > 0").select("doc", "n", "ids", "tf")
    first = F.pmod(F.xxhash64("doc"), F.lit(WAVE)) == 0
    schema = "nth long, score long, doc long"

    def wave(part: DataFrame, floor: np.ndarray) -> DataFrame:
        shared = context.broadcast((levels, weights, floor, n_docs, n_all))
        return materialize(part.mapInArrow(_search(shared, k), schema), "best")

    best = Window.partitionBy("nth").orderBy(F.desc("score"), "doc")
    place = F.row_number().over(best)
    floor = np.zeros(len(own), np.int64)
    ahead = wave(found.filter(first), floor)
    for row in ahead.withColumn("rank", place).filter(F.col("rank") == k).select("nth", "score").toLocalIterator():
        floor[row.nth] = row.score
    names = [rows.column("item")[i].as_py() for i in order]
    names = spark.createDataFrame(list(enumerate(names)), f"nth long, item {kind}")
    both = ahead.unionByName(wave(found.filter(~first), floor))
    return both.withColumn("rank", place).filter(F.col("rank") <= k).join(F.broadcast(names), "nth").select("item", "rank", "doc", "score")
