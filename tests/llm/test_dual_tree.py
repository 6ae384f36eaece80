"""Ranked search against SQL, a plain loop, and the bounds of the trees."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import compare, duck
from tests.conftest import SF
from tocsin.llm import dual_tree
from tocsin.llm.dual_tree import FANOUT, Search, Sparse, search, terms_of, tree
from tocsin.llm.queries import ORACLES, QUERIES

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    """The contract, word for word."""
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_all = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for doc, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * n_docs) // n_all
            score = 0
            for t in plain_terms(text):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=20, **options):
    docs = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "doc_id long, text string, rank int, item string, score long")
    items = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, doc_id int, doc string")
    return sorted(map(tuple, search(docs.repartition(3), items, k, **options).collect()), key=str)


def test_query(spark):
    assert compare(QUERIES["op12_lexical_search"](spark, SF), duck(SF), ORACLES["op12_lexical_search"]) == ""


def test_terms():
    draw, signs = random.Random(1), list("aZzÄß0 9/:@[`{~\x7f\x80é中🙂\n\tİ_-")
    for _ in range(2000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 12)))
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("block_pairs", [250_000, 40])
def test_against_a_plain_loop(spark, monkeypatch, block_pairs):
    draw = random.Random(block_pairs)
    words = [f"w{i}" for i in range(60)] + ["É", "ß", "中文"]

    def text(most):
        return " ".join(draw.choices(words, [1 / (i + 1) for i in range(len(words))], k=draw.randint(0, most)))

    docs = [(i, text(40)) for i in range(700)] + [(700 + i, "w1 W2, w50") for i in range(300)]  # a hot group of ties
    docs += [(2000, None), (2001, ""), (2002, "..."), (2003, "w3 " * 100_000), (5, "w3"), (5, "w3"), (None, "w3 w4")]
    items = [(i, text(12)) for i in range(40)] + [(50, None), (51, ""), (52, "unknown"), (53, "w1"), (53, "w1"), (53, "w2"), (None, "w7")]
    items += [(60, " ".join(words * 3))]
    assert found(spark, docs, items, 7, block_pairs=block_pairs) == plain(docs, items, 7)


def test_ties_go_to_the_smaller_document(spark):
    docs = [(i, "same words here" if i % 2 else f"other text {i}") for i in range(5000, 0, -1)]
    assert [(r, d) for _, r, d, _ in found(spark, docs, [(1, "words")], 3)] == [(1, 1), (2, 3), (3, 5)]


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a")], []) == []
    assert found(spark, [(1, None)], [(1, None)]) == []
    assert found(spark, [(1, "a"), (2, "b")], [(1, "c")]) == []


def rows(draw, n, n_terms, values):
    own = [sorted(draw.sample(range(n_terms), draw.randint(1, 6))) for _ in range(n)]
    start = np.append(0, np.cumsum([len(x) for x in own]))
    return Sparse(start, np.array(sum(own, []), np.int64), np.array([draw.randint(1, values) for _ in range(start[-1])], np.int64))


def dense(sparse, n_terms):
    out = np.zeros((len(sparse), n_terms), np.int64)
    out[np.repeat(np.arange(len(sparse)), np.diff(sparse.start)), sparse.term] = sparse.value
    return out


def test_nodes_hold_coordinate_maxima():
    draw = random.Random(2)
    leaves = rows(draw, 203, 30, 99)
    levels = tree(leaves, FANOUT)
    assert [len(x) for x in levels] == [203, 26, 4, 1]
    for low, high in zip(levels, levels[1:]):
        below, above = dense(low, 30), dense(high, 30)
        for i in range(len(high)):
            assert (above[i] == below[i * FANOUT : (i + 1) * FANOUT].max(axis=0)).all()
    vector = np.arange(30)
    assert (leaves.dot(np.array([5, 0, 7]), vector) == dense(leaves, 30)[[5, 0, 7]] @ vector).all()


@pytest.mark.parametrize("n_items", [1, 8, 150])
def test_pruning_is_exact_and_happens(n_items):
    """Batches in turn give the k best of all; with high floors whole batches are left out."""
    draw = random.Random(n_items)
    items, docs = rows(draw, n_items, 200, 50), rows(draw, 900, 200, 50)
    keys = np.array(draw.sample(range(5000), 900))
    one = Search(tree(items, FANOUT), np.arange(200), np.zeros(n_items, np.int64), 5)
    for at in range(0, 900, 300):
        one.batch(docs.take(np.arange(at, at + 300)), keys[at : at + 300])
    scores = dense(items, 200) @ dense(docs, 200).T
    got = sorted(zip(*(x.tolist() for x in one.best.held)))
    expected = []
    for i in range(n_items):
        ranked = sorted((-s, d) for s, d in zip(scores[i].tolist(), keys.tolist()) if s > 0)[:5]
        expected += [(i, -s, d) for s, d in ranked]
    assert got == sorted(expected)
    assert one.left_out > 0
    again = Search(tree(items, FANOUT), np.arange(200), scores.max(axis=1) + 1, 5)
    again.batch(docs, keys)
    assert not len(again.best.held[0]) and again.pairs < n_items * 900 / 4


def test_a_wave_is_no_sample(spark, monkeypatch):
    """Every document is searched once, whatever part goes ahead."""
    docs = [(i, f"a b c{i % 7} d{i}") for i in range(400)]
    items = [(1, "a c3 d77"), (2, "b c5")]
    results = []
    for wave in (1, 2, 10**9):
        monkeypatch.setattr(dual_tree, "WAVE", wave)
        results.append(found(spark, docs, items, 4))
    assert results[0] == results[1] == results[2] == plain(docs, items, 4)
