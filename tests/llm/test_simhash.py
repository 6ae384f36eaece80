"""Fingerprints, links and classes against brute force."""

import random
from itertools import combinations

import numpy as np
import xxhash

from tests.conftest import SF
from tocsin.llm.components import components
from tocsin.llm.queries import QUERIES
from tocsin.llm.simhash import TRIPLES, drop_near_duplicates, fingerprint, near_duplicates, similar_prints


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(
        {i: " " for i in (9, 10, 11, 12, 13)}
    ).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits=4):
    """Smallest index that links of at most ``bits`` differing bits reach."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = sorted((find(i), find(j)))
            label[b] = a
    return [find(i) for i in range(len(prints))]


def test_triples_cover_every_four_positions():
    assert all(any(set(t) <= set(q) for t in TRIPLES) for q in combinations(range(8), 4))
    assert len(TRIPLES) == 20


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = {r.doc_id: r for r in QUERIES["op7_simhash"](spark, SF).collect()}
    prints = [plain_fingerprint(t) for _, t in docs]
    want = classes(prints)
    assert len(rows) == len(docs)
    assert len(set(want)) < len(docs)
    for n, (i, _) in enumerate(docs):
        assert rows[i].fingerprint == f"{prints[n]:016x}"
        assert rows[i].component_id == docs[want[n]][0]


def test_no_link_is_lost_in_lists_of_any_length(spark):
    """Chains and clusters; blocks of three force long lists to be cut."""
    draw = random.Random(7)
    values = set()
    for _ in range(30):
        seed = draw.getrandbits(64)
        for _ in range(12):
            values.add(seed)
            for _ in range(draw.randint(1, 5)):
                seed ^= 1 << draw.randrange(64)
    values = sorted(values)
    want = classes(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "print long")
    for block in (4096, 3):
        links = similar_prints(df, block=block).collect()
        for a, b in links:
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 64
        place = {v: n for n, v in enumerate(signed)}
        label = list(range(len(values)))
        changed = True
        while changed:
            changed = False
            for a, b in links:
                low = min(label[place[a]], label[place[b]])
                changed |= label[place[a]] != low or label[place[b]] != low
                label[place[a]] = label[place[b]] = low
        assert label == want


LONG = "word " * 40_000
ROWS = [
    (9, "one two three four five six seven eight"),
    (4, "One TWO three four five six seven eight"),
    (7, None),
    (5, ""),
    (6, " \n\t"),
    (3, "only three words"),
    (None, "only  three\nwords"),
    (None, "a text that only rows without an id hold"),
    (None, "a text that only rows without an id hold"),
    (8, LONG),
    (2, LONG),
    (2, LONG),
    (1, "no break is part of a word here"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "clash", 0) for r in ROWS], "doc_id long, text string, print string, id int")
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(df).collect()]
    assert len(rows) == len(ROWS)
    named = {i: (f, c) for i, f, c in rows if i is not None}
    assert named[9] == (f"{plain_fingerprint(ROWS[0][1]):016x}", 4) and named[4][1] == 4
    assert [named[i] for i in (5, 6, 7)] == [("0" * 16, 5)] * 3
    assert named[8][1] == named[2][1] == 2
    assert sorted(c or 0 for i, _, c in rows if i is None) == [0, 0, 3]
    assert near_duplicates(df.limit(0)).collect() == []


def test_one_of_each_stays(spark):
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(ROWS)], "doc_id long, text string, n int")
    kept = drop_near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:12]) for r in kept) == sorted(
        [(4, "One TWO thre"), (5, ""), (3, "only three w"), (0, "a text that "), (2, LONG[:12]), (1, ROWS[-1][1][:12])]
    )
    assert all((ROWS[r.n][0], ROWS[r.n][1]) == (r.doc_id, r.text) for r in kept)
    assert drop_near_duplicates(df.limit(0)).collect() == []


def test_majority_needs_more_than_half():
    a, b = (xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d", b"b c d e"))
    assert fingerprint(b"A b\x0bc d e") == a & b


def test_components(spark):
    draw = np.random.default_rng(3)
    links = [(int(i), int(i) + 1) for i in range(0, 200)] + [tuple(map(int, x)) for x in draw.integers(1000, 1400, (250, 2))]
    links += [(-5, -5), (-7, 2000), (2000, -7)]
    label = {n: n for pair in links for n in pair}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {n: r for n, r in label.items() if n != r}
    assert components(df.limit(0)).collect() == []
