"""Alignment against both tokenizer libraries and plain counting; perfect hashing against a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF
from tocsin.llm.alignment import Alignment, PairCounts, Tokens, _narrow, _wide, align, spelled, tokenize, tree_sum
from tocsin.llm.perfect_hash import PerfectHash, bucket_of, build
from tocsin.llm.queries import QUERIES

BYTES, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_alphabet():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


ALPHABET = byte_alphabet()


def surface_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """Token occurrences with their byte ends, straight from the libraries; None without tokens."""
    if not text:
        return None
    a, b, whole = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text), (" " + text).encode()
    own = [bytes([ALPHABET[c] for c in A.id_to_token(i)]) for i in a]
    other = [surface_b(i) for i in b]
    if b"".join(own) != whole or b"".join(other) != whole:
        return None
    return a, b, np.cumsum([len(x) for x in own]).tolist(), np.cumsum([len(x) for x in other]).tolist()


def expected(rows):
    tokens = [(key, plain(text)) for key, text in rows]
    counts, links = Counter(), []
    for _, t in tokens:
        mine = []
        if t:
            a, b, ends_a, ends_b = t
            by_end = dict(zip(ends_b, b))
            mine = [(i, by_end[e]) for i, e in zip(a, ends_a) if e in by_end]
        links.append(mine)
        counts.update(mine)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (key, t), mine in zip(tokens, links):
        groups = []
        if t:
            a, b, ends_a, ends_b = t
            cuts, i, j = sorted(set(ends_a) & set(ends_b)), 0, 0
            for cut in cuts:
                u, v = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
                groups.append(",".join(map(str, a[i:u])) + "|" + ",".join(map(str, b[j:v])))
                i, j = u, v
        n_best = sum(counts[p] == best[p[1]] for p in mine)
        out.append((key, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(mine), n_best, sum(counts[p] for p in mine), ";".join(groups)))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[-1]))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    got = QUERIES["op11_alignment"](spark, SF).select(*COLUMNS[:-1], "groups_sha256").collect()
    assert ordered(got) == ordered([(*r[:-1], digest(r[-1])) for r in expected(rows)])


def odd(draw, n):
    signs = [" ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "word", "Zé", "ß", "12", "'s", "'", ".", "!?", "中文", "🙂", "é", "\0", "<|endoftext|>", "<s>", "<0x0A>", "\r\n", "don't"]
    return "".join(draw.choice(signs) for _ in range(draw.randint(0, n)))


def test_words_are_cut_where_tokens_end():
    """Word by word gives what the libraries give for whole texts."""
    draw, own = random.Random(6), Tokens(BYTES, PIECES)
    fixed = [" ", "  ", " a", "a ", "a  ", "\n a", "\n  a", "a \n b", "a\nb", "a\n\nb", "a\n", "\n", "x" * 500, " " * 300 + "a", "a\t b", "a \t b"]
    texts = [odd(draw, 12) for _ in range(6000)] + fixed
    ids = [own(t.encode()) for t in texts]
    laid = Alignment(own, *zip(*ids))
    for text, (a, b), groups in zip(texts, ids, laid.groups(spelled(BYTES, PIECES))):
        t = plain(text)
        if t is None:
            assert (a, b, groups) == (b"", b"", ""), repr(text)
            continue
        assert np.frombuffer(a, own.kind).tolist() == t[0] and np.frombuffer(b, own.kind).tolist() == t[1], repr(text)
        assert ",".join(g.split("|")[0] for g in groups.split(";")) == ",".join(map(str, t[0])), repr(text)


@pytest.mark.parametrize("keys", [{}, {"pass_keys": 200, "bucket_keys": 20}])
def test_odd_rows(spark, keys):
    """One pass, and many passes over few buckets each."""
    draw = random.Random(3)
    rows = [(i, odd(draw, 15)) for i in range(150)] + [(200 + i, "the same words for all") for i in range(100)]
    rows += [(1, None), (2, ""), (3, "a ▁ b"), (4, "▁"), (5, "long words " * 20_000), (6, "x" * 30_000), (None, "the words"), (7, "the words"), (7, "the words")]
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, n_a int, pair binary").repartition(5)
    assert ordered(align(df, BYTES, PIECES, **keys).select(COLUMNS).collect()) == ordered(expected(rows))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert align(df, BYTES, PIECES).collect() == [] and align(df, BYTES, PIECES).columns == COLUMNS
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordered(align(none, BYTES, PIECES).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_pair_counts(spark):
    """The hash is minimal and perfect over the distinct pairs, and its vector holds their counts."""
    rows = [(i, f"one two {i % 9} three three") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    counted = PairCounts(tokenize(df, BYTES, PIECES), BYTES, PIECES)
    counts = Counter()
    for _, text in rows:
        a, b, ends_a, ends_b = plain(text)
        by_end = dict(zip(ends_b, b))
        counts.update(i * len(counted.best) + by_end[e] for i, e in zip(a, ends_a) if e in by_end)
    table, vector = counted.passes[0]
    assert dict(zip(table.keys.tolist(), vector.tolist())) == counts and len(table) == counted.n_pairs


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    keys = np.unique(draw.integers(0, 1 << 62, n))
    n_buckets = max(1, n // 100)
    bucket = bucket_of(keys, n_buckets)
    built = {b: build(keys[bucket == b]) for b in np.unique(bucket).tolist()}
    table = PerfectHash.of(n_buckets, 0, built, n_buckets)
    assert np.array_equal(np.sort(table.places(keys)), np.arange(len(keys)))
    assert np.array_equal(table.keys[table.places(keys)], keys)
    if n > 100:
        half = n_buckets // 2
        part = PerfectHash.of(n_buckets, half, {b: x for b, x in built.items() if b >= half}, n_buckets - half)
        inside = bucket >= half
        assert (part.places(keys)[~inside] == -1).all()
        assert np.array_equal(np.sort(part.places(keys)[inside]), np.arange(inside.sum()))
    with pytest.raises(KeyError):
        table.places(np.array([-5]))


def test_tree_sum(spark):
    vectors = [(c, bytearray(_narrow(np.array([p, 0, 70_000 * p, c])))) for p in range(40) for c in (0, 5)]
    df = spark.createDataFrame(vectors, "chunk long, counts binary").repartition(10)
    assert {r.chunk: _wide(bytes(r.counts)).tolist() for r in tree_sum(df).collect()} == {
        0: [780, 0, 780 * 70_000, 0], 5: [780, 0, 780 * 70_000, 200]
    }
