"""Ids against the library, pieces against the binary digits."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from tocsin.llm.memo import Memo
from tocsin.llm.packing import WordTokenizer, cuts, pack, write_buckets
from tocsin.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_tokenizer_equals_the_library():
    own, draw = WordTokenizer(PATH), random.Random(4)
    signs = list("abcZÉéß ñ.,!?'*|#%1²½ªºµ \t\n\r\x0b\x0c\x1c\x85\xa0 ̸́ﬁΣσςİıǅ中文🙂<|>_-\0")
    signs += ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "don't", "é", "Å", "THE", "word!!"]
    for _ in range(5000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 9)))
        assert np.frombuffer(own.encode(text.encode()), "<u4").tolist() == ids_of(text)[:-1].tolist(), repr(text)


def test_memo_is_bounded_and_right():
    memo = Memo(lambda x: x * 2, 10)
    assert memo.all(list(range(100)) * 2) == [2 * x for x in range(100)] * 2
    assert len(memo.young) + len(memo.old) <= 20


@pytest.mark.parametrize("n", [1, 2, 3, 7, 4095, 4096, 4097, 8192, 12_345])
def test_cuts(n):
    at = 0
    for start, length in cuts(n):
        assert start == at and length <= 4096 and length & (length - 1) == 0
        at += length
    assert at == n
    assert len(cuts(n)) == n // 4096 + (n % 4096).bit_count()


def check(rows, pieces):
    by_row = {}
    for p in pieces:
        by_row.setdefault(p.doc_id, []).append(p)
    for i, text in rows:
        ids, at = ids_of(text), 0
        for p in sorted(by_row[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            yield p, ids[p.start : at].tobytes()
        assert at == len(ids)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = QUERIES["op5_packing"](spark, SF).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for p, own in check(rows, pieces):
        assert p.offset == 0 and p.ids_crc32 == zlib.crc32(own)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one " * 50_000), (5, "a<|endoftext|>b"), (6, "x" * 20_000)]
    df = spark.createDataFrame([(*r, 9, "b") for r in rows], "doc_id long, text string, start int, ids string")
    pieces = pack(df, PATH).collect()
    for p, own in check(rows, pieces):
        assert bytes(p.ids) == own and p.length == 1 << p.bucket
    assert [p.length for p in pieces if p.doc_id in (1, 2, 3)] == [1, 1, 1]
    twice = pack(df.unionByName(df), PATH).collect()
    assert len(twice) == 2 * len(pieces)
    assert pack(df.limit(0), PATH).collect() == []
    null = pack(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH).collect()
    assert [p.doc_id for p in null] == [None, None][: len(null)]
    with pytest.raises(ValueError):
        pack(df, PATH, window=1000)
    write_buckets(pack(df, PATH, window=64), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).agg({"length": "max"}).first()[0] == 64
