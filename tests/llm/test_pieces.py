"""Ids, spans and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tests.conftest import SF
from tocsin.llm.pieces import BLANK, Normaliser, PieceEncoder, encode
from tocsin.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
SIGNS = list("abcZ éß .,!'  \n\n\r\t中文🙂▁\0") + ["<s>", "</s>", "<0x0A>", "▁▁", "  ", "the", " of", "<unk>", "́", "　"]


def texts(n, more=()):
    draw = random.Random(9)
    signs = [*SIGNS, *more]
    return ["".join(draw.choice(signs) for _ in range(draw.randint(0, 9))) for _ in range(n)]


def test_ids_spans_and_decoding():
    own = PieceEncoder(PATH)
    assert own.cuttable
    for text in texts(4000):
        ids, plain, origin = own.encode(text.encode())
        want = LIBRARY.encode(text)
        assert ids.tolist() == want, repr(text)
        assert own.decode(want) == LIBRARY.decode(want).encode(), repr(text)
        spans, body = own.spans(ids, plain, origin).tolist(), text.encode()
        assert [s[0] for s in spans[1:]] == [s[1] for s in spans[:-1]]
        if spans:
            assert spans[0][0] == 0 and spans[-1][1] == len(body)
        for i, (start, end) in zip(want, spans):
            if not own.is_byte[i]:
                assert body[start:end].decode().replace("▁", " ") in (
                    own.surface[i].decode(), own.surface[i].decode()[1:]
                )


def test_decoding_of_any_ids():
    own, draw = PieceEncoder(PATH), random.Random(2)
    for _ in range(4000):
        ids = [draw.choice([draw.randrange(300), draw.randrange(300, 32_000)]) for _ in range(draw.randint(0, 6))]
        assert own.decode(ids) == LIBRARY.decode(ids).encode(), ids


def test_compiled_character_map():
    """Longest prefixes and squeezed blanks, against the library's own normaliser."""
    for squeeze in (True, False):
        theirs = sentencepiece.SentencePieceNormalizer(
            rule_name="nmt_nfkc", escape_whitespaces=True, remove_extra_whitespaces=squeeze, add_dummy_prefix=True
        )
        spec = sentencepiece_model_pb2.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec
        own = Normaliser(spec)
        for text in texts(4000, [*"ﬁ①Å½ﾊﾟｶﾞ㌀ｱ­\u0085​", "é", "ｶﾞ"]):
            out, origin = own(text.encode())
            assert out.replace(b" ", BLANK).decode() == theirs.normalize(text), repr(text)
            if out:
                assert len(origin) == len(out) + 1
                assert (np.diff(origin) >= 0).all() and origin[-1] <= len(text.encode())


def test_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op3_pieces"](spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for i, text in docs.items():
        ids = LIBRARY.encode(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "x" * 30_000), (5, "a b " * 20_000), (3, " "), (6, "\n\n ")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, ids int, key string")
    done = sorted((r.doc_id or 0, list(r.ids), r.decoded, len(r.spans)) for r in encode(df, PATH).collect())
    want = []
    for i, t in rows:
        ids = LIBRARY.encode(t or "")
        want.append((i or 0, ids, LIBRARY.decode(ids), 8 * len(ids)))
    assert done == sorted(want)
    assert encode(df.limit(0), PATH).collect() == []
