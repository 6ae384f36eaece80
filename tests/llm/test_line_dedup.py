"""Line dedup against a plain loop."""

import hashlib

import numpy as np
import pytest

from tests.conftest import SF
from tocsin.llm import line_dedup
from tocsin.llm.line_dedup import Bloom, drop_repeated_lines
from tocsin.llm.queries import QUERIES


def loop(rows, least=10):
    """{row number: (kept text, lines, dropped)} of (id, text) rows; a null id comes last."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: (i is None, i)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(order(i))
    out = {}
    for n, (i, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(h := holders[key(x)]) < 2 or min(h) == order(i)]
        out[n] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = loop(docs)
    got = {r.doc_id: r for r in QUERIES["op9_line_dedup"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert sum(w[2] for w in want.values()) > 0
    for n, (i, _) in enumerate(docs):
        text, lines, dropped = want[n]
        assert (got[i].n_lines, got[i].n_dropped) == (lines, dropped)
        assert got[i].kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


ROWS = [
    (5, "The same long line\nown line of five\nshort"),
    (3, "  the SAME long line\t\r\nshort\nthe same long line"),
    (9, "THE SAME LONG LINE\n\nßßßßßßßßßß same umlauts"),
    (9, "The same long line"),
    (4, None),
    (6, ""),
    (None, "the same long line\nonly without an id"),
    (None, "only without an id"),
    (7, "ßßßßßßßßßß same umlauts\nÄÄÄÄÄÄÄÄÄÄ\n123456789\nno-break\u00a0space line\u00a0"),
    (8, "ääääääääää\n123456789\nno-break\u00a0space line"),
    (1, "x" * 200_000 + "\n" + "\n" * 1000),
    (2, "X" * 200_000),
]


@pytest.mark.parametrize("slice_size", [line_dedup.SLICE, 1])
def test_odd_rows(spark, monkeypatch, slice_size):
    """With few and with many slices."""
    monkeypatch.setattr(line_dedup, "SLICE", slice_size)
    rows = [(n, *r, "clash", n) for n, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "n int, doc_id long, text string, n_lines string, id int").repartition(4)
    want, got = loop(ROWS), {r.n: r for r in drop_repeated_lines(df).collect()}
    assert len(got) == len(ROWS)
    for n in want:
        assert (got[n].text, got[n].n_lines, got[n].n_dropped) == want[n], ROWS[n]
        assert got[n].doc_id == ROWS[n][0] and got[n].id == n
    assert drop_repeated_lines(df.limit(0)).collect() == []


def test_bloom_has_what_it_was_given():
    draw = np.random.default_rng(1)
    known, other = draw.integers(0, 2**64, 20_000, np.uint64), draw.integers(0, 2**64, 20_000, np.uint64)
    bloom = Bloom(len(known))
    bloom.add(known)
    assert bloom.has(known).all()
    assert bloom.has(other).mean() < 0.02


def test_only_suspects_leave_their_task(spark, tmp_path):
    """The occurrences lie in buckets of their task: the plan that picks suspects shuffles answers only."""
    df = spark.range(8 * 500).repartition(8).selectExpr("id AS doc_id", "concat('line of its own ', id, '\\nshared by two ', id % 2000) AS text")
    seen = line_dedup._in_buckets_of_tasks(
        df.selectExpr("doc_id AS _id", "text AS _text").mapInArrow(
            line_dedup._occurrences(10), "task long, batch long, digests binary, ids binary"
        ),
        8,
    )
    told = seen.groupBy(seen.task.alias("asked")).count()
    plan = seen.join(told.hint("merge"), seen.task == told.asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = line_dedup.repeated_lines(df).collect()
    assert sorted(r.id for r in found) == list(range(2000, 4000))
    assert all(len(r.digests) == 1 for r in found)
