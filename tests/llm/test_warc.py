"""Archives against SQL, a plain reading of the same files, and damaged records."""

import base64
import glob
import gzip
import hashlib
import io
import random

import pytest

from tests.compare import compare, duck
from tests.conftest import SF
from tocsin.llm.queries import ORACLES, QUERIES
from tocsin.llm.warc import assembled, chunked, http_payload, parse, read_archives, unchunked, write_archives

SCHEMA = "page_id long, url string, html string, row long, first string"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query(spark):
    assert compare(QUERIES["op13_warc"](spark, SF), duck(SF), ORACLES["op13_warc"]) == ""


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 100_000])
def test_chunks(size):
    payload = random.Random(size).randbytes(size)
    assert unchunked(chunked(payload)) == payload
    assert unchunked(chunked(payload, 7)) == payload


def test_foreign_framing():
    assert unchunked(b"4;name=x\r\nabcd\r\n0A\r\n0123456789\r\n0\r\nTrailer: y\r\n\r\n") == b"abcd0123456789"
    for broken in (b"", b"4\r\nabc", b"x\r\nabcd\r\n0\r\n\r\n", b"4\r\nabcdef\r\n0\r\n\r\n", b"0\r\n", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            unchunked(broken)
    assert http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabcdef") == b"abc"
    assert http_payload(b"HTTP/1.1 200 OK\r\n\r\nabcdef") == b"abcdef"
    with pytest.raises(ValueError):
        http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nabcdef")


def written(spark, rows, path, **options):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    write_archives(df, str(path), **options)
    return read_archives(spark, str(path)).collect()


def test_odd_rows(spark, tmp_path):
    long = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9000 + "é🙂" * 1000
    rows = [
        (5, "http://a/\r\nX: y z", None), (3, None, ""), (9, "http://b", "same"), (7, "http://c", "same"), (7, "http://c", "same"),
        (None, "http://d", "same"), (8, "u", long), (2, "u", long), (None, None, "only null"), (11, "é", "\r\n\r\n"), (12, "e", "x" * 16384),
    ]
    back = written(spark, rows, tmp_path / "a", per_file=5)
    assert {r.status for r in back} == {"ok"} and len(back) == len(rows) == len({r.record_id for r in back})
    assert len(glob.glob(str(tmp_path / "a/*.gz"))) > 8
    expected = {"": (3, 1), "same": (7, 3), long: (2, 1), "only null": (None, 0), "\r\n\r\n": (11, 0), "x" * 16384: (12, 0)}
    for text, (first, n) in expected.items():
        group = [r for r in back if r.payload_digest == b32(text.encode())]
        assert [r.payload.decode() for r in group if r.record_type == "response"] == [text]
        assert len([r for r in group if r.record_type == "revisit"]) == n
        for r in group:
            assert r.payload_bytes == len(text.encode())
            assert r.refers_to == (None if r.record_type == "response" else str(first))
            if r.record_type == "response":
                assert r.key == (None if first is None else str(first))
            else:
                assert r.payload is None
    assert sorted(r.key or "" for r in back) == sorted("" if k is None else str(k) for k, _, _ in rows)
    assert "http://a/%0D%0AX:%20y%20z" in {r.url for r in back}


def test_records_on_disk(spark, tmp_path):
    """A plain parser sees segments in order, each with its length, and the empty line after every record."""
    written(spark, [(1, "u", "a" * 50_000), (2, "v", "b")], tmp_path / "a", segment=10_000)
    seen = []
    for name in glob.glob(str(tmp_path / "a/*.gz")):
        data = gzip.open(name).read()
        assert not data or data.endswith(b"\r\n\r\n")
        seen += list(parse(io.BytesIO(data)))
    long = [(f, b) for f, b in seen if "warc-segment-number" in f]
    assert [int(f["warc-segment-number"]) for f, _ in long] == list(range(1, len(long) + 1)) and len(long) == 6
    assert {f.get("warc-segment-origin-id") for f, _ in long[1:]} == {long[0][0]["warc-record-id"]}
    assert int(long[-1][0]["warc-segment-total-length"]) == sum(len(b) for _, b in long)
    assert http_payload(b"".join(b for _, b in long)) == b"a" * 50_000


def test_small_payloads_are_never_revisits(spark, tmp_path):
    back = written(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")], tmp_path / "a", least_bytes=4)
    assert sorted((r.key, r.refers_to) for r in back if r.record_type == "revisit") == [("4", "3")]


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    write_archives(df, str(tmp_path / "a"))
    back = read_archives(spark, str(tmp_path / "a"))
    assert back.collect() == [] and "payload_digest" in back.columns


def test_hot_payload(spark, tmp_path):
    """A payload on a third of all rows, and a thousand on two rows each: the same answer as plain groups."""
    rows = [(i, "u", "hot" if i % 3 == 0 else f"text {i // 6}") for i in range(3000)]
    back = written(spark, rows, tmp_path / "a")
    first = {}
    for i, _, text in rows:
        first[text] = min(first.get(text, i), i)
    assert {(int(r.key), r.refers_to and int(r.refers_to)) for r in back} == {
        (i, None if first[t] == i else first[t]) for i, _, t in rows
    }


def record(fields, block=b""):
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Plain files with segments out of order, in two files, repeated, missing or too short."""
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(b"payload" * 10, 9)
    parts = [message[:40], message[40:90], message[90:]]

    def segment(name, i, total=None):
        fields = {"WARC-Type": "continuation" if i else "response", "WARC-Record-ID": f"{name}{i or ''}", "Page-Key": name}
        fields |= {"WARC-Segment-Number": i + 1} | ({"WARC-Segment-Origin-ID": name} if i else {})
        return record(fields | ({"WARC-Segment-Total-Length": total} if total else {}), parts[i])

    n = len(message)
    one = record({"WARC-Type": "warcinfo"}, b"x") + segment("<a>", 2, n) + segment("<a>", 0) + segment("<b>", 0) + segment("<b>", 2, n)
    two = segment("<a>", 1) + segment("<a>", 1) + segment("<c>", 0) + segment("<c>", 1) + segment("<c>", 2, n + 1)
    two += segment("<d>", 1) + record({"WARC-Type": "response", "WARC-Record-ID": "<e>", "WARC-Payload-Digest": "sha1:AAAA"}, message)
    two += record({"WARC-Type": "response", "WARC-Record-ID": "<f>"}, message[:-9])
    two += record({"WARC-Type": "revisit", "WARC-Record-ID": "<g>", "WARC-Refers-To": "<a>"})
    two += record({"WARC-Type": "revisit", "WARC-Record-ID": "<h>", "WARC-Refers-To": "<none>"})
    (tmp_path / "one.warc").write_bytes(one)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(two[:300]) + gzip.compress(two[300:]))
    back = {r.record_id: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in back.items()} == {
        "<a>": "ok", "<b>": "segments", "<c>": "length", "<d>": "segments", "<e>": "digest", "<f>": "framing",
        "<g>": "ok", "<h>": "unresolved",
    }
    assert bytes(back["<a>"].payload) == b"payload" * 10 and back["<g>"].payload_bytes == 70 and back["<g>"].refers_to == "<a>"
    assert all(back[k].payload is None for k in ("<b>", "<c>", "<d>", "<f>", "<g>", "<h>"))


def test_assembled():
    parts = [{"number": i, "total": None, "block": b"ab"} for i in (1, 2, 3)]
    assert assembled(parts) == (None, "segments")
    parts[2]["total"] = 6
    assert assembled(parts[::-1]) == (b"ababab", "ok")


def test_plan_has_no_unbounded_broadcast(spark, tmp_path):
    """With broadcasts of Spark's own choice off, only hot keys are broadcast."""
    from pyspark.sql import functions as F

    from tocsin.llm.skew import hot_keys, join_hot

    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), "k", "n")
    assert [r.k for r in hot.collect()] == [0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_hot(left, right, "k", hot)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
        assert sorted((r.id, r.v) for r in joined.collect()) == [(i, 0 if i % 3 == 0 else 2 * i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
