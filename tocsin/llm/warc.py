"""Web archives: written with revisits, segments and chunked bodies, and put together again.

Writing: pages with equal payloads are found by digest; the one with the
smallest key becomes a ``response`` record, the others ``revisit`` records that
refer to it. A response is an HTTP message with a body in chunked transfer
framing. A message longer than a segment is continued in ``continuation``
records. A record ends in an empty line, which is the line separator of Spark's
text writer, so archives are ordinary text output, whole files in gzip.

Reading: archives are parsed by content length, as a stream. Segmented records
are grouped by the identifier of the record that they continue, ordered by
segment number and verified against the stated total length; then the chunked
framing is decoded and the payload is verified against its digest. Revisits
take length and key from the response that they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches
from tocsin.llm.skew import hot_keys, join_hot
from tocsin.session import materialize, scratch_path

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Together with SEGMENT_BYTES the bound of what one file holds: 33 MB and the headers.
RECORDS_PER_FILE = 2000
BATCH_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailer fields are passed over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError("framing")
        n, at = int(size, 16), end + 2
        if not n:
            break
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("framing")
        parts.append(body[at : at + n])
        at += n + 2
    if body[at : at + 2] != b"\r\n" and b"\r\n\r\n" not in body[at:]:
        raise ValueError("framing")
    return b"".join(parts)


def http_payload(message: bytes) -> bytes:
    """Body of an HTTP message without its transfer framing."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("framing")
    fields = dict(_fields(line.decode("latin-1") for line in head.split(b"\r\n")[1:]))
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return unchunked(body)
    length = fields.get("content-length")
    if length is not None and (not length.isdigit() or len(body) < int(length)):
        raise ValueError("framing")
    return body if length is None else body[: int(length)]


def _fields(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            yield name.strip().lower(), value.strip()


def _visible(value) -> str:
    """A header value: blanks and control characters would break the line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join([f"{k}: {v}\r\n" for k, v in fields])
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


class _Writer:
    def __init__(self, run: str, date: str, segment: int):
        self.run, self.date, self.segment = run, date, segment

    def name(self, row: int, number: int = 1) -> str:
        place = hashlib.md5(f"{self.run}/{row}/{number}".encode(), usedforsecurity=False)
        return f"<urn:uuid:{uuid.UUID(bytes=place.digest())}>"

    def head(self, kind: str, row: int, number: int, key, url) -> list[tuple[str, str]]:
        fields = [("WARC-Type", kind), ("WARC-Record-ID", self.name(row, number)), ("WARC-Date", self.date)]
        if url is not None:
            fields.append(("WARC-Target-URI", _visible(url)))
        if key is not None:
            fields.append(("Page-Key", _visible(key)))
        return fields

    def revisit(self, row: int, key, url, digest: str, first: int) -> bytes:
        fields = self.head("revisit", row, 1, key, url)
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", self.name(first))]
        fields += [("WARC-Payload-Digest", f"sha1:{base32_digest(digest)}")]
        return _record([*fields, ("Content-Type", "application/http;msgtype=response")], HTTP_HEAD)

    def response(self, row: int, key, url, digest: str, payload: bytes) -> Iterator[bytes]:
        message = HTTP_HEAD + chunked(payload)
        blocks = [message[at : at + self.segment] for at in range(0, len(message), self.segment)]
        fields = self.head("response", row, 1, key, url)
        fields += [("WARC-Payload-Digest", f"sha1:{base32_digest(digest)}")]
        fields += [("Content-Type", "application/http;msgtype=response")]
        if len(blocks) > 1:
            fields.append(("WARC-Segment-Number", "1"))
        yield _record(fields, blocks[0])
        for number, block in enumerate(blocks[1:], 2):
            fields = self.head("continuation", row, number, key, url)
            fields += [("WARC-Segment-Number", str(number)), ("WARC-Segment-Origin-ID", self.name(row))]
            if number == len(blocks):
                fields.append(("WARC-Segment-Total-Length", str(len(message))))
            yield _record(fields, block)


def _records(run: str, date: str, segment: int):
    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        writer, held, size = _Writer(run, date, segment), [], 0
        for batch in batches:
            for row, key, url, digest, payload, first in zip(*[c.to_pylist() for c in batch.columns]):
                if first is None or first == row:
                    made = writer.response(row, key, url, digest, payload)
                else:
                    made = iter([writer.revisit(row, key, url, digest, first)])
                for record in made:
                    held.append(record)
                    size += len(record)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["record"])

    return task


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, segment: int = SEGMENT_BYTES, per_file: int = RECORDS_PER_FILE, date: str | None = None,
) -> None:
    """Write one record per row, and continuations of long ones, to a folder of archives.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the smallest key is the response (null keys come last; among repeated rows
    it is the first in the table); others revisit it. A null text is empty.
    Blanks and control characters of addresses and keys are written as ``%XX``;
    null ones are left out. Other columns are not read. An empty table gives
    no records. The rows are numbered and written to the shared folder first,
    since both passes must see the same numbers; that copy is deleted at the end.
    """
    spark, staged = pages.sparkSession, scratch_path(pages.sparkSession, "pages")
    pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).write.parquet(staged)
    rows = spark.read.parquet(staged)
    first = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "row")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", F.col("first.row").alias("first"), "n")
    )
    first = materialize(first, "first")
    judged = join_hot(rows, first.select("digest", "first"), "digest", hot_keys(first, "digest", "n"))
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    records = judged.select("row", "key", "url", "digest", "payload", "first").mapInArrow(
        _records(uuid.uuid4().hex, date, segment), "record binary"
    )
    # The text writer takes the bytes as they are and puts the end of a record after each.
    records.select(F.col("record").cast("string").alias("value")).write.options(
        lineSep=END, compression="gzip", maxRecordsPerFile=per_file
    ).text(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_PARSED = (
    "record_id string, kind string, number long, origin string, total long, key string, url string,"
    " refers string, stated string, block binary, payload binary, payload_digest string, status string"
)
_NAMES = [f.split()[0] for f in _PARSED.split(",")]


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive, by content length."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin where the one before it ends")
        lines = []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("archive ends in a header")
            lines.append(line.decode("utf-8", "replace"))
        fields = dict(_fields(lines))
        length = int(fields.get("content-length", ""))
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("archive ends in a block")
        yield fields, block


def _sound(message: bytes, stated: str | None) -> tuple[bytes | None, str | None, str]:
    """Payload of a whole message, its digest, and what is wrong with it."""
    try:
        payload = http_payload(message)
    except ValueError:
        return None, None, "framing"
    own = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    other = bool(stated) and stated.lower().startswith("sha1:") and stated[5:].upper() != own
    return payload, own, "digest" if other else "ok"


def _parsed(content: bytes) -> Iterator[tuple]:
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    for fields, block in parse(stream):
        kind = fields.get("warc-type")
        if kind not in ("response", "continuation", "revisit"):
            continue
        number = fields.get("warc-segment-number")
        payload = own = status = None
        if kind == "response" and number is None:
            payload, own, status = _sound(block, fields.get("warc-payload-digest"))
        yield (
            fields.get("warc-record-id"), kind, int(number) if number else None, fields.get("warc-segment-origin-id"),
            int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None,
            fields.get("page-key"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-payload-digest"), block if number else None, payload, own, status,
        )


def _table(rows: list[tuple], names: list[str], binary: tuple[str, ...], whole: tuple[str, ...] = ()) -> pa.RecordBatch:
    kinds = [pa.binary() if n in binary else pa.int64() if n in whole else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _parse_files(batches: Batches) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for content in batch.column(0):
            for row in _parsed(content.as_py()):
                held.append(row)
                size += len(row[9] or b"") + len(row[10] or b"") + 500
                if size > BATCH_BYTES:
                    yield _table(held, _NAMES, ("block", "payload"), ("number", "total"))
                    held, size = [], 0
    if held:
        yield _table(held, _NAMES, ("block", "payload"), ("number", "total"))


def assembled(segments: list[dict]) -> tuple[bytes | None, str]:
    """Block of a segmented record: numbers 1 to n without a gap, and the length that the last one states.

    A repeated segment counts once.
    """
    by_number = {s["number"]: s for s in reversed(segments)}
    parts = [by_number[n] for n in sorted(by_number)]
    if [s["number"] for s in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] is None:
        return None, "segments"
    block = b"".join([s["block"] for s in parts])
    return (block, "ok") if len(block) == parts[-1]["total"] else (None, "length")


def _assemble(batches: Batches) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "key", "url", "payload", "payload_digest", "status"]
    for batch in batches:
        for at in range(batch.num_rows):
            part = batch.slice(at, 1)
            origin, segments = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            first = next((s for s in segments if s["kind"] == "response"), {})
            block, status = assembled(segments) if first else (None, "segments")
            payload = own = None
            if block is not None:
                payload, own, status = _sound(block, first["stated"])
            yield _table([(origin, first.get("key"), first.get("url"), payload, own, status)], names, ("payload",))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response and revisit of a folder of archives, plain or in gzip.

    Columns: record_id, key, url, record_type, payload (null for revisits),
    payload_bytes and payload_digest (base32 of SHA-1, of the full payload, for
    revisits that of the response), refers_to (key of that response), status.
    Status is ``ok``, or what is wrong: ``segments`` (one is missing),
    ``length`` (segments do not add up), ``framing``, ``digest`` (other payload
    than stated) or ``unresolved`` (a revisit without its response); the payload
    is null where it cannot be told. A file is parsed by one task; files
    written here are bounded by their number of records. Records of other
    types are passed over; a folder without records gives an empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = materialize(files.mapInArrow(_parse_files, _PARSED), "records")
    columns = ["record_id", "key", "url", "payload", "payload_digest", "status"]
    whole = parsed.filter("kind = 'response' and number is null").select(columns)
    segments = (
        parsed.filter("kind <> 'revisit' and number is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(F.collect_list(F.struct("number", "total", "kind", "key", "url", "stated", "block")).alias("segments"))
    )
    joined = segments.mapInArrow(
        _assemble, "record_id string, key string, url string, payload binary, payload_digest string, status string"
    )
    responses = whole.unionByName(materialize(joined, "joined")).select(
        "*",
        F.lit("response").alias("record_type"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lit(None).cast("string").alias("refers_to"),
    )
    met = responses.groupBy(F.col("record_id").alias("refers")).agg(
        F.min(F.struct("key", "payload_bytes", "payload_digest")).alias("met")
    )
    revisits = parsed.filter("kind = 'revisit'").select("record_id", "key", "url", "refers", "stated")
    counts = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    differs = F.upper(F.substring("stated", 6, 32)) != F.col("met.payload_digest")
    unresolved = F.col("met.payload_digest").isNull()
    found = join_hot(revisits, met, "refers", hot_keys(counts, "refers", "n")).select(
        "record_id",
        "key",
        "url",
        F.lit(None).cast("binary").alias("payload"),
        F.col("met.payload_digest").alias("payload_digest"),
        F.when(unresolved, "unresolved").when(differs, "digest").otherwise("ok").alias("status"),
        F.lit("revisit").alias("record_type"),
        F.col("met.payload_bytes").alias("payload_bytes"),
        F.col("met.key").alias("refers_to"),
    )
    return responses.unionByName(found)
