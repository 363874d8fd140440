"""WARC archives: one gzip member per record, written by Spark's text sink, read back by byte ranges.

Writing: the sink commits whole files, so lost tasks leave no halves. It ends every record with a separator; the
separator is the zero byte that ends every member below 16 MiB (its length field), and a longer member gets
an empty member behind it, which ends so too.

Reading: files are cut into byte ranges. A task looks for gzip magic from the start of its range, takes a
candidate only if it decodes to a WARC header, owns the records that start inside, and follows the
last of them past the range's end.

Damage is never passed over: the first record stands at offset 0, and behind each record there must be another one, or the end of the file, also
when it belongs to the next range. So whatever breaks, magic, header, content or length, breaks the chain at some
record, and ``read`` fails there; ``damages`` lists such places instead, and ``read`` with ``intact_only`` goes on behind them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@dataclass(frozen=True)
class Warc:
    min_bytes: int = 0              # payloads below are never revisits
    range_bytes: int = 4 << 20      # of a reading task
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


def revisits(pages: DataFrame, p: Warc = Warc()) -> DataFrame:
    """``pages`` with payload, sha1 and refers_to: the smallest page_id of the equal payloads, for all other ids.

    Only payloads that occur twice take part in the join.
    """
    plain = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    equal = (plain.where(F.octet_length("payload") >= p.min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                  .where("n > 1").select("sha1", "first"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return plain.join(equal, "sha1", "left").withColumn("refers_to", F.when(again & (F.octet_length("payload") >= p.min_bytes), F.col("first"))).drop("first")


def record(page_id, url, payload: bytes, sha1: str, refers_to, p: Warc) -> bytes:
    """A gzip member that ends with a zero byte."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {p.date}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(p.level, zlib.DEFLATED, 31)
    member = z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()
    if member[-1]:
        z = zlib.compressobj(p.level, zlib.DEFLATED, 31)
        member += z.flush()
    return member


def write(pages: DataFrame, path: str, p: Warc = Warc()) -> None:
    """Archives below ``path``. Null html: empty payload. Null ids or urls: header left out. Repeated rows: a record each
    (rows with the group's smallest id are all responses). Empty table: no records."""
    def f(ids: pa.Array, urls: pa.Array, payloads: pa.Array, sha1s: pa.Array, firsts: pa.Array) -> pa.Array:
        return pa.array([record(i.as_py(), u.as_py(), b.as_py(), s.as_py(), r.as_py(), p)[:-1] for i, u, b, s, r in zip(ids, urls, payloads, sha1s, firsts)], pa.binary())

    member = F.arrow_udf(f, "binary")("page_id", "url", "payload", "sha1", "refers_to")
    revisits(pages, p).select(member.cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


class _File:
    """Buffered reads of a random-access file at growing offsets."""

    def __init__(self, path: str):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[5:]
        fs, inner = pa.fs.FileSystem.from_uri(path)
        self.f, self.size = fs.open_input_file(inner), fs.get_file_info(inner).size

    def at(self, pos: int, n: int) -> bytes:
        return self.f.read_at(max(0, min(n, self.size - pos)), pos)


class Damage(ValueError):
    """A record that should be there and doesn't decode."""

    def __init__(self, offset: int, reason: str):
        super().__init__(f"damaged record at offset {offset}: {reason}")
        self.offset, self.reason = offset, reason


def member_at(f: _File, pos: int, chunk: int = 1 << 16, header_only: bool = False) -> tuple[bytes, int] | None:
    """Content of the gzip member at ``pos`` and the offset behind it; None if it is none, or no WARC record.

    An empty member is content b"". The header is judged before the rest is read; a member with the header that then breaks
    off is a ``Damage``.
    """
    z, out, at = zlib.decompressobj(31), b"", pos
    parts: list[bytes] = []
    while not z.eof:
        data = f.at(at, chunk)
        if not data:
            reason = "the file ends within it"
        else:
            at += len(data)
            try:
                parts.append(z.decompress(data))
                reason = None
            except zlib.error as e:
                reason = str(e)
        if reason is not None:
            if len(out) < 7:
                return None
            raise Damage(pos, reason)
        if len(out) < 7:
            out += parts[-1]
            if out and not b"WARC/1."[: len(out)] == out[:7]:
                return None
        if header_only and len(out) >= 7:
            return b"", at
    return b"".join(parts), at - len(z.unused_data)


def records(f: _File, start: int, end: int, window: int = 1 << 18, found_damage: list[Damage] | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end). Damages are raised, or gathered in ``found_damage``."""
    pos, chained = start, start == 0
    while pos < end:
        try:
            found = member_at(f, pos) if f.at(pos, 3) == MAGIC else None
            if found is None and chained:
                raise Damage(pos, "no record where one ends")
        except Damage as e:
            if found_damage is None:
                raise
            found_damage.append(e)
            found = None
        if found is not None:
            at, chained = pos, True
            content, pos = found
            if content:
                yield at, content
            continue
        chained = False
        # no member here: the next place with magic
        data = f.at(pos + 1, min(window, end - pos - 1) + 2)
        k = data.find(MAGIC)
        pos = pos + 1 + k if k >= 0 else pos + 1 + max(1, len(data) - 2)
    if chained and pos < f.size and end > start:       # the next range takes its first record for granted
        try:
            broken = f.at(pos, 3) != MAGIC or member_at(f, pos, header_only=True) is None
        except Damage:
            broken = False                             # its owner reports it
        if broken:
            if found_damage is None:
                raise Damage(pos, "no record where one ends")
            found_damage.append(Damage(pos, "no record where one ends"))


def parsed(content: bytes) -> dict:
    head, _, block = content.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length")))
    ident = lambda x: int(x[len("<urn:page:"):-1]) if x else None
    response = h["WARC-Type"] == "response"
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {h.get('WARC-Record-ID')}: payload and digest differ")
    return {"page_id": ident(h.get("WARC-Record-ID")), "url": h.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
            "record_type": h["WARC-Type"], "refers_to": ident(h.get("WARC-Refers-To")), "payload": payload if response else None}


def _ranges(spark: SparkSession, path: str, p: Warc) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(p.range_bytes).cast("long"))).alias("start")
    return files.select("path", "length", starts).repartition(max(1, -(-total // p.range_bytes)), "path", "start")


def _checked(at: int, content: bytes) -> dict:
    try:
        return parsed(content)
    except (ValueError, KeyError, IndexError, StopIteration) as e:
        raise Damage(at, f"{type(e).__name__}: {e}") from None


def read(spark: SparkSession, path: str, p: Warc = Warc(), payloads: bool = True, intact_only: bool = False) -> DataFrame:
    """The records below ``path``; payload (null for revisits) only on demand. Any URI that pyarrow opens. A damaged archive
    fails the job with the file and offset, or with ``intact_only`` gives its other records (``damages`` lists what is missing)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    size = p.range_bytes

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file, some, n = _File(row["path"]), [], 0
                try:
                    for at, content in records(file, row["start"], min(row["start"] + size, row["length"]), found_damage=[] if intact_only else None):
                        try:
                            r = _checked(at, content)
                        except Damage:
                            if intact_only:
                                continue
                            raise
                        some.append(r if payloads else r | {"payload": None})
                        n += len(content) if payloads else 200
                        if n >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some, n = [], 0
                except Damage as e:
                    raise ValueError(f"{row['path']}: {e}") from None
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    out = _ranges(spark, path, p).mapInArrow(f, RESULT)
    return out if payloads else out.drop("payload")


def damages(spark: SparkSession, path: str, p: Warc = Warc()) -> DataFrame:
    """(path, offset, reason) of the places below ``path`` where a record should be and doesn't decode, or isn't what its headers say."""
    size = p.range_bytes

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found: list[Damage] = []
                for at, content in records(_File(row["path"]), row["start"], min(row["start"] + size, row["length"]), found_damage=found):
                    try:
                        _checked(at, content)
                    except Damage as e:
                        found.append(e)
                if found:
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]] * len(found), "offset": [e.offset for e in found], "reason": [e.reason for e in found]})

    return _ranges(spark, path, p).mapInArrow(f, "path string, offset long, reason string").distinct()
