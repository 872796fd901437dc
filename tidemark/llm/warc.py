"""WARC archives of pages, and their reading back with segment reassembly.

Writing: each page becomes a response record whose block is an HTTP answer with chunked transfer framing.  Of pages
with equal payloads of at least ``least`` bytes the one with the largest page_id is the response, the others are
revisit records that refer to it and hold the HTTP head alone.  A block longer than ``segment`` bytes is divided: the first
part stays in the response (segment number 1), the rest goes into continuation records that name it as their origin; the
last gives the total length.  Archives of about ``archive`` bytes are text files written by Spark, one row a file.

Reading: archives, plain or of any number of gzip members, are parsed record by record; records of other kinds are passed over.  Whole records are judged at once; segments are dealt by their origin,
put in the order of their numbers, checked against the total length and joined; then the chunked framing is decoded.

Scale: pages are read once for their digests (in the JVM) and once for the archives.  Only digests are grouped, with
map-side combining; the response of a group is found by a join of digests whose small side Spark broadcasts only below
its own size threshold and otherwise deals with both sides, splitting hot digests.  Only segments are shuffled.

Defined cases: null html is an empty payload; a null url is an empty target; rows that repeat the response's page_id and
payload are responses as well; a null page_id never is the response of a group that has another; a record with a missing
segment, a wrong length or broken framing is returned with ``intact`` false and no payload digest; a record that names no
page has a null page_id; an empty table makes no archive and no row; very long html goes into as many segments as it takes; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import slices, utf8_list

CRLF = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = b"2024-01-01T00:00:00Z"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; trailers are skipped.  Raises ValueError if the framing is broken."""
    at, parts = 0, []
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk is shorter or longer than it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = b"".join(b"%b: %b\r\n" % field for field in fields)
    return b"WARC/1.1\r\n%bContent-Length: %d\r\n\r\n%b" % (head, len(block), block)


def records_of(page_id: int | None, url: str, payload: bytes, refers_to: int | None, unique: str, segment: int) -> Iterator[bytes]:
    """The record of a page, followed by its continuations."""
    name = b"<urn:page:%b:%b>" % (b"" if page_id is None else b"%d" % page_id, unique.encode())
    target = urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~").encode()
    common = [(b"WARC-Date", DATE), (b"WARC-Record-ID", name), (b"WARC-Target-URI", target), (b"WARC-Payload-Digest", b"sha1:" + base32_sha1(payload).encode()), (b"Content-Type", b"application/http; msgtype=response")]
    if refers_to is not None:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([(b"WARC-Type", b"revisit"), *common, (b"WARC-Refers-To", b"<urn:page:%d:>" % refers_to), (b"WARC-Profile", profile)], HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record([(b"WARC-Type", b"response"), *common], block)
        return
    yield record([(b"WARC-Type", b"response"), *common, (b"WARC-Segment-Number", b"1")], block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        last = [(b"WARC-Segment-Total-Length", b"%d" % len(block))] if at + segment >= len(block) else []
        own = b"<urn:page:%b:%b:%d>" % (b"" if page_id is None else b"%d" % page_id, unique.encode(), number)
        yield record(
            [(b"WARC-Type", b"continuation"), (b"WARC-Date", DATE), (b"WARC-Record-ID", own), (b"WARC-Target-URI", target), (b"WARC-Segment-Origin-ID", name), (b"WARC-Segment-Number", b"%d" % number), *last],
            block[at : at + segment],
        )


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = 32 << 10, archive: int = 8 << 20) -> None:
    """Write the archives of (page_id, url, html) below ``path``, gzip-compressed."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("digest_", F.sha1(html.cast("binary")))
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest_").agg(F.max("page_id").alias("first_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    rows = rows.join(groups, "digest_", "left")
    revisits = F.when(F.octet_length("html") >= least, F.when(F.col("first_").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(CRLF + CRLF).join(held)], pa.large_binary() if size > 1 << 31 else pa.binary())], names=["archive"])

        for batch in slices(batches, 256, "html", 4 << 20):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_")]
            for page, url, refers, payload in zip(*columns, utf8_list(batch.column("html")), strict=True):
                serial += 1
                for found in records_of(page, url or "", payload, refers, f"{part}-{serial}", segment):
                    held.append(found)
                    size += len(found) + 4
                    if size >= archive:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    archives = rows.select("page_id", "url", "html", revisits.alias("refers_")).mapInArrow(run, "archive binary")
    # the text writer ends each file's only row with the two line ends that close its last record
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_HEAD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def inflated(raw: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """What an archive holds, in pieces: one gzip member after the other (a member a record is usual), or the bytes as they are."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(raw):
            fed = view[at : at + piece]
            yield member.decompress(fed)
            at += len(fed) - len(member.unused_data)
        if not member.eof:
            raise ValueError("the last gzip member is cut short")
        while at < len(raw) and raw[at : at + 1] == b"\0":  # padding between members
            at += 1


def parse(raw: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header, block) of each record of an archive that is not packed."""
    return parse_pieces([raw])


def parse_pieces(pieces: Iterable[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header, block) of each record of an archive that comes in pieces; holds one record and one piece at a time."""
    held, done, source = bytearray(), 0, iter(pieces)

    def more() -> bool:
        for piece in source:
            if piece:
                held.extend(piece)
                return True
        return False

    while held or more():
        while len(held) < 5 and more():
            pass
        if held[:5] != b"WARC/":
            raise ValueError(f"no record at byte {done}")
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError(f"the record at byte {done} has no end of its header")
        head = {k.lower(): v for k, v in _HEAD.findall(bytes(held[: end + 2]), held.index(CRLF) + 2)}
        start, size = end + 4, int(head[b"content-length"])
        while len(held) < start + size + 4 and more():
            pass
        if held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {done} does not end where it says")
        yield head, bytes(held[start : start + size])
        del held[: start + size + 4]
        done += start + size + 4


def _page_of(name: bytes | None) -> int | None:
    """The page_id in a record id that :func:`records_of` has made; other ids have none."""
    found = re.fullmatch(rb"<urn:page:(-?\d+):.*>", name or b"", re.S)
    return int(found[1]) if found else None


#: Kinds of records that hold pages; all others (warcinfo, request, metadata, ...) are passed over.
PAGES = (b"response", b"revisit")


def judge(head: dict[bytes, bytes], block: bytes | None) -> dict:
    """What a whole record says; ``block`` is None where segments are missing or do not add up."""
    kind, stated = head[b"warc-type"].decode(), head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    out = {"page_id": _page_of(head.get(b"warc-record-id")), "payload_bytes": None, "payload_digest": None, "record_type": kind, "refers_to": _page_of(head.get(b"warc-refers-to")), "intact": False}
    try:
        http, body = (block or b"").split(b"\r\n\r\n", 1)
        fields = {k.lower(): v for k, v in _HEAD.findall(http + CRLF, http.index(CRLF) + 2)}
        if kind == "revisit":
            out |= {"payload_bytes": int(fields[b"content-length"]), "payload_digest": stated, "intact": True}
        else:
            payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
            digest = base32_sha1(payload)
            if digest == stated:
                out |= {"payload_bytes": len(payload), "payload_digest": digest, "intact": True}
    except (ValueError, KeyError):
        pass
    return out


def join_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of (number, total length or None, bytes), or None if a segment is missing or the length differs."""
    segments = sorted(segments, key=lambda s: s[0])
    totals = [t for _, t, _ in segments if t is not None]
    block = b"".join(b for _, _, b in segments)
    whole = [n for n, _, _ in segments] == list(range(1, len(segments) + 1)) and totals == [len(block)]
    return block if whole else None


PARTS = FIELDS + ", origin string, number int, total long, head binary, content binary"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
_ARROW_PARTS = pa.schema([*_ARROW, ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.binary()), ("content", pa.binary())])


def read_archives(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """A row for each page record in the archives below ``path``: plain or gzip files of up to 2 GB (what one row of Spark's reader holds)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_pieces(inflated(raw.as_py())):
                    number, kind = head.get(b"warc-segment-number"), head.get(b"warc-type")
                    if kind not in (*PAGES, b"continuation"):
                        continue
                    if len(rows) >= 1024 or size > 8 << 20:
                        yield _batch(rows, _ARROW_PARTS)
                        rows, size = [], 0
                    if number is None:
                        rows.append(judge(head, block))
                        continue
                    size += len(block)
                    total, origin = head.get(b"warc-segment-total-length"), head.get(b"warc-segment-origin-id", head[b"warc-record-id"])
                    lines = b"".join(b"%b: %b\r\n" % item for item in head.items())
                    rows.append({"origin": origin.decode(), "number": int(number), "total": total and int(total), "head": lines, "content": block})
                yield _batch(rows, _ARROW_PARTS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, origin, first = [], None, None

        def close() -> list[dict]:
            if not held:
                return []
            if first is None:  # continuations whose origin is missing
                return [{"page_id": _page_of(origin.encode()), "record_type": "response", "intact": False}]
            return [judge(first, join_segments(held))] if first.get(b"warc-type") in PAGES else []

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["origin"] != origin:
                    rows += close()
                    held, origin, first = [], row["origin"], None
                held.append((row["number"], row["total"], row["content"]))
                if row["number"] == 1:
                    first = {k.lower(): v for k, v in _HEAD.findall(row["head"])}
            if rows:
                yield _batch(rows, _ARROW)
        if held:
            yield _batch(close(), _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    parts = scratch.save(files.mapInArrow(split, PARTS), "parts")
    whole = parts.where("origin is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    segments = parts.where("origin is not null").select("origin", "number", "total", "head", "content")
    return whole.unionByName(segments.repartition("origin").sortWithinPartitions("origin", "number").mapInArrow(joined, FIELDS))


def round_trip(pages: DataFrame, least: int = 0, segment: int = 32 << 10) -> DataFrame:
    """Write the archives of the pages to the shared folder and read them back."""
    scratch = Scratch(pages.sparkSession, "warc")
    path = scratch.path("archives")
    write_archives(pages, path, least, segment)
    return read_archives(pages.sparkSession, path, scratch)
