"""WARC archives: a writer with payload deduplication, and a splittable reader.

Writing: every record is a gzip member of its own. Spark's text writer puts the members one after
the other, with its commit protocol, into any file system it can reach: a member ends with four
bytes of its length, the last of which is zero below 16 MB, so the member is handed over without
that byte and the writer's line separator, a zero byte, completes it. (A longer record is followed
by an empty member, whose last byte is zero again.) The files are plain concatenated gzip.

Reading: files are cut into byte ranges, a task each. A task looks for the gzip magic in its range,
holds a candidate for real only if it decodes to a WARC header, and then follows the members one by
one. It owns the records that start inside its range, wherever they end.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
#: Bytes read at a time.
BLOCK = 1 << 20
#: Tasks of a reader at most; beyond, a task reads one range after the other.
MOST_TASKS = 20_000
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
#: Fixed value: the profile that a revisit of an identical payload names.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed: a response, or a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member without its last byte, which is zero (see above)."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = c.compress(data) + c.flush()
    return out[:-1] if out[-1] == 0 else out + _EMPTY[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = zip(*(batch.column(i).slice(at, 500).to_pylist() for i in range(4)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r)) for r in rows], pa.binary())], ["member"])


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to)``: refers_to is the response's page_id for revisits, else null.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is
    the response. Rows that repeat that page_id are responses too; a null page_id refers to the
    smallest id, and is a response if there is none. A null html is an empty payload.
    """
    packed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    big = F.length("payload") >= least
    first = packed.where(big).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # payloads that occur once, the bulk as a rule, need no join
    shared = first.where("n > 1").select("digest", "first")
    return packed.join(shared, "digest", "left").select(
        "page_id", "url", "payload", F.when(big & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the pages as WARC files under ``path``, one file a task."""
    members = deduplicated(pages, least).mapInArrow(_members, "member binary")
    # a cast of binary to string keeps the bytes as they are
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(path, start, end)`` of all files under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    step = F.lit(range_bytes).cast("long")
    return files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start")).select(
        "path", "start", F.least(F.col("start") + step, F.col("length")).alias("end")
    )


def opener(path: str) -> Callable[[], object]:
    """How a task opens ``path`` for reading at any place: local files directly, other schemes by pyarrow."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme) or not rest.startswith("/"):
        # "file:" is followed by the path itself, in which '#', '?' and '%' are plain characters
        return open(re.sub(r"^/{2,}", "/", rest) if scheme == "file" else path, "rb")  # noqa: SIM115
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(name)


def _is_record(head: bytes) -> bool:
    """Whether a gzip member that begins like ``head`` decodes to a WARC header."""
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def records_of(source, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records whose gzip member begins in [start, end) of an open file.

    After a member the next one begins; where that is not so (damage, foreign bytes), the magic is
    looked for again. An empty member is passed over. A member that does not decode is skipped.
    """
    at, buffer, origin = start, b"", start  # buffer holds the bytes from origin on
    done = False

    def fill(upto: int) -> None:
        """Have bytes up to ``upto`` in the buffer, as far as the file goes."""
        nonlocal buffer, done
        while not done and origin + len(buffer) < upto:
            source.seek(origin + len(buffer))
            more = source.read(block)
            done = not more
            buffer += more

    while at < end:
        if at - origin > block:
            buffer, origin = buffer[at - origin :], at
        fill(at + 4096)
        if buffer[at - origin : at - origin + 3] != MAGIC or not (
            _is_record(head := buffer[at - origin : at - origin + 4096]) or head.startswith(_EMPTY)
        ):
            found = buffer.find(MAGIC, at - origin + 1)
            while found < 0 and not done and origin + len(buffer) < end + 2:
                keep = max(at - origin + 1, len(buffer) - 2)
                buffer, origin = buffer[keep:], origin + keep
                fill(origin + len(buffer) + block)
                found = buffer.find(MAGIC)
            if found < 0:
                return
            at = origin + found
            continue
        codec, out, pos = zlib.decompressobj(31), [], at
        try:
            while not codec.eof:
                fill(pos + block)
                piece = buffer[pos - origin :]
                if not piece:
                    break
                out.append(codec.decompress(piece))
                pos += len(piece) - len(codec.unused_data)
                if not codec.eof:
                    buffer, origin = b"", pos
        except zlib.error:
            codec = None
        if codec is None or not codec.eof:
            at += 1
            buffer, origin, done = b"", at, False
            continue
        data = b"".join(out)
        if data:
            yield at, data
        at = pos


def parse(data: bytes) -> dict:
    """Header fields (lower-case names), HTTP header fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    fields = named(head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields.get("content-length", 0))].partition(b"\r\n\r\n")
    return {"warc": fields, "http": named(http.decode("latin-1").split("\r\n")[1:]), "payload": payload}


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "file", "offset"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with opener(path) as source:
                rows, held = [], 0
                for offset, data in records_of(source, start, end):
                    r = parse(data)
                    fields, response = r["warc"], r["warc"].get("warc-type") == "response"
                    payload = r["payload"] if response else None
                    size = len(payload) if response else int(r["http"].get("content-length", 0))
                    digest = base32_sha1(payload) if response else fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append(
                        (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"),
                         _page(fields.get("warc-refers-to")), payload, size, digest, path, offset)
                    )
                    held += len(data)
                    if held > BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records under ``path``: ids, types, payloads (null for revisits), sizes and digests of the full payload.

    Digest and size of a response are computed from the payload read; a revisit's are those its
    headers give.
    """
    ranges = byte_ranges(spark, path, range_bytes)
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, "
        "payload_digest string, file string, offset long"
    )
    return ranges.repartition(min(max(1, ranges.count()), MOST_TASKS)).mapInArrow(_read, schema)


def round_trip(pages: DataFrame, least: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into the shared folder and read them back: a row per page.

    An empty table gives an empty result.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, least)
    back = read(pages.sparkSession, path, range_bytes)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    """The records that the archives must hold, as DuckDB SQL; five bits of the digest make a base32 letter."""
    five = "((('0x' || substr(digest, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT"
    return f"""
WITH payloads AS (SELECT page_id::BIGINT AS page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS digest FROM payloads),
named AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS response FROM digests)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five} + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM named"""
