"""WARC archives: a record per page, repeated payloads as revisits, and a salvage reader.

Writing goes through Spark's text writer, so archives land in any file system that Spark can write,
under its commit protocol: each record is a gzip member, and the line separator is an empty member,
which every gzip reader passes over. Reading takes whole archives from Spark's binary source.

The reader checks every member (gzip checksum, version line, Content-Length, payload digest). After
a failed check it searches for the next gzip header or version line that starts a valid record,
goes on from there, and logs the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loamcast.llm.common import longs, new_path, stage, texts_of

VERSION = b"WARC/1.1\r\n"
_MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
#: Records of one archive at most, and bytes of its members (compressed; one may go beyond), which bounds what a
#: reading task holds.
RECORDS, ARCHIVE = 4096, 128 << 20
#: Pieces that the rows of one payload are dealt into, so that a frequent one, as the empty, is no one task's.
SALT = 16
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed. A revisit has no block; its headers keep the full payload's length."""
    head = [b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _uri(page_id), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace")))
    head += [b"WARC-Payload-Digest: sha1:" + digest(payload).encode(), b"X-Payload-Length: %d" % len(payload)]
    if revisit:
        head += [b"WARC-Refers-To: " + _uri(refers_to), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = b"" if revisit else payload
    head += [b"Content-Type: text/html", b"Content-Length: %d" % len(block)]
    return VERSION + b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that starts at `at` and its end, or None where any check fails."""
    if data[at : at + 7] != b"WARC/1." or data[at + 8 : at + 10] != b"\r\n":
        return None
    split = data.find(b"\r\n\r\n", at)
    if split < 0:
        return None
    head = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip()
    length = head.get(b"content-length", b"")
    if not length.isdigit():
        return None
    begin, end = split + 4, split + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    told = head.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    kind = head.get(b"warc-type", b"").decode("ascii", "replace")
    if kind == "response" and told and told != digest(block):
        return None
    number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:x-page:(-?\d+)>", x)) else None
    size = head.get(b"x-payload-length", length)
    out = {
        "page_id": number(head.get(b"warc-record-id", b"")), "record_type": kind, "payload_digest": told or digest(block), "payload_bytes": int(size) if size.isdigit() else len(block),
        "refers_to": number(head.get(b"warc-refers-to", b"")), "url": head.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None, "payload": block,
    }
    return out, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member that starts at `at` inflates to, and its end; of a damaged or torn one what comes
    before the damage, and None.

    It is fed piece by piece, so that a member's cost doesn't depend on what follows it.
    """
    d, parts, size, view = zlib.decompressobj(wbits=31), [], 1 << 16, memoryview(data)
    to = at
    while not d.eof and to < len(data):
        before = d.copy()
        try:
            parts.append(d.decompress(view[to : to + size]))
        except zlib.error:
            if size == 1:
                break
            # Bytes before the damage may still give something.
            d, size = before, max(1, size // 64)
            continue
        to = min(len(data), to + size)
        size = size * 2 if size >= 1 << 16 else size
    return b"".join(parts), to - len(d.unused_data) if d.eof else None


def _inner(plain: bytes) -> tuple[list[dict], bool]:
    """The valid records of a member's bytes, searched for by version lines, and whether all its bytes are theirs."""
    out, pos, whole = [], 0, True
    while pos < len(plain):
        if r := _parse(plain, pos):
            out.append(r[0])
            pos = r[1]
        else:
            whole, pos = False, plain.find(b"WARC/1.", pos + 1)
            if pos < 0:
                break
    return out, whole


def salvage(data: bytes) -> Iterator[tuple[str, object]]:
    """Yield ("record", dict) for each valid record and ("gap", (start, end)) for quarantined bytes.

    Takes plain and gzip archives, mixed too. Empty members and stray line ends between records
    are no gaps. A member that holds other bytes beside valid records is a gap itself, as its bad range
    has no place of its own in the archive; its records are yielded all the same, and so are the valid
    records before the damage of a member that is torn or fails its checksum. Empty data yields nothing.
    """
    at, bad, n = 0, None, len(data)
    while at < n:
        got = None
        if data.startswith(_MAGIC, at):
            plain, end = _member(data, at)
            inner, whole = _inner(plain)
            if end is None:
                if inner and bad is not None:
                    yield "gap", (bad, at)
                    bad = at
                for x in inner:
                    yield "record", x
            elif inner or whole:
                got = inner, end, whole
        elif data.startswith(b"WARC/1.", at):
            if r := _parse(data, at):
                got = [r[0]], r[1], True
        elif bad is None and data[at : at + 1] in b"\r\n":
            at += 1
            continue
        if got:
            if bad is not None:
                yield "gap", (bad, at)
                bad = None
            for x in got[0]:
                yield "record", x
            if not got[2]:
                yield "gap", (at, got[1])
            at = got[1]
            continue
        if bad is None:
            bad = at
        found = _START.search(data, at + 1)
        at = found.start() if found else n
    if bad is not None:
        yield "gap", (bad, n)


def plan_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with `response_id`: the largest page_id of an equal payload, or null.

    Payloads under `least` bytes are never revisits. Null html counts as an empty payload; a null
    page_id counts as the smallest. Rows that repeat a response's page_id and payload are responses too.
    """
    slim = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    slim = slim.withColumn("__digest", F.unhex(F.sha1("payload"))).withColumn("__size", F.length("payload"))
    # Only payloads that occur more than once are looked up, so the joined side stays small.
    repeated = slim.where(F.col("__size") >= least).groupBy("__digest", "__size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stage(repeated.drop("n"), "repeated-payloads").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = slim.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    return dealt.join(repeated, ["__digest", "__size", "__salt"], "left").select("page_id", "url", "payload", "response_id")


def write(pages: DataFrame, path: str | None = None, least: int = 0, records: int = RECORDS, archive: int = ARCHIVE) -> str:
    """Write the archives and return their folder. Equal payloads of `least` bytes or more are kept once.

    A null html is an empty payload, a null url gives no target header, a null page_id an id of its own.
    Long payloads are one record each; repeated rows, a record each. An empty table gives a folder without
    records. Columns of pages other than these three aren't read.
    """
    path = path or new_path(pages.sparkSession, "warc")
    planned = plan_revisits(pages, least)

    def run(batches):
        size = 0
        for b in batches:
            out, piece = [], []
            for page, url, payload, response in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
                again = response is not None and response != page
                out.append(gzip.compress(record(page, url, payload, response, again), 6, mtime=0))
                piece.append(size // archive)
                size += len(out[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(piece, pa.int32())], names=["member", "piece"])

    members = planned.mapInArrow(run, "member binary, piece int").select(F.col("member").cast("string").alias("value"), "piece")
    members.write.partitionBy("piece").option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records).text(path)
    return path


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The valid records of all archives in a folder; with payloads=False the payload column is null.

    A revisit's payload is null. Records written twice are read twice; an empty folder gives no rows.
    """

    def run(batches):
        for b in batches:
            for data in b.column(1):
                rows: list[dict] = []
                for kind, x in salvage(data.as_py()):
                    if kind == "record":
                        rows.append(x)
                    if len(rows) >= 256:
                        yield _batch(rows, payloads)
                        rows = []
                if rows:
                    yield _batch(rows, payloads)

    return _archives(spark, path).mapInArrow(run, FIELDS)


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined byte ranges (archive, gap_start, gap_end) of all archives in a folder."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [x for kind, x in salvage(data.as_py()) if kind == "gap"]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), longs([x for x, _ in found]), longs([y for _, y in found])], names=["archive", "gap_start", "gap_end"])

    return _archives(spark, path).mapInArrow(run, "archive string, gap_start long, gap_end long")


def _batch(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    body = [r["payload"].decode("utf-8", "replace") if payloads and r["record_type"] == "response" else None for r in rows]
    cols = {
        "page_id": pa.array([r["page_id"] for r in rows], pa.int64()), "payload_bytes": longs([r["payload_bytes"] for r in rows]), "payload_digest": pa.array([r["payload_digest"] for r in rows], pa.string()),
        "record_type": pa.array([r["record_type"] for r in rows], pa.string()), "refers_to": pa.array([r["refers_to"] for r in rows], pa.int64()), "url": pa.array([r["url"] for r in rows], pa.string()), "payload": pa.array(body, pa.string()),
    }
    return pa.RecordBatch.from_pydict(cols)
