"""WARC archives: written with segmented records and chunked transfer framing,
and read back by segment reassembly.

Writing.  Every record is an HTTP response whose body is framed in chunks.  A
record longer than ``segment_bytes`` becomes a first segment and continuation
records, which carry the origin's record id, a segment number and, on the last
one, the total length.  Of records with equal payloads one is the response; the
others become revisit records that refer to it and hold HTTP headers only.
Tasks pack records into pieces of a few megabytes, and Spark's text writer
writes the pieces to gzip files of a few pieces each: its line separator is the
end of a WARC record, so every file is a WARC file whatever the file system.

Reading.  Files arrive as binary rows and are parsed by Content-Length.  Records
in one piece are decoded where they were read.  Continuation records, and no
others, are shuffled: they are grouped by origin, equal segments are collapsed,
ordered by number, checked against the total length, and decoded as one block.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import urllib.parse
import uuid
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

SEGMENT_BYTES = 16 << 10    # longest block of a record in one piece
CHUNK_BYTES = 4 << 10       # longest chunk of the transfer framing
PIECE_BYTES = 4 << 20       # a piece is written once it is this long
PIECES_IN_FILE = 16
SALTS = 32                  # parts of the records with one payload where they meet the response's id
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- writing ---------------------------------------------------------------------------------------------------
def framed(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for at in range(0, len(payload), chunk_bytes):
        part = payload[at:at + chunk_bytes]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def record(kind: str, record_id: str, date: str, block: bytes, fields: dict) -> bytes:
    """One WARC record without the two line ends behind it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
             *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def records_of(record_id: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, date: str,
               segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response in segments."""
    target = None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
    fields = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}"}
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{refers_to}>",
                   "Content-Type": "application/http; msgtype=response"}
        return [record("revisit", record_id, date, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode(), fields)]
    fields["Content-Type"] = "application/http; msgtype=response"
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + framed(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record("response", record_id, date, block, fields)]
    out = []
    for number, at in enumerate(range(0, len(block), segment_bytes), 1):
        own = {"WARC-Segment-Number": number}
        if number > 1:
            own = {"WARC-Segment-Number": number, "WARC-Segment-Origin-ID": f"<{record_id}>"}
        if at + segment_bytes >= len(block):
            own["WARC-Segment-Total-Length"] = len(block)
        out.append(record("continuation" if number > 1 else "response", record_id if number == 1 else f"{record_id}:{number}",
                          date, block[at:at + segment_bytes], {**(fields if number == 1 else {}), **own}))
    return out


def _keyed(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    page, url = F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("string")
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    named = pages.select(page.alias("page"), url.alias("url"), payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload")))
    text = F.coalesce(F.url_encode(F.col("page").cast("string")), F.lit(""))
    mark = F.md5(F.concat(text, F.lit("\n"), F.coalesce(F.concat(F.lit("="), F.col("url")), F.lit("")), F.lit("\n"),
                          F.hex("digest")))
    return named.withColumn("record_id", F.concat(F.lit("urn:page:"), text, F.lit(":"), mark))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
          least_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write one record for each row of ``pages`` to WARC files in ``folder``.

    The payload is the column's UTF-8 (or its bytes); null is empty.  Of rows
    with equal payloads of at least ``least_revisit_bytes`` bytes the one with
    the largest id is the response (a null id is less than any; equal ids: by
    the record id; rows equal in id, URL and payload are responses together),
    the others revisit it.  Control characters, spaces and non-ASCII letters of a
    URL are percent-encoded; a null URL is left out.  An empty table gives no
    records."""
    keyed = _keyed(pages, id_col, url_col, payload_col)
    narrow = keyed.filter(F.length("payload") >= least_revisit_bytes).select("record_id", "page", "digest")
    best = F.max(F.struct("page", "record_id"))
    heads = (narrow.groupBy("digest").agg(best.alias("head"), F.min(F.struct("page", "record_id")).alias("other"))
             .filter("head.record_id <> other.record_id")
             .select("digest", F.col("head.record_id").alias("refers_to"),
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    salted = narrow.select("record_id", "digest", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int").alias("salt"))
    revisits = (salted.join(heads, ["digest", "salt"]).filter("record_id <> refers_to")
                .groupBy("record_id").agg(F.max("refers_to").alias("refers_to")))
    rows = keyed.join(revisits, "record_id", "left").select("record_id", "url", "payload", "digest", "refers_to")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    run_id = uuid.uuid4().hex

    def pieces(batches):
        held, size, made = [], 0, 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])

        for batch in batches:
            for part in slices([batch], 64):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    if not held:
                        info = b"software: skillscope\r\nformat: WARC File Format 1.1\r\n"
                        held.append(record("warcinfo", f"urn:info:{run_id}:{uuid.uuid4().hex}", date, info,
                                           {"Content-Type": "application/warc-fields"}))
                    new = records_of(*row, date, segment_bytes, chunk_bytes)
                    for one in new:
                        held.append(one)
                        size += len(one)
                        if size >= PIECE_BYTES:
                            yield piece()
                            held, size, made = [], 0, made + 1
        if held:
            yield piece()

    (rows.mapInArrow(pieces, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", PIECES_IN_FILE).text(folder))


# ---- reading ---------------------------------------------------------------------------------------------------
def parsed(archive: bytes):
    """(fields with lower-case names, block, whether the block has its stated length) of each record of a WARC
    file, compressed or not.  Lines that begin no record are passed over."""
    raw = io.BytesIO(archive)
    source = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if archive[:2] == b"\x1f\x8b" else raw
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length") or 0)
        block = source.read(length)
        yield fields, block, len(block) == length


def decoded(block: bytes) -> tuple[dict, bytes, bool]:
    """(HTTP fields with lower-case names, body with its transfer framing undone, whether the framing is whole)."""
    head, _, body = block.partition(END)
    http = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        http[name.strip().lower()] = value.strip()
    if http.get("transfer-encoding", "").lower() != "chunked":
        return http, body, True
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size <= 0:
            return http, b"".join(parts), size == 0
        parts.append(body[end + 2:end + 2 + size])
        at = end + 2 + size
        if len(parts[-1]) < size or body[at:at + 2] != b"\r\n":
            return http, b"".join(parts), False
        at += 2


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value is not None else None


def _result(record_id, kind, url, refers_to, stated, block, whole, segments, with_payload) -> tuple:
    http, payload, framing = decoded(block)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    size = len(payload)
    if kind == "revisit":
        digest, size, payload = stated, int(http["content-length"]) if http.get("content-length", "").isdigit() else None, None
    return (record_id, kind, url, refers_to, payload if with_payload else None, size, digest, segments,
            whole and framing and (stated is None or stated == digest))


RESULT = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                    ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("n_segments", pa.int32()), ("verified", pa.bool_())])
RESULT_TYPE = ("record_id string, record_type string, target_uri string, refers_to string, payload binary, "
               "payload_bytes bigint, payload_digest string, n_segments int, verified boolean")
PART = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("block", pa.binary()), ("total", pa.int64()),
                  ("url", pa.string()), ("digest", pa.string()), ("whole", pa.bool_())])
PART_TYPE = ("origin string, number bigint, block binary, total bigint, url string, digest string, whole boolean")


def _batches(rows, schema: pa.Schema, payload_at: int):
    """Record batches of at most 1,024 rows or about 8 MB."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[payload_at] or b"")
        if len(held) == 1024 or size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _stated(fields: dict) -> str | None:
    return (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row for each response and revisit record of the WARC files in
    ``folder``: record_id, record_type, target_uri, refers_to (record id),
    payload (null for revisits, and without ``with_payload``), payload_bytes,
    payload_digest, n_segments, and ``verified``: the block has its stated
    length, segments are complete and add up to the total, the framing is whole
    and the digest is the stated one.

    Records that occur more than once (with all their segments) give as many
    rows.  A segmented record whose first segment is missing has no row type of
    its own: it is a ``response`` that is not verified.  An empty folder gives no
    rows."""
    archives = spark.read.format("binaryFile").load(folder).select("content")

    def in_one_piece(batches):
        def rows():
            for batch in slices(batches, 1):
                for fields, block, whole in parsed(batch.column(0)[0].as_py()):
                    kind = fields.get("warc-type")
                    if kind in ("response", "revisit") and "warc-segment-number" not in fields:
                        yield _result(_bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"),
                                      _bare(fields.get("warc-refers-to")), _stated(fields), block, whole, 1, with_payload)
        yield from _batches(rows(), RESULT, 4)

    def segments(batches):
        def rows():
            for batch in slices(batches, 1):
                for fields, block, whole in parsed(batch.column(0)[0].as_py()):
                    number = fields.get("warc-segment-number")
                    if number is not None:
                        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                        total = fields.get("warc-segment-total-length")
                        yield (_bare(origin), int(number), block, total and int(total), fields.get("warc-target-uri"),
                               _stated(fields), whole)
        yield from _batches(rows(), PART, 2)

    parts = archives.mapInArrow(segments, PART_TYPE)
    equal = parts.groupBy("origin", "number").agg(
        F.count(F.lit(1)).alias("copies"), F.max("block").alias("block"), F.max("total").alias("total"),
        F.max("url").alias("url"), F.max("digest").alias("digest"),
        (F.min("whole") & (F.min(F.xxhash64("block")) == F.max(F.xxhash64("block")))).alias("whole"))
    grouped = equal.groupBy("origin").agg(
        F.min("copies").alias("copies"), (F.min("copies") == F.max("copies")).alias("even"), F.min("whole").alias("whole"),
        F.max("total").alias("total"), F.max("url").alias("url"), F.max("digest").alias("digest"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"))

    def reassembled(batches):
        def rows():
            for batch in slices(batches, 1):
                r = batch.to_pylist()[0]
                block = b"".join(p["block"] for p in r["parts"])
                whole = (r["even"] and r["whole"] and r["total"] == len(block)
                         and [p["number"] for p in r["parts"]] == list(range(1, len(r["parts"]) + 1)))
                for _ in range(r["copies"]):
                    yield _result(r["origin"], "response", r["url"], None, r["digest"], block, whole, len(r["parts"]),
                                  with_payload)
        yield from _batches(rows(), RESULT, 4)

    return archives.mapInArrow(in_one_piece, RESULT_TYPE).unionByName(grouped.mapInArrow(reassembled, RESULT_TYPE))


def page_of(record_id: Column) -> Column:
    """The page id (a string; null for none) inside a record id made by :func:`write`."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^urn:page:([^:]*):[0-9a-f]{32}$", 1), F.lit("")))
