"""WARC archives: records written by tasks, large ones as segments, and read back by putting segments together.

Every page is an HTTP response record, compressed by itself; larger payloads use chunked transfer framing, and a block
longer than ``segment_bytes`` goes on in continuation records that name the first record, their number and, in the
last, the total length. A payload seen before is a revisit record without the payload. The reader emits single records
at once and groups only segments: by origin, ordered by number, checked against the total length, then unframed.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.llm.common import slices, written
from placelore.llm.tokenfiles import mounted

DATE = "2024-01-01T00:00:00Z"  # archives of one table are equal however often they are written
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean, "
          "origin string, number int, total long, block binary, path string, at long")


def record_id(page_id: int | None, digest: str, again: str = "") -> str:
    """The id of a page's record: page, payload digest and, where a task writes both once more, a number."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest}{again}>"


def page_of(urn: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)[:>]", urn or "")
    return int(found[1]) if found else None


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def framed(payload: bytes, chunk: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i:i + chunk] for i in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """The payload under chunked transfer framing; raises ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def http_block(payload: bytes, chunk: int) -> bytes:
    if len(payload) > chunk:
        return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload, chunk)
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unframed(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def one_line(text: str | None) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", " ", text or "")


def kinds(pages: DataFrame, least: int) -> DataFrame:
    """page_id, digest and, for a payload of at least ``least`` bytes, the smallest page_id that has it."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long"), F.octet_length(html).alias("bytes"), F.sha2(html.cast("binary"), 256).alias("digest"))
    large = keyed.filter(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    return large.join(first, "digest").filter("page_id is null or page_id <> first").select("page_id", "digest", "first").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 100, segment_bytes: int = 65_536, chunk: int = 16_384) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; null html is empty); returns the list of files (path, n).

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is a response and the others revisit
    it. Rows that repeat that page_id and payload are responses as well. Null page_ids come after all others.
    """
    folder = mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        names: set[str] = set()
        path, n = os.path.join(folder, f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"), 0
        with open(f"{path}.part", "wb") as out:
            for batch in slices(batches, "html"):
                for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                    n += 1
                    digest = hashlib.sha256(html).hexdigest()
                    name = record_id(page, digest)
                    if name in names:  # a repeated row
                        name = record_id(page, digest, f":{TaskContext.get().partitionId()}.{n}")
                    names.add(name)
                    common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
                              ("Content-Type", "application/http;msgtype=response")]
                    if first is not None:
                        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
                        out.write(record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))], block))
                        continue
                    block = http_block(html, chunk)
                    if len(block) <= segment_bytes:
                        out.write(record([("WARC-Type", "response"), *common], block))
                        continue
                    out.write(record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", "1")], block[:segment_bytes]))
                    for number, lo in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
                        total = [("WARC-Segment-Total-Length", str(len(block)))] if lo + segment_bytes >= len(block) else []
                        out.write(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{number}')}>"), ("WARC-Date", DATE),
                                          ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number)), *total], block[lo:lo + segment_bytes]))
        if not n:
            os.remove(f"{path}.part")
            return
        os.replace(f"{path}.part", path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    seen = kinds(pages, least)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.cast("binary").alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    same = rows["page_id"].eqNullSafe(seen["page_id"]) & (rows["digest"] == seen["digest"])
    typed = rows.join(seen, same, "left").select(rows["page_id"], "url", "html", "first")
    return written(typed.mapInArrow(write, "path string, n long"), "archives")


def read_fields(stream) -> dict[str, str] | None:
    """Header fields of the next record, names in lower case; None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins at {line[:40]!r}")
    fields = {}
    for line in iter(stream.readline, b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def read_archives(files: DataFrame) -> DataFrame:
    """Records of all files, see RECORD: whole ones decoded, of segments the block with its origin, number and total."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for path in (p for b in batches for p in b.column("path").to_pylist()):
            rows, held, at = [], 0, 0
            with gzip.open(path, "rb") as stream:
                while (f := read_fields(stream)) is not None:
                    block = stream.read(int(f["content-length"]))
                    at += 1
                    number, kind = f.get("warc-segment-number"), f.get("warc-type")
                    if number:
                        origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                        rows.append((page_of(origin), None, None, None, f.get("warc-payload-digest", "").rpartition(":")[2] or None, None, origin, int(number),
                                     int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block, path, at))
                        held += len(block)
                    elif kind == "revisit":
                        size = re.search(rb"\r\ncontent-length: *(\d+)", block.lower())
                        rows.append((page_of(f["warc-record-id"]), kind, page_of(f.get("warc-refers-to")), int(size[1]), f["warc-payload-digest"].rpartition(":")[2], True,
                                     None, None, None, None, path, at))
                    elif kind == "response":
                        payload = http_payload(block)
                        digest = hashlib.sha256(payload).hexdigest()
                        rows.append((page_of(f["warc-record-id"]), kind, None, len(payload), digest, digest == f["warc-payload-digest"].rpartition(":")[2], None, None, None, None, path, at))
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    n = files.count()
    return files.repartition(max(1, min(n, 10_000)), "path").mapInArrow(read, RECORD)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from segments (origin, number, total, block, path, at; payload_digest where number is 1).

    Segments of an origin are ordered by number; the numbers must run from 1 and the lengths add up to the total, else the
    record is ``broken`` with the bytes that are there. Only rows that repeat page and payload can share an origin; their
    segments are the same bytes, and the record is put together as often.
    """
    copy = F.row_number().over(W.partitionBy("origin", "number").orderBy("path", "at"))
    parts = segments.withColumn("copy", copy).groupBy("origin", "copy").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("page_id").alias("page_id"),
        F.max("payload_digest").alias("declared"), F.sum(F.octet_length("block")).alias("length"))
    numbers = F.transform("parts", lambda p: p["number"])
    good = (numbers == F.sequence(F.lit(1), F.size("parts"))) & F.coalesce(F.col("total") == F.col("length"), F.lit(False))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["block"]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "block"):
            rows = []
            for page, block, whole, declared in zip(*(batch.column(c).to_pylist() for c in ("page_id", "block", "whole", "declared"))):
                try:
                    payload = http_payload(block)
                except ValueError:
                    payload, whole = block, False
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((page, "response" if whole else "broken", None, len(payload), digest, whole and digest == declared))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                                             names=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "verified"])

    ready = parts.select("page_id", joined.alias("block"), good.alias("whole"), "declared")
    return ready.mapInArrow(decode, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean")


def read_pages(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and verified of every archived page."""
    records = written(read_archives(files), "records")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    return records.filter("number is null").select(columns).unionByName(reassembled(records.filter("number is not null")).select(columns))
