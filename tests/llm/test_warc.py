import gzip
import hashlib
import os

import pytest

from placelore.llm import warc
from placelore.llm.common import scratch
from placelore.llm.tokenfiles import mounted

SCHEMA = "page_id long, url string, html string, record_type string"


def plain(rows, least=100):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= least and p is not None:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        lead = first.get(b, p)
        out.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "response" if lead == p else "revisit", None if lead == p else lead))
    return sorted(out, key=str)


ROWS = [(5, "u5", "x" * 200), (2, "u2", "x" * 200), (9, None, "x" * 200), (1, "u\r\n1", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 3000), (8, "u", "é" * 3000), (10, "u", "ab\r\n\r\n0\r\n\r\n" * 900),
        (2, "u2", "x" * 200), (7, "u", "é" * 3000), (None, "u", "y" * 500), (None, "u", "x" * 200), (11, "u", "z" * 99), (12, "u", "z" * 99), (13, "u", "z" * 100), (14, "u", "z" * 100)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA).repartition(3)
    files = warc.write_archives(pages, scratch(spark, "warc"), segment_bytes=700, chunk=256)
    raw = b"".join(gzip.open(r.path).read() for r in files.collect())
    assert raw.count(b"WARC-Type: continuation") > 10 and raw.count(b"WARC-Type: revisit") == 5 and b"Transfer-Encoding: chunked" in raw
    got = warc.read_pages(files).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(ROWS)
    assert all(r.verified for r in got)


def test_long_payloads_under_one_id(spark):
    """Payloads of several segments stay apart though they share a page_id, or have none, over one file and over several."""
    long = ["a" * 70_000, "b" * 300_000, "c" * 65_000 + "é" * 9, "short " * 30]
    rows = [(p, "u", h) for p in (7, 7, None) for h in long] + [(None, "u", long[1]), (8, "u", long[0])]
    for parts in (1, 4):
        pages = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(parts)
        got = warc.read_pages(warc.write_archives(pages, scratch(spark, "warc"))).collect()
        assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows)
        assert all(r.verified for r in got)


def test_empty_table(spark):
    assert warc.read_pages(warc.write_archives(spark.createDataFrame([], SCHEMA), scratch(spark, "warc"))).collect() == []


def test_segments_of_several_files_and_broken_ones(spark):
    folder = mounted(scratch(spark, "warc"))
    os.makedirs(folder)
    block = warc.http_block(b"payload " * 100, 64)
    parts = [block[i:i + 300] for i in range(0, len(block), 300)]
    digest = hashlib.sha256(b"payload " * 100).hexdigest()

    def segments(page, skip=None, total=None):
        name = warc.record_id(page, digest)
        out = []
        for n, part in enumerate(parts, 1):
            head = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Payload-Digest", f"sha256:{digest}")] if n == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<c{page}{n}>"), ("WARC-Segment-Origin-ID", name)]
            last = [("WARC-Segment-Total-Length", str(total or len(block)))] if n == len(parts) else []
            if n != skip:
                out.append(warc.record([*head, ("WARC-Segment-Number", str(n)), *last], part))
        return out

    good, gap, wrong, headless = segments(1), segments(2, skip=2), segments(3, total=5), segments(4, skip=1)
    for i in range(2):  # segments in reverse order over two files
        with open(f"{folder}/{i}.warc.gz", "wb") as f:
            f.write(b"".join([*good[::-1][i::2], *gap[i::2], *wrong[i::2], *headless[i::2]]))
    files = spark.createDataFrame([(f"{folder}/{i}.warc.gz", 1) for i in range(2)], "path string, n long")
    got = {r.page_id: (r.record_type, r.payload_bytes if r.page_id == 1 else None, r.verified) for r in warc.read_pages(files).collect()}
    assert got == {1: ("response", 800, True), 2: ("broken", None, False), 3: ("broken", None, False), 4: ("broken", None, False)}


def test_framing():
    for payload in (b"", b"a", b"x" * 1000, b"0\r\n\r\n"):
        assert warc.unframed(warc.framed(payload, 7)) == payload
    assert warc.unframed(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for broken in (b"3\r\nab\r\n0\r\n\r\n", b"zz\r\n", b"5\r\nab", b""):
        with pytest.raises(ValueError):
            warc.unframed(broken)
