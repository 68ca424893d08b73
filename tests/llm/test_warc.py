"""Web archives: exact round trips, the gzip layout as plain Python reads it, and broken archives."""

import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rowmill.llm import warc
from rowmill.session import scratch_dir

LONG = "same page " * 20
ROWS = [
    (1, "https://a.b/1", LONG), (5, "https://a.b/5", LONG), (3, "https://a.b/3\r\nWARC-Type: evil", LONG), (1, "https://a.b/1", LONG),
    (7, None, LONG[:99]), (8, "u", LONG[:99]), (9, "u", LONG[:100]), (10, "u", LONG[:100]), (None, "u", LONG[:100]),
    (11, "u", None), (12, "u", ""), (13, "", "é" * 50), (14, "日", "é" * 50), (15, "u", "WARC/1.1\r\n\r\n" * 30), (16, "u", "\x00" * 300),
    (17, "u", "long " * 200_000), (18, "u", "long " * 200_000), (None, None, "only without id" * 10), (None, None, "only without id" * 10),
]


def frame(llm, rows):
    full = [(*r, "x", 1, "y", 2) for r in rows]
    return llm.createDataFrame(full, "page_id bigint, url string, html string, digest string, first int, payload string, Size int").repartition(3)


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        first = min(ids) if ids and len(payload) >= 100 and page != min(ids) else None
        kind = "response" if first is None else "revisit"
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, first, True))
    return sorted(out, key=repr)


def test_pages_come_back(llm):
    found = warc.page_records(frame(llm, ROWS))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(ROWS)
    assert warc.page_records(frame(llm, ROWS).where("false")).count() == 0


@pytest.fixture(scope="module")
def archives(llm):
    path = scratch_dir(llm, "test-warc")
    warc.write(frame(llm, ROWS), path, archive_bytes=1 << 20)
    return path


def test_files_are_whole_gzip_members(llm, archives):
    """Python's own gzip reads every file, and each member is one record."""
    members = 0
    for r in llm.read.format("binaryFile").load(archives).collect():
        data = bytes(r["content"])
        text = gzip.decompress(data)
        assert text == b"" or text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        while data:
            inflater = zlib.decompressobj(31)
            assert inflater.decompress(data).startswith(b"WARC/1.1\r\n") and inflater.eof
            data, members = inflater.unused_data, members + 1
    assert members == len(ROWS)


def test_payloads_and_headers(llm, archives):
    records = warc.read(llm, archives)
    assert records.where("problem IS NOT NULL").count() == 0 and warc.unresolved(records).count() == 0
    got = sorted(bytes(r["payload"]) for r in records.where("record_type = 'response'").collect())
    kept = [html for (_, _, html), (kind) in zip(ROWS, kinds_of(ROWS), strict=True) if kind == "response"]
    assert got == sorted((h or "").encode() for h in kept)
    uris = {r["target_uri"] for r in records.collect()}
    assert "https://a.b/3%0D%0AWARC-Type:%20evil" in uris and None in uris
    assert records.select("archive", "position").distinct().count() == len(ROWS)


def kinds_of(rows):
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        yield "revisit" if ids and len(payload) >= 100 and page != min(ids) else "response"


def test_hot_payload_spreads_and_matches(llm):
    """A payload in most rows, with joins forced off the broadcast path."""
    rows = [(i, "u", LONG if i % 4 else f"page {i} " * 30) for i in range(400)]
    path = scratch_dir(llm, "test-warc")
    warc.write(frame(llm, rows), path, archive_bytes=1 << 14, frequent=2)
    found = warc.read(llm, path)
    assert found.where("record_type = 'revisit'").count() == 299 and warc.unresolved(found).count() == 0
    sizes = [r["n"] for r in found.groupBy("archive").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 6 and max(sizes) < 150


def read_bytes(data, step):
    reader, out = warc.MemberReader("a"), []
    for at in range(0, len(data), step):
        out += reader.feed(data[at : at + step])
    return out + list(reader.finish())


@pytest.mark.parametrize("step", [1, 7, 100, 1 << 20])
def test_broken_archives(step):
    def member(i, payload=b"text"):
        return warc.build_record(str(i), "u", payload, hashlib.sha256(payload).hexdigest(), None, "d")

    good, other = member(1), member(2)
    assert [(r["record_id"], r["problem"], r["payload"]) for r in read_bytes(good + other, step)] == [
        ("<urn:row:1>", None, b"text"), ("<urn:row:2>", None, b"text")
    ]
    assert [r["position"] for r in read_bytes(good + b"\0\0" + warc.EMPTY_MEMBER + other, step)] == [0, len(good) + 2 + len(warc.EMPTY_MEMBER)]
    cut = read_bytes(good + other[:-5], step)
    assert [r["problem"] for r in cut] == [None, "archive ends inside a member"]
    broken = bytearray(good)
    broken[40] ^= 0xFF
    assert [r["problem"] is None for r in read_bytes(bytes(broken) + other, step)][-1] is True
    assert any(r["problem"] for r in read_bytes(bytes(broken) + other, step))
    assert read_bytes(b"no archive at all", step)[0]["problem"] == "not a gzip member"
    changed = gzip.compress(gzip.decompress(good).replace(b"text\r\n", b"TEXT\r\n"))
    assert [r["problem"] for r in read_bytes(changed, step)] == ["block digest differs"]
    short = gzip.compress(gzip.decompress(good)[:-6])
    assert [r["problem"] for r in read_bytes(short, step)] == ["content length does not frame the block"]
    assert [r["problem"] for r in read_bytes(gzip.compress(b"hello"), step)] == ["no record header"]
    assert [r["problem"] for r in read_bytes(gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n"), step)] == ["no content length"]


def test_foreign_records():
    """Several records in a member, folded lines, SHA-1 in base 32, and a record without HTTP."""
    sha1 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"abc").digest()).decode()
    one = f"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID:\r\n  <urn:x>\r\nWARC-Payload-Digest: {sha1}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = read_bytes(gzip.compress((one + one.replace("abc", "abd")).encode()), 50)
    assert [(r["record_type"], r["record_id"], r["payload"], r["problem"]) for r in found] == [
        ("resource", "<urn:x>", b"abc", None), ("resource", "<urn:x>", b"abd", "payload digest differs")
    ]


def test_giant_member(llm):
    """From 16 MiB of content on the last byte of a member is not zero; the file stays a sequence of members."""
    path = scratch_dir(llm, "test-warc")
    warc.write(frame(llm, [(1, "u", "x" * (17 << 20)), (2, "u", "small")]), path)
    got = warc.read(llm, path).collect()
    assert sorted(r["payload_bytes"] for r in got) == [5, 17 << 20] and all(r["problem"] is None for r in got)
