"""Archives: exact round trip, frames on their own, revisits, odd rows."""

import hashlib
import io
import struct

import pytest
import zstandard

from conftest import SMALL

from sparrowtext.llm import warc_zstd as wz

SCHEMA = "page_id long, url string, html string"


def test_records_round_trip():
    for payload in (b"", b"x", b"\r\n\r\n" * 3, "é<p>".encode() * 1000):
        digest = hashlib.sha1(payload).hexdigest()
        head, got = wz.parse_record(wz.record_bytes(7, "http://a.b/ü x\r\nEvil: 1", payload, digest))
        assert got == payload and head["warc-type"] == "response" and head["x-page-id"] == "7" and "evil" not in head
        head, got = wz.parse_record(wz.record_bytes(7, None, payload, digest, refers_to=9))
        assert got == b"" and head["warc-type"] == "revisit" and head["x-refers-to-page-id"] == "9" and head["warc-refers-to"] == wz.record_urn(9, digest)
    with pytest.raises(ValueError):
        wz.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")


def test_each_record_is_a_frame_of_its_own():
    records = [wz.record_bytes(i, f"http://h/{i}", b"<p>same words here</p>" * 30 + str(i).encode(), "00" * 20) for i in range(300)]
    dictionary = wz.train(records, 4096)
    out = io.BytesIO()
    places = list(wz.write_archive(out, iter(records), dictionary))
    data = out.getvalue()
    magic, n = struct.unpack("<II", data[:8])
    assert 0x184D2A50 <= magic <= 0x184D2A5F and data[8 : 8 + n] == dictionary
    assert places[0][0] == 8 + n and places[-1][0] + places[-1][1] == len(data)
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    for r, (at, size) in zip(records, places, strict=True):
        assert zstandard.ZstdDecompressor(dict_data=shared).decompress(data[at : at + size]) == r
    assert sum(s for _, s in places) < sum(len(zstandard.ZstdCompressor(3).compress(r)) for r in records)
    assert [wz.parse_record(r) for r in records] == list(wz.read_archive(io.BytesIO(data)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(wz.read_archive(io.BytesIO(data[:-3])))


def test_a_dictionary_of_few_samples():
    assert wz.train([], 100) and wz.train([b"ab"], 100)


def check(rows, got):
    by = {}
    for i, _, html in rows:
        p = (html or "").encode()
        by.setdefault(hashlib.sha1(p).hexdigest(), []).append((i, len(p)))
    want = []
    for digest, held in by.items():
        top = max((i for i, _ in held if i is not None), default=None)
        for i, n in held:
            revisit = n >= 1000 and top is not None and i != top
            want.append((i, n, digest, "revisit" if revisit else "response", top if revisit else None))
    mine = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    big = "<p>é word</p>" * 200
    rows = [(1, "http://a", big), (5, "http://b", big), (3, None, big), (4, "http://c", "x" * 999), (6, "http://c", "x" * 999), (7, "u", None), (8, "u", ""), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (None, "n", big), (5, "http://b", big), (11, "l", "w " * 2_000_000), (None, "m", "only null" * 200)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], SCHEMA + ", target int, digest string")
    check(rows, wz.digests(pages).collect())


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i + 1)) for i in range(60)]
    written = wz.archive(spark.createDataFrame(rows, SCHEMA).repartition(3), path=f"file://{tmp_path}/warc", records=7)
    assert written.count() >= 9 and written.selectExpr("sum(n_records)").first()[0] == 60
    back = wz.read_back(written).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in back} == {i: h for i, _, h in rows}
    assert {r.page_id: r.url for r in back} == {i: u for i, u, _ in rows}


def test_empty_table(spark):
    assert wz.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    check([(r.page_id, r.url, r.html) for r in pages.collect()], wz.digests(pages).collect())


def test_large_ids_beside_null(spark):
    big = 2**53 + 1
    pages = spark.createDataFrame([(big, "u", "x" * 2000), (None, "v", "y"), (big + 2, "w", "x" * 2000)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r for r in wz.digests(pages).collect()}
    assert set(got) == {big, big + 2, None} and got[big].refers_to == big + 2
