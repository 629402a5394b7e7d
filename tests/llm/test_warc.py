import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from feltgrid.llm import warc

BIG = "<p>é🎉" + "payload " * 40
ROWS = [(1, "http://a/1", BIG, "own"), (2, "http://a/2", BIG, "own"), (3, "http://b\r\nX: y", "short", "own"), (4, "http://b/4", "short", "own"), (5, None, None, "own"),
        (6, "http://c", "", "own"), (7, "http://c", BIG + "x" * 300_000, "own"), (None, "http://n", BIG, "own"), (2, "http://a/2", BIG, "own")]


@pytest.fixture(scope="module")
def manifest(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string, kind string").coalesce(2)
    return warc.write_archives(df, roll_bytes=600)


def test_round_trip(spark, manifest):
    read = warc.records(warc.read_archives(manifest)).collect()
    assert len(read) == len(ROWS) and manifest.count() > 2
    assert warc.quarantine(warc.read_archives(manifest)).count() == 0
    payload = {str(r[0] or ""): (r[2] or "").encode() for r in ROWS}
    for r in read:
        data = payload[r.page_id or ""]
        assert r.payload_bytes == len(data) and r.payload_digest == hashlib.sha256(data).hexdigest()
        if r.page_id in ("2", None):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", "1", None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)


def test_archives_are_gzip_members_of_valid_records(manifest):
    for row in manifest.collect():
        path = row.path.removeprefix("file:")
        assert os.path.getsize(path) == row.bytes
        assert gzip.open(path).read().count(b"WARC/1.1\r\n") == row.records


def record(i, payload=b"x" * 50):
    return warc.record_bytes(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), "response", None)


def summary(data):
    records, gaps = [], []
    for kind, start, end, what in warc.salvage(warc.Bytes(data)):
        (records if kind == "record" else gaps).append(what["x-page-id"] if kind == "record" else (start, end))
    return records, gaps


@pytest.mark.parametrize("pack", [warc.member, lambda r: r])
def test_salvage_skips_only_what_is_damaged(pack):
    parts = [pack(record(i)) for i in range(6)]
    assert summary(b"".join(parts)) == (list("012345"), [])
    at = [sum(map(len, parts[:i])) for i in range(7)]
    flipped = bytearray(b"".join(parts))
    flipped[at[3] - 20] ^= 255
    assert summary(bytes(flipped)) == (list("01345"), [(at[2], at[3])])
    short = b"".join(parts)[: at[5] + 30]
    assert summary(short) == (list("01234"), [(at[5], at[5] + 30)])
    junk = parts[0] + b"garbage WARC/1.1 and \x1f\x8b\x08 garbage" + b"".join(parts[1:])
    assert summary(junk)[0] == list("012345") and len(summary(junk)[1]) == 1
    longer = b"".join(parts).replace(b"Content-Length: 109", b"Content-Length: 999", 1)
    assert pack is warc.member or summary(longer)[0] == list("12345")


def test_a_damaged_record_in_a_valid_member():
    bad = bytearray(record(1))
    bad[-10] ^= 1
    records, gaps = summary(warc.member(record(0)) + warc.member(bytes(bad)) + warc.member(record(2)))
    assert records == ["0", "2"] and len(gaps) == 1


def test_no_rows_and_empty_files(spark, tmp_path):
    assert summary(b"") == ([], [])
    assert warc.read_archives(spark.createDataFrame([], "path string")).count() == 0
    empty = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert empty.count() == 0
    (tmp_path / "a.warc").write_bytes(record(1) + b"\0" * 100 + record(2))
    read = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string"))
    assert read.filter(F.col("kind") == "record").count() == 2 and [(r.end - r.start) for r in warc.quarantine(read).collect()] == [100]


def test_headers_of_any_length_are_read(spark, tmp_path):
    url = "data:text/html," + "a" * 300_000
    df = spark.createDataFrame([(1, url, BIG), (2, "http://a/2", BIG + "y")], "page_id long, url string, html string")
    read = warc.read_archives(warc.write_archives(df))
    assert warc.quarantine(read).isEmpty() and {r.page_id: len(r.url) for r in warc.records(read).collect()} == {"1": len(url), "2": 10}
    payload = b"x" * 50
    long = warc.record_bytes(9, url, payload, hashlib.sha256(payload).hexdigest(), "response", None)
    assert summary(record(1) + long + record(2)) == (["1", "9", "2"], [])
    assert summary(record(1) + long[:200_000]) == (["1"], [(len(record(1)), len(record(1)) + 200_000)])


def test_records_before_the_damage_of_a_member_are_kept():
    """One member for the whole file, as many tools write it."""
    whole = warc.member(b"".join(record(i, bytes(os.urandom(400))) for i in range(3)))
    checksum = bytearray(whole)
    checksum[-6] ^= 255
    for data in (bytes(checksum), whole[:-9]):
        records, gaps = summary(data)
        assert records[:2] == ["0", "1"] and gaps == [(0, len(data))], records
    assert summary(bytes(checksum))[0] == ["0", "1", "2"]
    later = warc.member(record(7))
    assert summary(bytes(checksum) + later) == (["0", "1", "2", "7"], [(0, len(whole))])
    bare = record(5).replace(b"WARC-Payload-Digest", b"X-Payload-Digest")
    damaged = bytearray(warc.member(bare + bare))
    damaged[-6] ^= 255
    assert summary(bytes(damaged)) == ([], [(0, len(damaged))])
