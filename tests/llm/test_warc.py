import base64
import hashlib
import io

import pytest

from cuelake.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, copies long, payload string")


def row(page_id, url, html):
    return (page_id, url, html, "x", 1, "y")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_with_nulls_ties_and_repeats(spark):
    rows = [
        row(1, "http://a/1", "same"), row(5, "http://a/5", "same"), row(3, None, "same"), row(2, "http://a/ x\r\nY: 1", "ü" * 3),
        row(4, "http://a/4", None), row(6, "http://a/6", ""), row(7, "u", "z" * 3_000_000), row(None, "u", "alone"),
        row(None, "u", "same"), row(8, "u", "twice"), row(8, "u", "twice"),
    ]
    got = warc.read_archives(warc.write_archives(pages(spark, rows))).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    same, none, twice = digest("same"), digest(""), digest("twice")
    want = [
        (1, 4, same, "revisit", 5), (5, 4, same, "response", None), (3, 4, same, "revisit", 5),
        (None, 4, same, "revisit", 5), (2, 6, digest("üüü"), "response", None), (4, 0, none, "revisit", 6),
        (6, 0, none, "response", None), (7, 3_000_000, digest("z" * 3_000_000), "response", None),
        (None, 5, digest("alone"), "response", None), (8, 5, twice, "response", None), (8, 5, twice, "response", None),
    ]
    assert seen == sorted(want, key=repr)
    assert {r.payload.decode() for r in got if r.page_id == 2} == {"üüü"}


def test_short_payloads_are_stored_each(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, [row(1, "u", "ab"), row(2, "u", "ab")]), least_bytes=3))
    assert {r.record_type for r in got.collect()} == {"response"}


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def members():
    return [warc.member(k, "http://x", data, warc.digest_of(data), None, False) for k, data in enumerate([b"one", b"two" * 50_000])]


def test_records_come_one_by_one():
    found = list(warc.records(io.BytesIO(b"".join(members()))))
    assert [r.payload for r in found] == [b"one", b"two" * 50_000]


@pytest.mark.parametrize("broken", ["cut", "digest", "length", "two"])
def test_broken_archives_are_told(broken):
    import zlib

    one, two = members()
    text = zlib.decompress(one, 31)
    pack = lambda x: (p := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + p.flush()
    data = {
        "cut": one + two[:-30],
        "digest": pack(text.replace(b"\r\n\r\none", b"\r\n\r\nown")),
        "length": pack(text.replace(b"one\r\n\r\n", b"on\r\n\r\n")),
        "two": pack(text + text),
    }[broken]
    with pytest.raises(warc.BrokenArchive):
        list(warc.records(io.BytesIO(data)))
