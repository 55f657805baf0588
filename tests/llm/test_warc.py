import gzip
import hashlib
import base64
import json

import pytest

from liftlens.llm import warc


def expected(rows, least=0):
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if key is not None and len(data) >= least:
            first[data] = min(key, first.get(data, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        lead = first.get(data)
        refers = lead if lead is not None and key != lead else None
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


ROWS = [(i, f"http://x/{i}\r\n", ["<p>a</p>", "", None, "é" * 3000, f"own {i}\r\n\r\nWARC/1.1"][i % 5]) for i in range(40)]
ROWS += [(None, None, "<p>a</p>"), (None, "u", "only null"), (7, "again", "x"), (7, "again", "x")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "'y' as refers_to")
    records = warc.read_records(warc.archive(pages, str(tmp_path), least)).collect()
    number = lambda x: None if x is None else int(x)
    got = [(number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in records]
    assert sorted(got, key=str) == expected(ROWS, least)
    for r in records:
        if r.record_type == "response":
            assert warc.digest_base32(r.payload) == r.payload_digest
        else:
            assert r.payload is None


def test_normalised_members_stand_alone(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    for r in warc.archive(pages, str(tmp_path)).collect():
        data = open(r.path, "rb").read()
        index = [json.loads(x) for x in open(r.index_path)]
        assert r.records == len(index) and r.bytes == len(data)
        members = [data[e["offset"] : e["offset"] + e["length"]] for e in index]
        assert b"".join(members) == data
        assert b"".join(gzip.decompress(m) for m in members) == gzip.decompress(data)


def test_multi_member_and_broken_input(tmp_path):
    one = warc.record_bytes(1, "u", b"x" * 3_000_000)
    two = warc.record_bytes(2, "u", b"y", refers_to=1)
    for data in (gzip.compress(one + two), gzip.compress(one) + gzip.compress(two)):
        (tmp_path / "f").write_bytes(data)
        assert list(warc.stream_records(open(tmp_path / "f", "rb"))) == [one, two]
        (tmp_path / "f").write_bytes(data[: len(data) // 2])
        with pytest.raises(ValueError):
            list(warc.stream_records(open(tmp_path / "f", "rb")))


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive(pages, str(tmp_path))).count() == 0
