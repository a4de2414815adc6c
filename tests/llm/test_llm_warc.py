"""WARC round trips, the sidecar index, and broken or odd archives."""

import base64
import gzip
import hashlib
import io
import json
import os
import zlib

import pytest

from quire.llm import warc

ROWS = [
    (3, "<p>a</p>"), (1, "<p>a</p>"), (1, "<p>a</p>"), (9, None), (8, ""), (5, "é\r\n\r\nWARC/1.0\r\n\n"), (6, "x" * 3_000_000), (7, "\r\n"), (None, "<p>a</p>"), (None, "only"),
]


def want(min_bytes):
    out = []
    for i, t in ROWS:
        b = (t or "").encode()
        same = [j for j, u in ROWS if (u or "") == (t or "") and j is not None]
        first = min(same) if same and len([1 for _, u in ROWS if (u or "") == (t or "")]) > 1 and len(b) >= min_bytes else None
        refers = first if first is not None and first != i else None
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        out.append((None if i is None else str(i), "revisit" if refers is not None else "response", None if refers is not None else b, len(b), digest, None if refers is None else str(refers)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "page_id long, html string, size int")
    got = warc.round_trip(df, min_bytes=min_bytes).collect()
    rows = [(r.record_id, r.warc_type, None if r.warc_type == "revisit" else bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in got]
    assert sorted(rows, key=str) == want(min_bytes)
    assert warc.round_trip(df.limit(0)).count() == 0


def record(i, body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_every_record_becomes_a_member_of_its_own(spark, tmp_path):
    bodies = [b"", b"one", bytes(range(256)) * 9000, b"\r\n\r\n", b"last"]
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies))))
    paths = spark.createDataFrame([(f"file://{tmp_path}/in.warc.gz",)], "path string")
    index = sorted(warc.normalise(paths, f"file://{tmp_path}/out").collect(), key=lambda r: r.offset)
    data = (tmp_path / "out" / "in.warc.gz").read_bytes()
    lines = [json.loads(x) for x in (tmp_path / "out" / "in.cdxj").read_text().splitlines()]
    assert sorted(os.listdir(tmp_path / "out")) == ["in.cdxj", "in.warc.gz"]
    assert [(r.offset, r.length) for r in index] == [(x["offset"], x["length"]) for x in lines]
    assert sum(r.length for r in index) == len(data)
    for r, b in zip(index, bodies, strict=True):
        inflater = zlib.decompressobj(31)
        assert inflater.decompress(data[r.offset:]).endswith(b + b"\r\n\r\n") and inflater.eof


def test_streams_of_several_members_and_broken_streams():
    two = gzip.compress(record(1, b"a")) + gzip.compress(record(2, b"b"))
    assert [p for *_, p in warc.records_of(io.BytesIO(two))] == [b"a", b"b"]
    assert list(warc.records_of(io.BytesIO(gzip.compress(b"")))) == []
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(gzip.compress(record(1, b"abc")[:-6]))))
    packer = zlib.compressobj(9, zlib.DEFLATED, 31)
    whole = packer.compress(record(1, b"abc")) + packer.flush(zlib.Z_FULL_FLUSH)  # cut exactly after a record
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_of(io.BytesIO(whole)))


def test_headers_follow_the_standard(spark, tmp_path):
    rows = [(1, "<p>a</p>", "http://h/1"), (2, "<p>a</p>", "http://h/2 x\r\nEvil: 1"), (3, "b", None), (3, "b", None), (None, "c", "http://h/n")]
    records = warc.plan_records(spark.createDataFrame(rows, "page_id long, html string, url string"), url="url")
    warc.write_monolithic(records, f"file://{tmp_path}/raw", "2024-05-06T07:08:09Z")
    found = [x for f in sorted((tmp_path / "raw").glob("*.gz")) for x in warc.records_of(io.BytesIO(f.read_bytes()))]
    assert len(found) == 5 and len({f["warc-record-id"] for _, f, _ in found}) == 5
    for block, f, payload in found:
        head, _, body = payload.partition(b"\r\n\r\n")
        assert block.startswith(b"WARC/1.1\r\n") and f["warc-record-id"].startswith("<urn:uuid:") and len(f["warc-record-id"]) == 47
        assert f["warc-date"] == "2024-05-06T07:08:09Z" and f["content-type"] == "application/http; msgtype=response" and "evil" not in f
        assert head.startswith(b"HTTP/1.1 200 OK\r\n") and (f["warc-type"] == "revisit") == (body == b"") == ("warc-profile" in f)
    by = {f["warc-target-uri"]: f for _, f, _ in found}
    assert set(by) == {"http://h/1", "http://h/2%20x%20%20Evil:%201", "urn:page:3", "http://h/n"}
    again = by["http://h/2%20x%20%20Evil:%201"]
    assert again["warc-type"] == "revisit" and again["warc-refers-to-target-uri"] == "http://h/1" and again["warc-profile"].endswith("identical-payload-digest")
