import hashlib

import pytest

from cairn.llm.common import shared_folder
from cairn.llm.op3_warc import ArchiveError, archive, frame_end, frames, parse_record, payload_of, read_archives, record, write_archives


def sample(i, n=400):
    body = (f"<html>page {i} " + "some words that repeat " * 20).encode()[:n]
    return record(i, f"http://h.example/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None), body


def test_frames_and_records():
    rows = [sample(i) for i in range(200)]
    data = archive([r for r, _ in rows])
    assert data[:4] == bytes.fromhex("5d2a4d18")
    got = list(frames(data))
    assert got == [r for r, _ in rows]
    assert payload_of(*parse_record(got[7])) == (len(rows[7][1]), rows[7][1])
    assert list(frames(archive([rows[0][0]]))) == [rows[0][0]]  # too little for a dictionary
    assert list(frames(b"")) == []


@pytest.mark.parametrize("spoil", [lambda d: d[:-3], lambda d: d[:-1] + bytes([d[-1] ^ 1]), lambda d: d + b"xxxxxxxx", lambda d: d[:6], lambda d: b"\x00" + d])
def test_broken_archives(spoil):
    data = archive([sample(i)[0] for i in range(50)])
    with pytest.raises(ArchiveError):
        list(frames(spoil(data)))


def test_broken_records():
    r, body = sample(1)
    for bad in (r.replace(b"WARC/1.1", b"HTTP/1.1"), r.replace(b"WARC-Date", b"X-Date"), r[:-1], r + b"\n", r.replace(b"Content-Length: 4", b"Content-Length: 5", 1)):
        with pytest.raises(ArchiveError):
            payload_of(*parse_record(bad))
    with pytest.raises(ArchiveError):
        payload_of(*parse_record(r.replace(b"page 1", b"page 2")))
    with pytest.raises(ArchiveError):
        frame_end(b"\x28\xb5\x2f", 0)


def test_round_trip(spark):
    same = "<p>" + "equal payload " * 20 + "é</p>"
    rows = [(5, "http://a.example/5", same, 0), (2, "http://a.example/2", same, 0), (2, "http://a.example/2", same, 0), (9, None, same, 0), (None, "http://x", same, 0),
            (1, "http://a.example/ü\r\nX: y", "", 0), (3, "", None, 0), (4, "u", "short", 0), (6, "u", "short", 0), (7, "v", "long " * 400_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = "file://" + shared_folder(spark).removeprefix("file://")
    manifest = write_archives(pages, folder)
    got = read_archives(spark, folder, manifest, payloads=True).collect()
    assert len(got) == len(rows) == manifest.agg({"records": "sum"}).first()[0]
    by = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=repr)
    n = len(same.encode())
    assert by == sorted([(5, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (9, n, "revisit", 2), (None, n, "response", None), (1, 0, "response", None),
                         (3, 0, "response", None), (4, 5, "response", None), (6, 5, "response", None), (7, 2_000_000, "response", None)], key=repr)
    for r in got:
        text = {x[0]: x[2] or "" for x in rows}[r.page_id].encode()
        assert r.payload_digest == hashlib.sha256(text).hexdigest() and (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) == text


def test_no_pages(spark):
    folder = "file://" + shared_folder(spark).removeprefix("file://")
    manifest = write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and read_archives(spark, folder, manifest).count() == 0
