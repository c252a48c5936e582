import base64
import gzip
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skillscope.llm import queries, warc

ROWS = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, None, "same"), (3, "http://a/ü x\r\nWARC/1.1", "other é漢😀"),
        (4, "u4", ""), (6, "u6", None), (7, "u7", "line\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
        (8, "u8", "x" * 40_000), (9, "u9", "é😀" * 30_000), (None, "u", "without id"), (None, "u", "same"),
        (10, "twice", "twice" * 9_000), (10, "twice", "twice" * 9_000), (11, "u", "y" * 40_000), (12, "u", "y" * 40_000)]
SCHEMA = "page_id long, url string, html string, payload int, record_id string"


def sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "")]
        largest = max(ids, key=lambda j: (j is not None, j or 0))
        revisit = i != largest and len(payload) >= least
        out.append((i, len(payload), sha1(payload), "revisit" if revisit else "response", largest if revisit else None, True))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_equals_the_contract(spark, tmp_path, partitions):
    frame(spark, ROWS).repartition(partitions).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op12_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == brute(ROWS)


def test_payloads_come_back_and_short_ones_are_never_revisits(spark, tmp_path):
    warc.write(frame(spark, ROWS), f"{tmp_path}/w", least_revisit_bytes=5, segment_bytes=1000, chunk_bytes=7)
    rows = warc.read(spark, f"{tmp_path}/w").collect()
    assert len(rows) == len(ROWS) and all(r.verified for r in rows)
    want = sorted((html or "").encode() for i, _, html in ROWS if i != 11)
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == want
    assert max(r.n_segments for r in rows) > 100
    assert {r.target_uri for r in rows} >= {"http://a/1", "http://a/%C3%BC%20x%0D%0AWARC/1.1", None}
    assert [r.record_type for r in rows].count("revisit") == 1


def test_files_are_archives_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE_BYTES", 50_000)
    warc.write(frame(spark, [(i, "u", "%d " % i * 3000) for i in range(200)]).coalesce(1), f"{tmp_path}/w")
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 1
    for f in files:
        raw = gzip.decompress(f.read_bytes())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and raw.endswith(b"\r\n\r\n")
        assert all(whole for _, _, whole in warc.parsed(raw))
    assert warc.read(spark, f"{tmp_path}/w").filter("verified").count() == 200


def _segments(origin, blocks, total, numbers=None):
    out = b""
    for n, b in zip(numbers or range(1, len(blocks) + 1), blocks):
        fields = {"WARC-Segment-Number": n, "WARC-Segment-Origin-ID": f"<{origin}>" if n > 1 else None,
                  "WARC-Segment-Total-Length": total if n == len(blocks) else None}
        out += warc.record("continuation" if n > 1 else "response", origin if n == 1 else f"{origin}:{n}", "d", b, fields) + warc.END
    return out


def test_segments_in_any_order_over_files_and_faults(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.framed(b"0123456789" * 5, 8)
    parts = [block[i:i + 20] for i in range(0, len(block), 20)]
    good = _segments("good", parts, len(block))
    second = _segments("good", parts, len(block)).split(b"WARC/1.1")
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1" + b"WARC/1.1".join(reversed(second[1:])))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(_segments("short", parts, len(block) + 1)) + gzip.compress(
        _segments("gap", parts[:2] + parts[3:], len(block), [1, 2, *range(4, len(parts) + 1)])))
    cut = _segments("cut", [block], len(block))
    (tmp_path / "c.warc").write_bytes(cut[:-30])
    (tmp_path / "d.warc").write_bytes(warc.record("response", "plain", "d", b"HTTP/1.1 200 OK\r\n\r\nbody", {
        "WARC-Payload-Digest": "sha1:" + sha1(b"body")}) + warc.END + warc.record(
        "response", "wrong", "d", b"HTTP/1.1 200 OK\r\n\r\nbody", {"WARC-Payload-Digest": "sha1:" + sha1(b"else")}) + warc.END)
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert {k: r.verified for k, r in got.items()} == {
        "good": True, "short": False, "gap": False, "cut": False, "plain": True, "wrong": False}
    assert bytes(got["good"].payload) == b"0123456789" * 5 and bytes(got["plain"].payload) == b"body"
    assert good


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_framing_round_trip(payload, chunk):
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + warc.framed(payload, chunk)
    assert warc.decoded(block)[1:] == (payload, True)
    assert warc.decoded(block[:-6])[2] is False


def test_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op12_warc(spark, str(tmp_path)).count() == 0
