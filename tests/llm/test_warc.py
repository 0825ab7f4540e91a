import base64
import gzip
import hashlib
import io

import pytest

from quarrylight.llm import warc

PAGES = [(1, "http://a/x", "<p>" + "q" * 1200), (2, "http://b", "<p>" + "q" * 1200), (5, "http://c\nd", "<p>" + "q" * 1200), (5, "http://c", "<p>" + "q" * 1200), (None, "http://n", "<p>" + "q" * 1200), (6, None, None), (7, "u", ""), (8, "v", "short"), (9, "w", "short"), (10, "x", "é" * 4000 + "\x1f"), (None, "y", "z" * 1500), (None, "y", "z" * 1500)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, record_type string")
    files = warc.write_pages(pages)
    payload = {k: (t or "").encode() for k, (_, _, t) in enumerate(PAGES)}
    want = []
    for k, (i, _, _) in enumerate(PAGES):
        same = [PAGES[j][0] for j in payload if payload[j] == payload[k] and PAGES[j][0] is not None]
        again = len(payload[k]) >= 1000 and same and i != max(same) and sum(payload[j] == payload[k] for j in payload) > 1
        want.append((i, len(payload[k]), hashlib.sha1(payload[k]).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    for split in (300, 1 << 20):
        found = warc.read_archives(files, split=split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == set(payload.values())
    base = files.first().path.rsplit("/", 1)[0]
    assert {r.path: r.bytes for r in warc.archives(spark, base).collect()} == {r.path: r.bytes for r in files.collect()}
    assert warc.read_archives(warc.write_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_every_split_owns_each_record_once(step):
    """Also where payloads hold gzip's magic, and even whole members, uncompressed."""
    import zlib

    inner = warc.record_bytes(99, "in", b"inside")
    records = [warc.record_bytes(k, "u", p) for k, p in enumerate([b"", warc.MAGIC * 5, inner, b"\x00" * 3000, b"end"])]
    squeezed = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the payload's bytes show
    records.append(squeezed.compress(zlib.decompress(records[1], 31)) + squeezed.flush())
    data = b"".join(records)
    ids = [int(r["page-id"]) for a in range(0, len(data), step) for r in warc.records(io.BytesIO(data), a, min(a + step, len(data)))]
    assert sorted(ids) == sorted([0, 1, 2, 3, 4, 1])


def test_damage_is_seen():
    record = warc.parse_record(warc.decode_member(warc._Source(io.BytesIO(warc.record_bytes(1, "u", b"payload")), 0), 0)[0])
    with pytest.raises(ValueError, match="digest"):
        warc._row(record | {"block": record["block"] + b"!"}, True)
    assert warc.decode_member(warc._Source(io.BytesIO(b"\x1f\x8b\x08not gzip"), 0), 0) is None


def test_records_cut_off_or_damaged_are_errors():
    first, last = warc.record_bytes(1, "u", bytes(range(256)) * 40), warc.record_bytes(2, "u", hashlib.sha512(b"x").digest() * 400)
    for whole in (first + last[:-40], first + last[:-8] + b"\0" * 8):
        found = warc.records(io.BytesIO(whole), 0, len(whole))
        assert next(found)["page-id"] == "1"
        with pytest.raises(ValueError, match="cut off|damaged"):
            next(found)
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")


def _foreign(head: str, block: bytes) -> dict:
    whole = f"WARC/1.0\r\n{head}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    member = gzip.compress(whole)
    (record,) = warc.records(io.BytesIO(member), 0, len(member))
    return warc._row(record, True)


def test_records_of_others():
    block = b"software: x\r\n\r\nformat: y"
    sha1, md5 = hashlib.sha1(block), hashlib.md5(block)
    info = _foreign(f"WARC-Type: warcinfo\r\nWARC-Payload-Digest: sha1:{base64.b32encode(sha1.digest()).decode()}", block)
    assert (info["record_type"], info["payload"], info["payload_digest"], info["page_id"], info["url"]) == ("warcinfo", block, sha1.hexdigest(), None, None)
    for told in (f"md5:{md5.hexdigest()}", f"MD5:{base64.b32encode(md5.digest()).decode()}", f"sha-1:{sha1.hexdigest().upper()}", "crc32:00", "sha1:???", ""):
        assert _foreign(f"warc-type:resource\r\nWARC-Payload-Digest:{told}", block)["payload"] == block
    with pytest.raises(ValueError, match="digest"):
        _foreign(f"WARC-Type: resource\r\nWARC-Payload-Digest: md5:{'0' * 32}", block)
    folded = _foreign("WARC-Type :response\r\nWARC-Target-URI: http://a/\r\n\t b\r\nPage-Id: x\r\nContent-Type: application/http", b"HTTP/1.1 200 OK\r\n\r\nbody")
    assert (folded["record_type"], folded["url"], folded["page_id"], folded["payload"]) == ("response", "http://a/ b", None, b"body")
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nx\r\n0\r\n\r\n"
    assert _foreign(f"WARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: md5:{'0' * 32}", chunked)["payload"].startswith(b"1")
    again = _foreign("WARC-Type: revisit", b"")
    assert (again["payload_bytes"], again["payload_digest"], again["payload"]) == (None, None, None)
