"""WARC archives: a writer, and a reader that splits archives at any byte.

Each record is a gzip member of its own. The reader's tasks get byte ranges; a task scans its range for gzip's magic,
takes a place as a record's start only if the bytes there decode to a WARC header, and
owns the records that start inside its range, reading past its end for the last of them. Tasks hold one record at a time.

Archives live below a path that executors can open through pyarrow's file systems (file, hdfs, s3, gs).
The writer gives each attempt of a task its own file and lists only the files of attempts that ended, so that lost
executors leave files that nothing reads.

Defined results: a null payload is empty; rows without an id are written without one; repeated rows are
written as often as they occur; of rows with equal payloads that bear the largest id, all are responses;
payloads shared only by rows without ids are all responses; other columns of pages are not read; an empty table gives
an empty result.

Archives of others are read by WARC 1.1: header names in any case, folded lines, any blanks around the colon. All types are
returned. In blocks of type application/http the payload is what follows the HTTP header, else the whole block. Digests of known
algorithms, hexadecimal or base 32, are checked, but for revisits, segments, and blocks with a transfer encoding; others
aren't. What a record doesn't tell is null. A record whose first line is there and whose rest is cut off or damaged is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.runtime import col, cut, new_shared_path

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one task scans, and bytes read at once.
SPLIT, CHUNK = 8 << 20, 1 << 20
#: A WARC header that isn't complete within so many bytes isn't one.
LONGEST_HEADER = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_urn(page_id: int | None) -> str:
    """The record id of a page, the same wherever it is written; a random one without an id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, kind: str = "response", refers_to: int | None = None) -> bytes:
    """One record as a gzip member. A revisit has the headers of its payload and not the payload."""
    block = _HTTP + (payload if kind == "response" else b"")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeezed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeezed.compress(whole) + squeezed.flush()


def parse_record(whole: bytes) -> dict:
    """Headers (lower-case names) and block of a decoded record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields, name = {}, ""
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):  # goes on with the line before
            if name:
                fields[name] += f" {line.strip()}"
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    size = fields.get("content-length", "")
    if not size.isdecimal() or int(size) > len(rest):
        raise ValueError(f"record {fields.get('warc-record-id')} has {len(rest)} bytes of Content-Length {size!r}")
    return fields | {"block": rest[: int(size)]}


class _Source:
    """Bytes of a file from `at` on, read as they are asked for."""

    def __init__(self, file, at: int):
        self.file, self.base, self.buffer, self.ended = file, at, b"", False
        file.seek(at)

    def upto(self, at: int) -> None:
        """Holds the bytes up to file position `at`, if there are as many."""
        parts, have = [self.buffer], self.base + len(self.buffer)
        while have < at and not self.ended:
            more = self.file.read(max(CHUNK, min(at - have, 8 * CHUNK)))
            self.ended = not more
            parts.append(more)
            have += len(more)
        self.buffer = b"".join(parts) if len(parts) > 1 else self.buffer

    def forget(self, at: int) -> None:
        self.buffer, self.base = self.buffer[at - self.base :], at


def begins_record(data: bytes) -> bool:
    """Whether a gzip member's first bytes, whatever its end is like, are a WARC record's."""
    try:
        return zlib.decompressobj(31).decompress(data, 7) == b"WARC/1."
    except zlib.error:
        return False


def decode_member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """The record whose gzip member starts at `at`, and where the member ends; None if no record starts there.

    A member that begins like a record and ends early or can't be decoded is an error.
    """
    squeezed, out, known = zlib.decompressobj(31), [], False
    size, pos = 0, at
    while True:
        source.upto(pos + CHUNK // 16 if not known else pos + CHUNK)
        data = source.buffer[pos - source.base : pos - source.base + CHUNK]
        if not data:
            if begins_record(source.buffer[at - source.base :]):
                raise ValueError(f"the record at byte {at} is cut off")
            return None
        try:
            got = squeezed.decompress(data)
        except zlib.error as e:
            if begins_record(source.buffer[at - source.base :]):
                raise ValueError(f"the record at byte {at} is damaged") from e
            return None
        pos += len(data)
        out.append(got)
        size += len(got)
        if not known:
            start = b"".join(out)
            if not start.startswith(b"WARC/1."[: max(1, min(7, size))]) and size:
                return None
            if b"\r\n\r\n" in start:
                known = True
            elif size > LONGEST_HEADER:
                return None
        if squeezed.eof:
            return (b"".join(out), pos - len(squeezed.unused_data)) if known else None


def records(file, start: int, end: int) -> Iterator[dict]:
    """The records that start in bytes [start, end) of a file."""
    source, at = _Source(file, start), start
    while at < end:
        source.upto(at + CHUNK)
        found = source.buffer.find(MAGIC, at - source.base)
        if found < 0:
            at = max(at, source.base + len(source.buffer) - len(MAGIC) + 1)
            if source.ended:
                return
            source.forget(at)
            continue
        at = source.base + found
        if at >= end:
            return
        source.forget(at)
        member = decode_member(source, at)
        if member is None:
            at += 1
            continue
        whole, at = member
        yield parse_record(whole)


def _writer(base: str):
    def run(batches):
        where, top = fs.FileSystem.from_uri(base)
        name, n, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, html, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    where.create_dir(top, recursive=True)
                    out = where.open_output_stream(f"{top}/{name}", compression=None)
                record = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), kind, refers)
                out.write(record)
                n, size = n + 1, size + len(record)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([f"{base}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "bytes"])

    return run


def write_pages(pages: DataFrame, *, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page below the shared folder; gives path, n_records and bytes of each archive.

    Of pages with equal payloads of `least_bytes` or more, the one with the largest id is a response and the others revisit it.
    """
    source = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    source = source.withColumn("digest", F.when(size >= least_bytes, F.sha1("html")))
    largest = source.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").drop("n")
    known = source.join(largest, "digest", "left")
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    out = known.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("kept")).alias("refers_to"))
    base = new_shared_path(pages.sparkSession, "warc")
    return cut(out.mapInArrow(_writer(base), "path string, n_records bigint, bytes bigint"))


def archives(spark, base: str) -> DataFrame:
    """path and bytes of the archives (*.warc.gz) directly below a folder."""
    where, top = fs.FileSystem.from_uri(base)
    scheme = base.split("://", 1)[0] + "://" if "://" in base else ""
    found = [(scheme + x.path, x.size) for x in where.get_file_info(fs.FileSelector(top)) if x.path.endswith(".warc.gz")]
    return spark.createDataFrame(found, "path string, bytes bigint")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
_RECORD_SQL = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _reader(payloads: bool):
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, top = fs.FileSystem.from_uri(path)
                with where.open_input_file(top) as file:
                    for r in records(file, start, end):
                        rows.append(_row(r, payloads))
                        size += len(rows[-1]["payload"] or b"") + 200
                        if size > CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return run


#: Digest algorithms that are checked, and their sizes in bytes.
_DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


def digest_told(told: str) -> tuple[str, str] | None:
    """Algorithm and lower-case hexadecimal value of a digest header in either notation; None if it has no known ones."""
    algorithm, _, value = told.partition(":")
    algorithm, value = algorithm.strip().lower().replace("-", ""), value.strip()
    size = _DIGESTS.get(algorithm)
    if size is None:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.rstrip("=").upper() + "=" * (-len(value.rstrip("=")) % 8))
    except ValueError:
        return None
    return (algorithm, raw.hex()) if len(raw) == size else None


def _row(r: dict, payloads: bool) -> dict:
    kind, told = r.get("warc-type"), digest_told(r.get("warc-payload-digest", ""))
    number = lambda k: int(r[k]) if r.get(k, "").removeprefix("-").isdecimal() else None
    if kind == "revisit":
        size, digest, payload = number("payload-length"), told[1] if told and told[0] == "sha1" else None, b""
    else:
        http = r.get("content-type", "").lower().startswith("application/http")
        head, _, payload = r["block"].partition(b"\r\n\r\n") if http else (b"", b"", r["block"])
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        whole = "warc-segment-number" not in r and b"\r\ntransfer-encoding:" not in head.lower()
        if told and whole and hashlib.new(told[0], payload).hexdigest() != told[1]:
            raise ValueError(f"record {r.get('warc-record-id')} has another payload than its digest says")
    return {"page_id": number("page-id"), "url": r.get("warc-target-uri"), "record_type": kind, "refers_to": number("refers-to-page-id"), "payload_bytes": size, "payload_digest": digest, "payload": payload if payloads and kind != "revisit" else None}


def read_archives(files: DataFrame, *, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of archives given by path and bytes, read in ranges of `split` bytes."""
    ranges = files.where("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, bytes - 1, {int(split)}L)")).alias("start")).select("path", "start", (F.col("start") + split).alias("end"))
    spread = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return ranges.repartition(max(1, min(int(spread), 20_000))).mapInArrow(_reader(payloads), _RECORD_SQL)
