r"""WARC archives: a writer and a splittable reader.

Writing: each task writes one archive of one-record gzip members, with a new name for each
attempt, into a shared folder; the manifest of the archives is what successful tasks returned, so
a lost executor or a repeated task leaves no record twice.  Of records with equal payloads of at
least ``least_bytes`` bytes, that with the largest page_id is a response and the others are
revisit records, which carry the HTTP head, with the full payload's length, and its digest.

Reading: archives are dealt into byte ranges, one task each, with no index.  A task searches its
range for the gzip magic, validates a candidate by decoding the member and its WARC head (and that
a member or the end of the file follows it), and owns exactly the records that start inside the
range; the last one may be read past the end.

Defined edge cases: null html is an empty payload; null page_id gets a record without an id and
loses every comparison; rows equal in page_id and payload are all responses; long payloads are
single records, whole; an empty table gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.shared import fresh_dir, pinned, small_enough, trimmed

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
STEP_BYTES = 1 << 14
#: The upper half of the record ids (UUIDs); the lower half is the page_id.
_UUID = 0x7C1E0D5E9A6B4F10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_UUID << 64 | page_id & (1 << 64) - 1)}>"


def page_of(urn: str) -> int:
    low = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record if it refers to another one."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if page_id is not None:
        fields.append(("WARC-Record-ID", record_id(page_id)))
    fields += [("WARC-Date", date), ("WARC-Target-URI", "".join((url or "").splitlines())), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


@dataclass
class Record:
    offset: int
    fields: dict[str, str]
    block: bytes


def parse(data: bytes, offset: int = 0) -> Record | None:
    """The record of a decoded member, or None if it is none."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = fields.get("content-length", "")
    if not size.isdigit() or len(rest) != int(size) + 4:
        return None
    return Record(offset, fields, rest[: int(size)])


class _Window:
    """Bytes of a file from a moving start, read as needed."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, b""

    def until(self, end: int) -> bytes:
        """Everything from the start to ``end`` at least, or to the end of the file."""
        missing = min(end, self.size) - self.start - len(self.data)
        if missing > 0:
            self.file.seek(self.start + len(self.data))
            self.data += self.file.read(min(max(missing, READ_BYTES), self.size - self.start - len(self.data)))
        return self.data

    def drop(self, to: int) -> None:
        """Forget what stands before ``to``, once that is worth a copy."""
        if to - self.start > READ_BYTES:
            self.data, self.start = self.data[to - self.start :], to


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at ``at`` and where it ends, or None if none is there."""
    inflate, place, out = zlib.decompressobj(31), at, []
    first = True
    while not inflate.eof:
        data = window.until(place + 1)[place - window.start : place - window.start + STEP_BYTES]
        if not data:
            return None
        try:
            out.append(inflate.decompress(data))
        except zlib.error:
            return None
        place += len(data)
        if first and out[0] and not out[0].startswith(b"WARC/1."[: len(out[0])]):
            return None
        first = False
    return b"".join(out), place - len(inflate.unused_data)


def records_of_range(file, size: int, start: int, end: int) -> Iterator[Record]:
    """The records that start inside [start, end) of an archive."""
    window, at = _Window(file, size, start), start
    while at < end:
        data = window.until(min(at + STEP_BYTES, end + len(MAGIC) - 1))
        found = data.find(MAGIC, at - window.start)
        if found < 0:
            at = max(at, window.start + len(data) - len(MAGIC) + 1)
            if window.start + len(data) >= min(end + len(MAGIC) - 1, size):
                return
            window.drop(at)
            continue
        at = window.start + found
        if at >= end:
            return
        got = _decode(window, at)
        own = got and parse(got[0], at)
        if own and (got[1] >= size or window.until(got[1] + len(MAGIC)).startswith(MAGIC, got[1] - window.start)):
            yield own
            at = got[1]
        else:
            at += 1
        window.drop(at)


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return where, name


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row into ``folder``; returns the manifest: path, size, records."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("sha", F.unhex(F.sha1("html")))
    groups = pages.select("page_id", F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    shared = groups.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    shared = pinned(shared)  # of repeated payloads only
    count = shared.count()
    if small_enough(count, 32):  # no html is shuffled
        rows = own.join(F.broadcast(shared), "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id") == F.col("kept"), None).otherwise(F.col("kept")).alias("refers_to"))
    else:
        rows = _revisiting(own, groups.join(shared, "sha"))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        name, count, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(name, compression=None)
                out.write(member(record(page_id, url, html.encode("utf-8"), refers_to)))
                count += 1
        if out is not None:
            out.close()
            size = where.get_file_info(name).size
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"]), pa.array([size]), pa.array([count])], ["path", "size", "records"])

    return pinned(rows.mapInArrow(run, "path string, size bigint, records bigint"))


def _revisiting(own: DataFrame, shared: DataFrame) -> DataFrame:
    """``own`` with ``refers_to``, where too many payloads repeat to send them to all tasks: digests alone meet by payload, which may
    be one that most pages have, and html meets its page's decision by page, of which each has few rows."""
    decided = shared.filter(~F.col("page_id").eqNullSafe(F.col("kept"))).select("page_id", "sha", "kept").distinct()
    on = F.col("g.page_id").eqNullSafe(F.col("e.page_id")) & (F.col("g.sha") == F.col("e.sha"))
    return own.alias("g").join(decided.alias("e"), on, "left").select("g.page_id", "g.url", "g.html", F.col("e.kept").alias("refers_to"))


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the archives named in ``manifest`` (path, size): fields, digest and the payload."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = _open(path)
                with where.open_input_file(name) as file:
                    part = []
                    for one in records_of_range(file, size, start, min(start + range_bytes, size)):
                        part.append(_row(path, one))
                        if len(part) == 256:
                            yield pa.RecordBatch.from_pylist(part, shape)
                            part = []
                    if part:
                        yield pa.RecordBatch.from_pylist(part, shape)

    shape = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))).alias("start"))
    count = manifest.agg(F.sum(F.ceil(F.col("size") / range_bytes)).alias("n")).first()["n"]
    ranges = ranges.repartition(max(1, int(count or 0)))  # a task for each range
    return ranges.mapInArrow(run, "path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def _row(path: str, one: Record) -> dict:
    head, _, payload = one.block.partition(b"\r\n\r\n")
    kind, own, refers = one.fields.get("warc-type"), one.fields.get("warc-record-id"), one.fields.get("warc-refers-to")
    revisit = kind == "revisit"
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return {
        "path": path, "offset": one.offset, "page_id": page_of(own) if own else None, "url": one.fields.get("warc-target-uri"), "record_type": kind, "refers_to": page_of(refers) if refers else None,
        "payload_bytes": length if revisit else len(payload), "payload_digest": one.fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload), "payload": None if revisit else payload,
    }


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` into a fresh shared folder and read the archives back."""
    return read(write(pages, fresh_dir(pages.sparkSession, "warc"), least_bytes))
