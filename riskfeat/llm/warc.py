"""WARC archives of pages: written by tasks, read back one record at a time.

Every record is a gzip member of its own. The reader goes through an archive once, from
its first byte to its last: it inflates step by step, reads a record's headers, takes as
many bytes as its Content-Length names, and checks the digests. So it holds one block of
the file and one record, whatever the size of the archive.

A page's payload is its html in UTF-8. Of the pages with equal payloads of at least
``least`` bytes the one with the largest id is written in full (``response``); the others
are ``revisit`` records, which name it and leave the payload out.

Archives are complete or absent: a task writes under a name of its own attempt, and only
the list of files that committed tasks return (a table in the shared folder) says what
belongs to the archive. A lost or repeated task leaves files that nothing reads.

Defined results: a null html is an empty payload; a null page id is kept, such a page is
never the one that others refer to; rows that repeat the largest id and its payload are
all responses, as nothing tells them apart; line breaks and spaces in a url are escaped; a
null url stands as urn:page:<id>; no pages give no records. Input columns other than the
three do not matter. A damaged archive raises an error with the file and the place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfeat.llm.storage import located
from riskfeat.session import materialize, scratch_path

READ_BYTES = 1 << 18
#: No date is known of a page; a fixed one keeps archives equal from run to run.
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class DamagedArchive(ValueError):
    pass


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32, as archives write it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None = None) -> bytes:
    """One record as it stands in an archive, uncompressed."""
    block = HTTP % len(payload)
    kind = "response" if refers_to is None else "revisit"
    if refers_to is None:
        block += payload
    uri = quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else record_id(page_id)[1:-1]
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def page_id(self) -> int | None:
        return page_of(self.headers["warc-record-id"])

    @property
    def refers_to(self) -> int | None:
        return page_of(self.headers["warc-refers-to"]) if "warc-refers-to" in self.headers else None

    def payload(self) -> tuple[int, bytes]:
        """The payload's full length by the HTTP headers, and what the record has of it."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        if not length:
            raise DamagedArchive("no length in the HTTP headers")
        return int(length[1]), body


def _members(read, place: str) -> Iterator[bytes]:
    """What each gzip member holds, inflated step by step."""
    data, inflate, parts, at = read(READ_BYTES), None, [], 0
    while data or inflate:
        if not data:
            raise DamagedArchive(f"{place}: ends within a record at byte {at}")
        if inflate is None:
            inflate, parts = zlib.decompressobj(31), []
        try:
            parts.append(inflate.decompress(data))
        except zlib.error as error:
            raise DamagedArchive(f"{place}: {error} near byte {at}") from error
        at += len(data) - len(inflate.unused_data)
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate = None
        data = data or read(READ_BYTES)


def records(read, place: str = "archive") -> Iterator[Record]:
    """The records of an archive, in order. ``read(n)`` gives its next bytes."""
    for member in _members(read, place):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or not gap or not length.isdigit():
            raise DamagedArchive(f"{place}: no WARC headers")
        n = int(length)
        if rest[n:] != b"\r\n\r\n":
            raise DamagedArchive(f"{place}: the block of {headers.get('warc-record-id')} is not {n} bytes long")
        yield checked(Record(headers, rest[:n]), place)


def checked(found: Record, place: str) -> Record:
    """The record, if its digests are those of its bytes."""
    named = found.headers.get("warc-block-digest")
    if named and named != "sha1:" + digest(found.block):
        raise DamagedArchive(f"{place}: block digest of {found.headers['warc-record-id']} is wrong")
    if found.headers["warc-type"] == "response":
        length, body = found.payload()
        if length != len(body) or found.headers["warc-payload-digest"] != "sha1:" + digest(body):
            raise DamagedArchive(f"{place}: payload digest of {found.headers['warc-record-id']} is wrong")
    return found


def with_originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, original): the page that this one repeats, or null.

    Groups of equal payloads are found by their digests, pre-aggregated before the
    shuffle; the pages then meet one row per repeated digest, in a join that adaptive
    execution splits where one payload holds many pages."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("sha", F.when(F.octet_length("html") >= least, F.sha1("html")))
    repeated = rows.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and sha is not null")
    original = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(repeated.select("sha", "last"), "sha", "left").select("page_id", "url", "html", original.alias("original"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 4) -> DataFrame:
    """Writes one archive per task; the table (file, records, bytes) of those that count."""

    def write(batches):
        name = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz"
        store, path = located(name)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        count = size = 0
        with store.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html.encode()
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(page_id, url, payload, digest(payload), original)) + squeeze.flush()
                    out.write(member)
                    count, size = count + 1, size + len(member)
        if count:
            yield pa.RecordBatch.from_pylist([{"file": name, "records": count, "bytes": size}])
        else:
            store.delete_file(path)

    return materialize(with_originals(pages, least).mapInArrow(write, MANIFEST))


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the listed archives (column ``file``), payloads included; of a
    revisit the payload is null, its length and digest are those of the whole payload."""

    def read(batches):
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = located(name)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for r in records(source.read, name):
                        length, body = r.payload()
                        kind = r.headers["warc-type"]
                        sha1 = r.headers["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((r.page_id, length, sha1, kind, r.refers_to, r.headers["warc-target-uri"], body if kind == "response" else None))
                        held += len(body) + 500
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    spread = files.select("file").repartition(max(1, files.count()), "file")
    return spread.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    return read_archives(write_archives(pages, scratch_path(pages.sparkSession, "warc"), least))
