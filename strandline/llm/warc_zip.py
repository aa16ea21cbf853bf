"""WARC records in ZIP packages, and a reader that fetches records by byte ranges.

Writing: each task packs its pages as gzip-compressed WARC records into stored ZIP members, with an index member of record
offsets beside each, and rolls to a new archive at ``ARCHIVE_BYTES``. Pages with equal payloads are found by digests: the one
with the largest id is written as response, the others as revisits of it, without their payload. Archives go to the shared
folder under names of their own for each attempt; the table of archives, written by Spark when the tasks commit, names
those that count, so a task that ran twice does no harm.

Reading: the end record, the ZIP64 records where there are any, and the central directory give the members of an archive; a
stored member's local header gives where its bytes begin. A member's index is read as one range and its records in ranges of
at most ``RANGE_BYTES``; nothing is extracted. Members, not archives, are the unit of work.

Defined cases: null pages are empty; an empty table gives no archives; rows with the same id and payload as the response
are responses too; a null id is smaller than any other; archives may hold other members, which are passed over; line
breaks and other control characters in a URL are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, small

ARCHIVE_BYTES = 64 << 20
MEMBER_BYTES = 8 << 20
RANGE_BYTES = 4 << 20
SMALL_GROUPS = 200_000
MOST_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


# ---- writing ----------------------------------------------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Packer:
    """Appends records to ZIP archives in ``folder``, a URI that pyarrow's file systems know."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name, self.number, self.zip, self.done = name, 0, None, []
        self.buffer, self.index = bytearray(), []

    def add(self, data: bytes, entry: dict) -> None:
        packed = gzip.compress(data, 3, mtime=0)
        self.index.append(json.dumps(entry | {"offset": len(self.buffer), "length": len(packed)}))
        self.buffer += packed
        if len(self.buffer) >= MEMBER_BYTES:
            self.member()

    def member(self) -> None:
        if self.zip is None:
            self.path = f"{self.folder}/{self.name}-{self.number:04d}.zip"
            self.stream = self.files.open_output_stream(self.path)
            self.zip, self.members, self.bytes, self.records = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED), 0, 0, 0
            self.number += 1
        name = f"data-{self.members:05d}"
        self.zip.writestr(f"archive/{name}.warc.gz", bytes(self.buffer))
        self.zip.writestr(f"indexes/{name}.cdxj", "\n".join(self.index))
        self.members, self.bytes, self.records = self.members + 1, self.bytes + len(self.buffer), self.records + len(self.index)
        self.buffer, self.index = bytearray(), []
        if self.bytes >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.index:
            self.member()
        if self.zip is not None:
            self.zip.close()
            self.stream.close()
            self.done.append((self.path.rsplit("/", 1)[1], self.records))
            self.zip = None


def _write_task(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = Packer(folder, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}")
    for batch in batches:
        for page_id, url, payload, size, sha1, kind, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "kind", "refers_to"))):
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            packer.add(record(page_id, url, payload, size, digest, kind, refers_to), {"id": page_id, "type": kind})
    packer.close()
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in packer.done], pa.string()), pa.array([d[1] for d in packer.done], pa.int64())], names=["archive", "records"])


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload size and digest, ``kind`` and ``refers_to``; payloads under ``least`` bytes are all responses."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.cast("binary").alias("payload"), F.octet_length(payload).cast("bigint").alias("size"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("content"))
    groups = rows.where(F.col("size") >= least).groupBy("content").agg(F.count("*").alias("pages"), F.max("page_id").alias("top")).where("pages > 1 and top is not null").select("content", "top")
    met = rows.join(small(groups, SMALL_GROUPS), "content", "left")
    repeats = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    kept = F.when(~repeats, F.col("payload"))
    return met.select("page_id", "url", kept.alias("payload"), "size", "sha1", F.when(repeats, "revisit").otherwise("response").alias("kind"), F.when(repeats, F.col("top")).alias("refers_to"))


def uri(path: str) -> str:
    """A path of Spark's as a URI with a scheme."""
    return f"file://{path}" if path.startswith("/") else path


def write(pages: DataFrame, shared: Shared, name: str, least: int = 0) -> DataFrame:
    """Write the archives of ``pages`` below the shared folder; returns ``(archive, records)`` of those that count."""
    folder = uri(shared.path(f"{name}-archives"))
    made = classified(pages, least).mapInArrow(lambda b: _write_task(folder, b), "archive string, records bigint")
    return shared.write(made, f"{name}-list").withColumn("folder", F.lit(folder))


# ---- reading ----------------------------------------------------------------------------------------------------

Read = Callable[[int, int], bytes]


def end_of_directory(read: Read, size: int) -> tuple[int, int, int]:
    """Entries, length and offset of the central directory of an archive of ``size`` bytes."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        locator = read(tail_at + at - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            entries, length, offset = struct.unpack_from("<QQQ", record64, 32)
    return entries, length, offset


def directory(read: Read, size: int) -> dict[str, tuple[int, int, int]]:
    """``name -> (method, size in the archive, offset of the local header)`` of all members."""
    entries, length, offset = end_of_directory(read, size)
    data, at, out = read(offset, length), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain = struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # 64-bit values, only of the fields that are full, in this order
                values = list(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                plain = values.pop(0) if plain == 0xFFFFFFFF else plain
                packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                header = values.pop(0) if header == 0xFFFFFFFF else header
            i += 4 + n
        out[name] = (method, packed, header)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_offset(read: Read, header: int) -> int:
    local = read(header, 30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    return header + 30 + sum(struct.unpack_from("<HH", local, 26))


def parse(data: bytes) -> dict:
    """Headers and payload of one WARC record, plain or gzip-compressed."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError("payload and digest differ")
    number = lambda name: headers.get(name, "").removeprefix("<urn:page:").removesuffix(">") or None
    return {"page_id": number("warc-record-id"), "url": headers.get("warc-target-uri"), "bytes": sizes[0], "digest": digest, "type": kind, "refers_to": number("warc-refers-to"), "payload": payload if kind == "response" else None}


def _member_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives to their pairs of stored WARC and index members."""
    for batch in batches:
        rows = []
        for folder, archive in zip(batch.column("folder").to_pylist(), batch.column("archive").to_pylist()):
            files, root = fs.FileSystem.from_uri(folder)
            with files.open_input_file(f"{root}/{archive}") as file:
                read = lambda at, n, file=file: file.read_at(n, at)
                members = directory(read, file.size())
                for name, (method, length, header) in members.items():
                    index = members.get(f"indexes/{name.removeprefix('archive/').split('.warc')[0]}.cdxj")
                    if name.startswith("archive/") and ".warc" in name and index:
                        if method or index[0]:
                            raise ValueError(f"{archive}: {name} is compressed in the archive")
                        rows.append((folder, archive, data_offset(read, header), length, data_offset(read, index[2]), index[1]))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["folder", "archive", "at", "length", "index_at", "index_length"])


def ranges(entries: list[dict], most: int = RANGE_BYTES) -> Iterator[list[dict]]:
    """Index entries in runs that lie side by side and are read together."""
    run: list[dict] = []
    for entry in sorted(entries, key=lambda e: e["offset"]):
        if run and (entry["offset"] != run[-1]["offset"] + run[-1]["length"] or entry["offset"] + entry["length"] - run[0]["offset"] > most):
            yield run
            run = []
        run.append(entry)
    if run:
        yield run


def _record_task(payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "bytes", "digest", "type", "refers_to", *(["payload"] if payload else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)
    for batch in batches:
        for folder, archive, at, length, index_at, index_length in zip(*(batch.column(c).to_pylist() for c in ("folder", "archive", "at", "length", "index_at", "index_length"))):
            files, root = fs.FileSystem.from_uri(folder)
            with files.open_input_file(f"{root}/{archive}") as file:
                entries = [json.loads(x) for x in file.read_at(index_length, index_at).decode().split("\n") if x]
                for run in ranges(entries):
                    begin = run[0]["offset"]
                    data = file.read_at(run[-1]["offset"] + run[-1]["length"] - begin, at + begin)
                    found = [parse(data[e["offset"] - begin : e["offset"] - begin + e["length"]]) for e in run]
                    columns = [[number(r[n]) if n in ("page_id", "refers_to") else r[n] for r in found] for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def read(archives: DataFrame, shared: Shared, name: str, payload: bool = False) -> DataFrame:
    """The records of the archives listed in ``(folder, archive)``, with their payloads if asked for."""
    members = archives.select("folder", "archive").mapInArrow(_member_task, "folder string, archive string, at bigint, length bigint, index_at bigint, index_length bigint")
    members = shared.write(members, f"{name}-members")
    # A row stands for megabytes of records: a task for each member, however small the rows are.
    tasks = min(max(members.count(), 1), MOST_TASKS)
    schema = "page_id bigint, url string, bytes bigint, digest string, type string, refers_to bigint" + ", payload binary" * payload
    return members.repartition(tasks, "archive", "at").mapInArrow(lambda b: _record_task(payload, b), schema)


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """The columns of the registered query: what the archives written for ``pages`` give back."""
    shared = Shared(pages.sparkSession)
    found = read(write(pages, shared, "pages", least), shared, "pages")
    return found.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
