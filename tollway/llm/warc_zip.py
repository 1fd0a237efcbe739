"""WARC records in ZIP archives, written and read by ranges.

An archive is a ZIP file with stored (not deflated) members: ``archive/pages.warc.gz`` holds one gzip
member per record, ``indexes/pages.cdxj`` one line per record with its place in it.  The reader takes the
central directory from the archive's end (ZIP64 where the sizes ask for it), finds the two members and
reads only byte ranges: the index, then runs of neighbouring records.  Nothing is extracted.

A page whose payload of at least ``LEAST_BYTES`` also occurs under a smaller page_id is a revisit record,
which names that page and has no payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollway.llm.common import map_slices, materialize
from tollway.session import scratch_path

LEAST_BYTES = 100
#: Bytes of records after which a task begins the next archive, and bytes that the reader asks for at a time.
ARCHIVE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
RECORDS, INDEX = "archive/pages.warc.gz", "indexes/pages.cdxj"
_DATE = "2020-01-01T00:00:00Z"


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, role and refers_to of every page.

    A null html is an empty payload.  Null page_ids are never referred to; rows that share the smallest
    page_id are all responses.  Only digests are grouped; pages are joined with those that repeat.
    """

    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    again = rows.filter(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(materialize(again, "payloads"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.select("page_id", "url", "payload", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("role"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, size: int, role: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit's block is the response's head without its payload."""

    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if role == "response":
        block += payload
    fields = [
        ("WARC-Type", role), ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}>"), ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c for c in url or "urn:none" if c >= " ")), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if role == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """page_id, payload bytes, digest, role and refers_to of one record; a payload that does not fit its digest is an error."""

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record ends before its length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda urn: None if urn == "<urn:page:none>" else int(urn.removeprefix("<urn:page:").rstrip(">"))
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't fit its digest")
    refers = fields.get("WARC-Refers-To")
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], number(refers) if refers else None


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Archive:
    """One archive that is being written: records go straight to the store, the index and directory follow at the end."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.lines, self.at = path, [], 0
        self.file = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(RECORDS, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, page_id, packed: bytes) -> None:
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(packed)}))
        self.member.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (2020, 1, 1, 0, 0, 0)), "w") as f:
            f.write("\n".join(self.lines).encode())
        self.zip.close()
        self.file.close()
        return self.path, len(self.lines), self.at


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives and returns their list (path, records, bytes).

    Each attempt of a task writes files of its own name, and only those that the list names are ever read,
    so a task that is repeated leaves no record twice.
    """


    def run(batches):
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        archive, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "role", "refers_to")), strict=True):
                if archive is None:
                    archive = Archive(store, f"{base}/{uuid.uuid4().hex}.wacz")
                raw = record(row[0], row[1], row[2].encode("utf-8", "replace"), *row[3:])
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                archive.add(row[0], pack.compress(raw) + pack.flush())
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialize(roles(pages).mapInArrow(run, "path string, records long, bytes long"), "archives")


def _member_place(raw: bytes, at: int) -> tuple[str, int, int, int, int]:
    """Name, method, stored size and header place of the central directory's entry at a place, and where the next begins."""

    sign, _, _, _, method, _, _, _, packed, size, name, extra, comment, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
    if sign != 0x02014B50:
        raise ValueError("no central directory entry where one should be")
    text = raw[at + 46 : at + 46 + name].decode()
    fields, stop = at + 46 + name, at + 46 + name + extra
    while fields + 4 <= stop:
        kind, length = struct.unpack_from("<HH", raw, fields)
        if kind == 1:  # ZIP64: 8 bytes for each value that does not fit above, in this order
            wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, fields + 4))
            size = next(wide) if size == 0xFFFFFFFF else size
            packed = next(wide) if packed == 0xFFFFFFFF else packed
            header = next(wide) if header == 0xFFFFFFFF else header
        fields += 4 + length
    return text, method, packed, header, stop + comment


def directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Place and size of the bytes of every stored member, by name, from the central directory."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive: no end record")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        place = struct.unpack_from("<Q", tail, locator + 8)[0]
        record64 = read(place, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where the locator points")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    raw, at, out = read(start, length), 0, {}
    for _ in range(count):
        name, method, packed, header, at = _member_place(raw, at)
        if method == 0:
            local = read(header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            n, extra = struct.unpack_from("<HH", local, 26)
            out[name] = (header + 30 + n + extra, packed)
    return out


def ranges(lines: list[dict]) -> Iterator[list[dict]]:
    """Neighbouring records whose bytes are read at once."""

    run: list[dict] = []
    for line in sorted(lines, key=lambda x: x["offset"]):
        if run and (line["offset"] != run[-1]["offset"] + run[-1]["length"] or line["offset"] + line["length"] - run[0]["offset"] > RANGE_BYTES):
            yield run
            run = []
        run.append(line)
    if run:
        yield run


def records(file, size: int, wanted: set | None = None) -> Iterator[tuple]:
    """Parsed records of an archive, or only those of some page_ids."""

    members = directory(file, size)
    index = [(start, n) for name, (start, n) in members.items() if name.startswith("indexes/")]
    base = members[RECORDS][0]
    for start, n in index:
        file.seek(start)
        lines = [json.loads(x) for x in file.read(n).decode().splitlines()]
        for run in ranges([x for x in lines if wanted is None or x["page_id"] in wanted]):
            file.seek(base + run[0]["offset"])
            raw = file.read(run[-1]["offset"] + run[-1]["length"] - run[0]["offset"])
            for line in run:
                at = line["offset"] - run[0]["offset"]
                yield parse(zlib.decompress(raw[at : at + line["length"]], 31))


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """A row per record of the listed archives; each is read by ranges in one task."""

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        store, _ = open_folder(folder)
        for some in batches:
            for path in some.column("path").to_pylist():
                rows: list[tuple] = []
                with store.open_input_file(path) as file:
                    for row in records(file, file.size(), None if wanted is None else set(wanted)):
                        rows.append(row)
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    n = max(1, archives.count())
    return archives.select("path").repartition(n, "path").mapInArrow(run, SCHEMA)


def write_and_read(pages: DataFrame) -> DataFrame:
    """Digest columns of every page, as read back from the archives.

    Null and empty html have an empty payload; every row, repeated or not, has a record of its own.
    Further columns are not read; an empty table gives no archive and no rows.
    """

    spark: SparkSession = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read(write(pages, folder), folder)
