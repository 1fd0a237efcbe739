import hashlib
import io
import zipfile

import pyarrow as pa
from odd import rows_of
from pyspark.sql import functions as F

from tollway.llm import queries, warc_zip

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    payload = [(p, (h or "").encode()) for p, h in rows]
    out = []
    for p, b in payload:
        same = [q for q, c in payload if c == b and q is not None]
        first = min(same, default=None)
        revisit = len(b) >= 100 and first is not None and (p is None or p > first)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_whole_table(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert rows_of(queries.QUERIES["op3_warc_in_zip"](spark, sf_dir)) == expected(rows)


def test_odd_rows(spark):
    long, other = "x" * 200, "é" * 50
    rows = [(3, "u", long), (1, None, long), (2, "u\r\nHost: x", long), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", other), (10, "u", other), (None, "u", other), (None, None, None), (1, "u", long), (11, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    want = expected([(p, h) for p, _, h in rows])
    assert rows_of(warc_zip.write_and_read(pages)) == want
    clash = pages.withColumn("digest", F.lit("x")).withColumn("first", F.lit(1)).withColumn("size", F.lit(2)).withColumn("role", F.lit("r"))
    assert rows_of(warc_zip.write_and_read(clash)) == want
    assert warc_zip.write_and_read(pages.limit(0)).count() == 0


def test_many_archives_and_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 300)
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 500)
    rows = [(i, f"http://{i}", f"page {i % 40} " * 20) for i in range(100)]
    folder = str(tmp_path / "warc")
    archives = warc_zip.write(spark.createDataFrame(rows, SCHEMA).coalesce(2), folder)
    assert archives.count() > 10 and archives.agg(F.sum("records")).first()[0] == 100
    assert rows_of(warc_zip.read(archives, folder)) == expected([(p, h) for p, _, h in rows])
    some = warc_zip.read(archives, "file://" + folder, [3, 77]).collect()
    assert {r.page_id for r in some} == {3, 77}


def test_directories_of_other_writers():
    packed = b"abc" * 1000
    for many in (3, 70_000):  # over 65,535 members need a ZIP64 directory
        file = io.BytesIO()
        with zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as z:
            for i in range(many):
                z.writestr(f"m{i}", b"" if i else packed)
            z.writestr(zipfile.ZipInfo("deflated"), b"zzz" * 99, zipfile.ZIP_DEFLATED)
            z.comment = b"PK a comment at the end"
        found = warc_zip.directory(pa.BufferReader(file.getvalue()), len(file.getvalue()))
        start, size = found["m0"]
        assert len(found) == many and "deflated" not in found and file.getvalue()[start : start + size] == packed
    raw = bytearray(b"PK\x01\x02" + bytes(42))  # an entry whose sizes and place stand in the ZIP64 field
    raw[20:28], raw[42:46], raw[28:30], raw[30:32] = b"\xff" * 8, b"\xff" * 4, (1).to_bytes(2, "little"), (28).to_bytes(2, "little")
    raw += b"a" + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + b"".join(x.to_bytes(8, "little") for x in (2**33, 2**34, 2**35))
    assert warc_zip._member_place(bytes(raw), 0)[:4] == ("a", 0, 2**34, 2**35)


def test_a_damaged_payload_is_found():
    raw = warc_zip.record(4, "u", b"payload", hashlib.sha256(b"other").hexdigest(), 7, "response", None)
    try:
        warc_zip.parse(raw)
    except ValueError as error:
        assert "digest" in str(error)
    else:
        raise AssertionError
