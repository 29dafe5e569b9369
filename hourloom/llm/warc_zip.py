"""WARC records in ZIP packages, read back by ranges.

Each package is a ZIP of stored (not deflated) members: ``archive/data.warc.gz`` holds the WARC
records, one gzip member each, and ``indexes/index.cdxj`` one JSON line per record with its
offset and length. The reader takes the end of the file, follows the central directory (ZIP64
included) to the members, reads the index and then only the byte ranges of records; nothing is
extracted. Packages are cut into jobs of consecutive records, so a large package is shared by
many tasks.

Files are opened by URI through ``pyarrow.fs``, so packages may lie in any store that it knows.
A package is written under a task-attempt name and renamed when complete.

Defined results: a null payload is written as an empty one. Records of equal payloads of at
least ``min_revisit_bytes`` become one response (the smallest id) and revisits. Rows need
distinct ids: repeated ids are an error of the input and give one record per row, each
referring to the smallest id. Null ids are dropped by the writer, as a record must have one.
An empty table gives no package and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import as_bytes, slices, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS_PER_JOB = 2000
# One date for all records: the content, not the run, decides the bytes.
DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits are 32 groups of five bits."""
    hexed = F.sha1(payload)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for part in range(4):  # 10 hex digits = 40 bits = 8 letters
        value = F.conv(F.substring(hexed, 10 * part + 1, 10), 16, 10).cast("bigint")
        for k in range(7, -1, -1):
            at = F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1
            letters.append(F.substring(F.lit(alphabet), at, F.lit(1)))
    return F.concat(*letters)


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {(url or '').splitlines()[0] if url else ''}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if refers_to is not None else http + payload
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of one record: type, ids, digest, and the payload's length and bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": int(fields["WARC-Record-ID"].strip("<>").rpartition(":")[2]),
        "url": fields.get("WARC-Target-URI", "").strip(), "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2],
        "refers_to": int(refers.strip("<>").rpartition(":")[2]) if refers else None,
        "payload_bytes": stated, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and inner path of a URI; ``file:/x`` as Hadoop writes it is a local path."""
    return fs.FileSystem.from_uri(uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def deduplicated(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """Pages with digest and the id they refer to. Payloads never travel by digest, so a payload that
    a third of all pages share gathers nowhere: only (digest, smallest id) does, combined map-side."""
    rows = pages.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digested = rows.withColumn("digest", digest_of(F.col("payload")))
    small = written(digested.where(F.octet_length("payload") >= min_revisit_bytes).select("page_id", "digest"), "page-digests")
    # Written, so that the join below is of two plain tables and a hot digest can be split.
    first = written(small.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id"), "first-pages")
    refers = (small.join(first, "digest").where("page_id > first_id")
              .select("page_id", F.col("first_id").alias("refers_to")).distinct())
    return digested.join(refers, "page_id", "left")


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *,
                   packages: int | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write one package per partition below ``folder``; returns (path, records) of each.

    Lazy, and each run writes packages of its own: write the list once and read from it.

    Pages are spread by a hash of their id; the exchange of the join on the id is reused.
    """
    ready = deduplicated(pages, id_col, url_col, payload_col, min_revisit_bytes)
    if packages:
        ready = ready.repartition(packages, "page_id")
    columns = ready.select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        store.create_dir(base, recursive=True)
        file = f"package-{uuid.uuid4().hex}.zip"
        name = f"{base.rstrip('/')}/{file}"
        index, at, records = [], 0, 0
        out = target = member = None
        for batch in slices(batches, column=2):
            payloads = as_bytes(batch.column(2))
            rows = zip(*(batch.column(k).to_pylist() for k in (0, 1)), payloads, *(batch.column(k).to_pylist() for k in (3, 4)))
            for page_id, url, payload, digest, refers_to in rows:
                if out is None:
                    target = store.open_output_stream(name + ".part")
                    out = zipfile.ZipFile(target, "w", zipfile.ZIP_STORED)
                    member = out.open(ARCHIVE, "w", force_zip64=True)
                data = gzip.compress(record(page_id, url, payload, digest, refers_to), 3, mtime=0)
                member.write(data)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}))
                at += len(data)
                records += 1
        if out is None:
            return
        member.close()
        out.writestr(INDEX, "\n".join(index))
        out.close()
        target.close()
        store.move(name + ".part", name)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{file}"], "records": [records]})

    return columns.mapInArrow(run, "path string, records bigint")


def stored_members(source) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, size) of the stored members of an open, seekable ZIP file."""
    source.seek(0, io.SEEK_END)
    size = source.tell()
    start = max(0, size - 65_557 - 20)  # end record, longest comment and the ZIP64 locator
    source.seek(start)
    tail = source.read(size - start)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
        locator = tail.rfind(b"PK\x06\x07", 0, end)
        if locator < 0:
            raise ValueError("ZIP64 sizes without a ZIP64 locator")
        source.seek(struct.unpack_from("<Q", tail, locator + 8)[0])
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end of central directory")
        count, length, offset = struct.unpack_from("<QQQ", wide, 32)
    source.seek(offset)
    directory = source.read(length)
    members: dict[str, tuple[int, int]] = {}
    at = 0
    for _ in range(count):
        if directory[at:at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        where = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit values stand only for the fields that are all ones, in this order
                wide = io.BytesIO(extra[4:4 + n])
                full, packed, where = (struct.unpack("<Q", wide.read(8))[0] if v == 0xFFFFFFFF else v for v in (full, packed, where))
            extra = extra[4 + n:]
        if method == 0:
            source.seek(where)
            local = source.read(30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            n_local, n_more = struct.unpack_from("<HH", local, 26)
            members[name] = (where + 30 + n_local + n_more, packed)
        at += 46 + n_name + n_extra + n_comment
    return members


def read_packages(spark: SparkSession, packages: DataFrame, *, records_per_job: int = RECORDS_PER_JOB, with_payload: bool = True) -> DataFrame:
    """All records of the packages listed by (path, records).

    Jobs of ``records_per_job`` consecutive records are dealt to tasks; each opens its package,
    reads the directory and index and then one byte range, decompressing record by record.
    """
    jobs = packages.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("records") - 1, F.lit(0)),
                                                        F.lit(records_per_job).cast("bigint"))).alias("first"))
    tasks = max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = ["page_id", "url", "record_type", "payload_digest", "refers_to", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = _opened(path)
                with store.open_input_file(inner) as source:
                    members = stored_members(source)
                    at, size = members[INDEX]
                    source.seek(at)
                    entries = [json.loads(x) for x in source.read(size).split(b"\n")[first:first + records_per_job] if x]
                    base = members[ARCHIVE][0]
                    held, out = 0, []
                    for entry in entries:
                        source.seek(base + entry["offset"])
                        fields = parsed(gzip.decompress(source.read(entry["length"])))
                        payload = fields["payload"]
                        if payload is not None:
                            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if found != fields["payload_digest"] or len(payload) != fields["payload_bytes"]:
                                raise ValueError(f"record {fields['page_id']} of {path}: payload does not match its digest")
                        if not with_payload:
                            fields["payload"] = None
                        held += len(payload or b"")
                        out.append(fields)
                        if held > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names)
                            held, out = 0, []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names)

    return jobs.repartition(tasks, F.col("path"), F.col("first")).mapInArrow(
        run, "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, payload binary")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
x AS (SELECT d.*, first_id FROM d JOIN f USING (h)),
bits AS (SELECT *, list_transform(generate_series(0, 3), lambda q: ('0x' || substr(h, 10 * q + 1, 10))::BIGINT) AS parts FROM x)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((parts[j // 8 + 1] >> (5 * (7 - j % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits"""
