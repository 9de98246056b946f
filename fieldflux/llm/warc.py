"""WARC archives: a deterministic sharded writer, and the reader that checks what it reads.

Records are range-sorted by page and written by one task for each range, every record a gzip
member of its own.  A file is closed when its compressed size reaches a limit.  It is written
under a temporary name of the attempt and then renamed to its final name, which follows from the
range, the number within it and the content, so an attempt that is repeated replaces a file by
the same bytes.  The manifest (file, records, bytes, SHA-256) is a table written when all tasks
have ended; readers take files from the manifest alone, so leftovers of lost attempts don't count.

Of records with equal payloads of some size one is a response and the others are revisits
without a payload.  Which is which is found from hashes and ids before the sort, so payloads are
shuffled once; the marks of revisits travel to their records as rows of the same sort.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, partitions, scratch_dir

LEAST, FILE_BYTES = 1000, 64 << 20
DATE = "1970-01-01T00:00:00Z"  # records are dated by content, not by the clock


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder: a local mount, or any that pyarrow knows by its scheme."""
    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record, its headers made anew from what it holds."""
    kind = "response" if refers_to is None else "revisit"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page} {digest} {kind}")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}", f"X-Page-ID: {page}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """Writes the files of one range."""

    def __init__(self, folder: str, part: int, attempt: str, limit: int):
        self.fs, self.top = _open(folder)
        self.part, self.attempt, self.limit, self.number, self.out = part, attempt, limit, 0, None

    def add(self, data: bytes) -> dict | None:
        """The finished file if it is full now."""
        if self.out is None:
            self.temp = f"{self.top}/.{self.part:06d}-{self.number:04d}-{self.attempt}.tmp"
            self.out, self.sha, self.bytes, self.records = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.bytes += len(packed)
        self.records += 1
        return self.close() if self.bytes >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        sha = self.sha.hexdigest()
        name = f"part-{self.part:06d}-{self.number:04d}-{sha[:16]}.warc.gz"
        self.fs.move(self.temp, f"{self.top}/{name}")
        self.out, self.number = None, self.number + 1
        return {"file": name, "records": self.records, "bytes": self.bytes, "sha256": sha}


def _name(page) -> str:
    return "" if page is None else str(page)


def _write(folder: str, limit: int):
    """Rows in order of (page_id, key, html): a row without html marks the revisit of the
    records with that page and key that follow it."""

    def work(batches: Iterator[pa.RecordBatch]):
        task = TaskContext.get()
        files = _Files(folder, task.partitionId(), f"{task.taskAttemptId()}", limit)
        mark, seen, done = None, None, []
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for i in range(b.num_rows):
                page, key, html, url, keep, own = (c[i].as_py() for c in cols)
                if html is None:
                    # Other records of this page with the payload refer to the kept one too; where
                    # the kept one is this page itself, its first record is the response.
                    mark = (page, key, keep, own)
                    continue
                refers = None
                if mark and mark[:2] == (page, key):
                    refers = None if mark[3] and seen != (page, key) else _name(mark[2])
                seen = (page, key)
                got = files.add(record(_name(page), url or "", html, hashlib.sha1(html).hexdigest(), refers))
                done += [got] if got else []
        got = files.close()
        done += [got] if got else []
        yield pa.RecordBatch.from_pylist(done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return work


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages' records to the shared folder and returns the manifest, which is stored
    there too.  See `archive` for what becomes of nulls and ties."""
    spark = pages.sparkSession
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    # Payloads are equal where their SHA-256 is; SHA-1 is what the archive format writes.
    rows = rows.withColumn("key", F.sha2("html", 256))
    slim = rows.where(F.octet_length("html") >= least).select("page_id", "key")
    groups = slim.groupBy("key").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "keep")
    marks = slim.join(groups, "key").distinct()
    none_b, none_s = F.lit(None).cast("binary"), F.lit(None).cast("string")
    both = rows.select("page_id", "key", "html", "url", F.lit(None).cast("long").alias("keep"), F.lit(None).cast("boolean").alias("own")).union(
        marks.select("page_id", "key", none_b, none_s, "keep", F.col("page_id").eqNullSafe(F.col("keep")))
    )
    ordered = both.repartitionByRange(partitions(spark), "page_id", "key").sortWithinPartitions("page_id", "key", F.col("html").isNotNull(), "url")
    done = mapped(ordered, _write(folder, file_bytes), "file string, records long, bytes long, sha256 string")
    done.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def members(stream) -> Iterator[bytes]:
    """The records of a file, one after the other."""
    inflate, out = zlib.decompressobj(31), []
    data = stream.read(1 << 20)
    while data:
        out.append(inflate.decompress(data))
        data = inflate.unused_data
        if inflate.eof:
            yield b"".join(out)
            inflate, out = zlib.decompressobj(31), []
        if not data:
            data = stream.read(1 << 20)
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block), checked by length and block digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0][:40]}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha1:{hashlib.sha1(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError("a record's block differs from its headers")
    return headers, block


def _read(folder: str, with_html: bool):
    def work(batches: Iterator[pa.RecordBatch]):
        fs, top = _open(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["html"] * with_html]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.string()] * with_html]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        number = lambda x: int(x) if x else None
        for b in batches:
            for file, count in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                with fs.open_input_stream(f"{top}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        h, block = parse(raw)
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                        response = h["WARC-Type"] == "response"
                        if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{file}: a payload differs from its digest")
                        row = [number(h["X-Page-ID"]), size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page")), h["WARC-Target-URI"]]
                        rows.append(dict(zip(names, [*row, *[payload.decode() if response else None] * with_html], strict=True)))
                        n += 1
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if n != count:
                    raise ValueError(f"{file} holds {n} records; the manifest says {count}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return work


def read_archives(manifest: DataFrame, folder: str, with_html: bool = False) -> DataFrame:
    """The records of the manifest's files; each file is read by one task and checked."""
    files = manifest.select("file", "records").repartition(partitions(manifest.sparkSession), "file")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return mapped(files, _read(folder, with_html), schema + ", html string" * with_html)


def archive(pages: DataFrame, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the pages to a new folder of archives beside the stored tables and reads it back:
    page_id, payload_bytes, payload_digest, record_type, refers_to, url for each row of pages.

    Null html counts as empty, a null url as empty.  Of equal payloads of at least `least` bytes
    the record with the largest page_id is the response; where that page_id is repeated, its
    first record.  A null page_id stays null and comes before all others; if a group has no
    other, its records are a response and revisits that refer to null.  An empty table gives no
    rows; other columns are not read."""
    folder = os.path.join(scratch_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder, least, file_bytes), folder)
