"""WARC archives with revisit resolution.

1. `write_raw`: each task writes the pages that it reads as response records, one gzip member
   per record, and returns their headers (page, digest, size, file, offset). The block of a record
   is an HTTP message whose body is the payload.
2. `resolve`: headers are shuffled by payload digest. Of records with equal payloads of at
   least `least_bytes` bytes the one with the largest page id is the response; the others are
   joined to it as revisits. Payloads are not shuffled.
3. `write_deduplicated`: headers return to the file that they came from; a task copies its
   responses and writes the revisits as header-only records, all with fresh headers.
4. `read`: streams the records of the archives back.

Files have names of their own in the shared folder and count only if the manifest lists
them, so repeated tasks leave no trace.

Defined cases: a null html is an empty payload; empty and short payloads are responses; of
rows that share page id and payload one is the response and the others revisit it; null page
ids rank lowest; an empty table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, staged
from .tokenfile import files_over_tasks, open_fs

#: Bytes of an archive after which a task begins the next one.
ARCHIVE = 256_000_000
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id, digest: str, path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{path.rpartition("/")[2]}|{offset}')}>"


def record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


#: Content-Type of records whose block is an HTTP message.
MESSAGE = ("Content-Type", "application/http;msgtype=response")


def http_head(size: int) -> bytes:
    """Head of the HTTP message that holds a page of `size` bytes."""
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def payload_of(block: bytes) -> bytes:
    """What an HTTP message holds behind its head."""
    return block.partition(b"\r\n\r\n")[2]


def stated(digest: str) -> tuple[str, str]:
    return "WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


class Archive:
    """Archive files of one task; the next one begins when one is full."""

    def __init__(self, folder: str) -> None:
        self.folder, self.out, self.uri, self.size, self.records = folder, None, "", 0, 0

    def add(self, data: bytes) -> tuple[str, int]:
        """Where the record went: file and offset."""
        if self.out is None:
            self.uri = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            fs, path = open_fs(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.size, self.records = fs.open_output_stream(path, compression=None), 0, 0
        at = self.size
        self.out.write(data)
        self.size += len(data)
        self.records += 1
        return self.uri, at

    def full(self) -> bool:
        return self.out is not None and self.size >= ARCHIVE

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


HEADERS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def write_raw(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        archive = Archive(folder)
        for b in batches:
            rows = []
            for page, url, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)), stated(digest), MESSAGE]
                data = record(fields, http_head(len(payload)) + payload, 1)
                path, at = archive.add(data)
                rows.append((page, url, digest, len(payload), path, at, len(data)))
                if archive.full():
                    archive.close()
            if rows:
                yield _batch(rows, HEADERS)
        archive.close()

    return staged(base.mapInArrow(run, "page_id long, url string, digest string, payload_bytes long, path string, at long, size long"), "warc-headers")


def resolve(headers: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Headers plus `original` (page_id, url, path, at of the response), null for responses."""
    large = F.col("payload_bytes") >= least_bytes
    top = F.max(F.struct("page_id", "path", "at", "url")).alias("original")
    firsts = headers.where(large).groupBy("digest").agg(top, F.count("*").alias("n")).where("n > 1").drop("n")
    itself = (F.col("original.path") == F.col("path")) & (F.col("original.at") == F.col("at"))
    found = headers.where(large).join(firsts, "digest", "left").withColumn("original", F.when(~itself, F.col("original")))
    none = F.lit(None).cast(found.schema["original"].dataType)
    return found.unionByName(headers.where(~large).withColumn("original", none))


def write_deduplicated(resolved: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Manifest (path, records) of the deduplicated archives."""
    rows = resolved.select("page_id", "url", "digest", "payload_bytes", "path", "at", "size", F.col("original").isNotNull().alias("revisit"), F.col("original.page_id").alias("o_page"), F.col("original.url").alias("o_url"), F.col("original.path").alias("o_path"), F.col("original.at").alias("o_at"))
    ordered = rows.repartition(tasks, "path").sortWithinPartitions("path", "at")
    made = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        archive, opened, source = Archive(folder), "", None
        for b in batches:
            for r in b.to_pylist():
                page = "" if r["page_id"] is None else str(r["page_id"])
                fields = [("WARC-Record-ID", record_id(r["page_id"], r["digest"], r["path"], r["at"])), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(r["url"])), stated(r["digest"]), MESSAGE, ("X-Page-Id", page)]
                if r["revisit"]:
                    fields = [("WARC-Type", "revisit"), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["o_page"], r["digest"], r["o_path"], r["o_at"])), ("WARC-Refers-To-Target-URI", one_line(r["o_url"])), ("WARC-Refers-To-Date", DATE)]
                    fields += [("X-Refers-To-Page-Id", "" if r["o_page"] is None else str(r["o_page"])), ("X-Payload-Length", str(r["payload_bytes"]))]
                    block = http_head(r["payload_bytes"])
                else:
                    if opened != r["path"]:
                        fs, path = open_fs(r["path"])
                        opened, source = r["path"], fs.open_input_file(path)
                    source.seek(r["at"])
                    whole = zlib.decompress(source.read(r["size"]), 31)
                    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
                    if hashlib.sha1(payload_of(block)).hexdigest() != r["digest"]:
                        raise ValueError(f"the record at {r['at']} of {r['path']} is damaged")
                    fields = [("WARC-Type", "response"), *fields]
                archive.add(record(fields, block, 3))
                if archive.full():
                    archive.close()
                    yield _batch([(archive.uri, archive.records)], made)
        if archive.out is not None:
            archive.close()
            yield _batch([(archive.uri, archive.records)], made)

    return staged(ordered.mapInArrow(run, "path string, records long"), "warc-manifest")


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive, one at a time."""
    import gzip

    fs, path = open_fs(uri)
    with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"{uri}: a record should begin here, not {line[:40]!r}")
            fields = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                k, _, v = line.decode().partition(": ")
                fields[k] = v
            n = int(fields["Content-Length"])
            block = f.read(n)
            if len(block) != n or f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record is cut short")
            yield fields, block


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives; size and digest of a response come from its payload."""

    def run(batches):
        number = lambda x: int(x) if x else None
        for b in batches:
            for uri in b.column("path").to_pylist():
                rows = []
                for f, block in records(uri):
                    kind, payload = f["WARC-Type"], payload_of(block)
                    said = int(f.get("X-Payload-Length", 0)), base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    size, digest = (len(payload), hashlib.sha1(payload).hexdigest()) if kind == "response" else said
                    rows.append((number(f["X-Page-Id"]), f["WARC-Target-URI"], size, digest, kind, number(f.get("X-Refers-To-Page-Id"))))
                    if len(rows) >= 20_000:
                        yield _batch(rows, READ)
                        rows = []
                if rows:
                    yield _batch(rows, READ)

    return manifest.select("path").repartition(files_over_tasks(manifest), "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, deduplicate and read back all pages."""
    folder = new_folder(pages.sparkSession, "warc")
    headers = write_raw(pages, f"{folder}/raw", id_col, url_col, html_col)
    tasks = files_over_tasks(headers.select("path").distinct())
    return read(write_deduplicated(resolve(headers, least_bytes), f"{folder}/archive", tasks))
