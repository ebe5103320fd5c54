"""A streaming source that follows append-only session files by bytes.

`spark.readStream.format("session_tail").load(root)` lists `<root>/<project>/<session>.jsonl` in every
batch. The offset of a stream is the number of bytes read of each file, always up to the last line
feed; a half-written line waits until its rest is there, so every line comes once. A file is cut into
ranges of `blockBytes`, read by tasks of their own; a line belongs to the range in which it begins.

A file that has shrunk was written anew: it is read from its start, and its rows say so in `restart`, so that what is
kept of the session is replaced. A file that was written anew and is no shorter is not told from one that
was appended to. A deleted file gives nothing; one that comes back after the stream was started anew is read from its
start. An empty or missing root gives no rows; bytes that are no
UTF-8 become replacement characters; blank lines are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, at long, line string, restart boolean"
BLOCK = 32 << 20
#: Bytes that are read at once.
STEP = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [begin, end); `last` is where the batch ends in this file."""

    path: str
    begin: int
    end: int
    last: int
    restart: bool


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def line_end(system: fs.FileSystem, path: str, begin: int, size: int) -> int:
    """Place behind the last line feed in [begin, size), or begin. Reads backwards."""
    with system.open_input_file(path) as f:
        at = size
        while at > begin:
            start = max(begin, at - STEP)
            found = f.read_at(at - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return begin


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.block = options["path"].rstrip("/"), int(options.get("blockbytes", BLOCK))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = _open(self.root)
        files = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for f in files:
            inner = f.path[len(root) :].strip("/")
            if f.type == fs.FileType.File and inner.count("/") == 1 and inner.endswith(".jsonl"):
                known = self.seen.get(inner, 0)
                now[inner] = line_end(system, f.path, known if f.size >= known else 0, f.size)
        self.seen = {**self.seen, **now}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, last in sorted(end.items()):
            begin = start.get(path, 0)
            restart = last < begin
            begin = 0 if restart else begin
            out += [Range(path, b, min(b + self.block, last), last, restart) for b in range(begin, last, self.block)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.root)
        p = partition
        with system.open_input_file(f"{root}/{p.path}") as f:
            at = p.begin
            if at and f.read_at(1, at - 1) != b"\n":  # the line belongs to the range before
                at = self._next(f, at, p.last)
            while at < p.end:
                stop = self._next(f, min(at + STEP, p.end) - 1, p.last)
                yield self._batch(p, at, f.read_at(stop - at, at))
                at = stop

    @staticmethod
    def _next(f, at: int, last: int) -> int:
        """Place behind the first line feed at or after `at`."""
        while at < last:
            found = f.read_at(min(STEP, last - at), at).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += STEP
        return last

    @staticmethod
    def _batch(p: Range, at: int, data: bytes) -> pa.RecordBatch:
        places, lines = [], []
        for line in data.split(b"\n"):
            if line.strip():
                places.append(at)
                lines.append(line.decode("utf-8", "replace"))
            at += len(line) + 1
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([p.path] * n, pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string()), pa.array([p.restart] * n, pa.bool_())], ["path", "at", "line", "restart"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def tail(spark: SparkSession, root: str, block: int = BLOCK) -> DataFrame:
    """Streaming records: session_id, project, at (byte of the line), restart, and the fields of a record.

    Lines that are no JSON object are skipped."""
    from .transcripts import RECORD, shaped

    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("session_tail").option("blockBytes", block).load(root)
    parsed = lines.withColumn("r", F.from_json("line", RECORD, {"columnNameOfCorruptRecord": "corrupt"}))
    good = F.col("line").rlike(r"^\s*\{") & F.col("r").isNotNull() & F.col("r.corrupt").isNull()
    return shaped(parsed.where(good).withColumn("path", F.concat(F.lit("/"), "path")), r"/([^/]+)/([^/]+)\.jsonl$", "main", ["at", "restart"], encoded=False)
