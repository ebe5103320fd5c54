"""Token-id files: independent zstandard frames with a trailing seek table.

A shard holds documents in ascending id order:

* frames: each a zstandard frame of at most FRAME ids (little-endian unsigned 32-bit);
* a skippable frame with the document table: ids, null flags and lengths;
* a skippable frame with the seek table of the zstandard seekable format: per frame its
  compressed size, its size, and the low 32 bits of XXH64 of its content; the file ends with
  the number of frames, a descriptor byte and a magic number.

A reader loads the two tables from the end of the file and decompresses only the frames that
the requested documents lie in; each frame is checked when it is read.

Shards are written by Spark tasks to the shared folder under names of their own; only those
that the manifest lists count, so a repeated task leaves no trace. The order is that of a
range partitioning by id.

Defined cases: null texts give the end id alone; null ids come first; rows of one id are
ordered by the hash of their text; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import new_folder, staged

FRAME = 65_536
#: Ids of a shard, after which a task begins the next one.
SHARD = 64_000_000
# Fixed values of the zstandard seekable format.
SEEK_MAGIC, TABLE_MAGIC, SKIP_SEEK, SKIP_TABLE = 0x8F92EAB1, 0x51AB1E0D, 0x184D2A5E, 0x184D2A50


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, uri: str) -> None:
        import zstandard

        fs, path = open_fs(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.zstd = uri, fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.ids, self.sizes, self.buffer, self.held, self.tokens = [], [], [], 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= FRAME * 4:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        import xxhash

        data, step = b"".join(self.buffer), FRAME * 4
        end = len(data) if last else len(data) - len(data) % step
        for k in range(0, end, step):
            part = data[k : min(end, k + step)]
            packed = self.zstd.compress(part)
            self.out.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.buffer = [data[end:]]
        self.held = len(data) - end

    def close(self) -> None:
        self.flush(last=True)
        table = np.array([0 if x is None else x for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes() + np.array(self.sizes, "<u8").tobytes()
        table = self.zstd.compress(table) + struct.pack("<QI", len(self.ids), TABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table)) + table)
        seek = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_SEEK, len(seek)) + seek)
        self.out.close()


class ShardReader:
    def __init__(self, uri: str) -> None:
        import zstandard

        fs, path = open_fs(uri)
        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        start = size - 9 - 12 * frames
        seek = np.frombuffer(self.at(start, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.offset = np.concatenate(([0], np.cumsum(seek[:, 0])))
        self.place = np.concatenate(([0], np.cumsum(seek[:, 1])))
        self.checks = seek[:, 2]
        table = self.at(int(self.offset[-1]) + 8, start - 8 - int(self.offset[-1]) - 8)
        n, magic = struct.unpack("<QI", table[-12:])
        if magic != TABLE_MAGIC:
            raise ValueError(f"{uri} has no document table")
        raw = self.zstd.decompress(table[:-12], max_output_size=17 * n + 1)
        ids, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.ids = [None if x else int(k) for k, x in zip(ids, null, strict=True)]
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.read_frames = 0

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        data = self.zstd.decompress(self.at(int(self.offset[k]), int(self.offset[k + 1] - self.offset[k])), max_output_size=int(self.place[k + 1] - self.place[k]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} is damaged")
        self.read_frames += 1
        return data

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, start in the shard, ids) of the wanted documents, or of all."""
        have: tuple[int, bytes] = (-1, b"")
        for who, lo, hi in zip(self.ids, (self.starts[:-1] * 4).tolist(), (self.starts[1:] * 4).tolist(), strict=True):
            if wanted is not None and who not in wanted:
                continue
            parts, k = [], int(np.searchsorted(self.place, lo, "right")) - 1
            at = lo
            while at < hi:
                if have[0] != k:
                    have = (k, self.frame(k))
                a = int(self.place[k])
                parts.append(have[1][at - a : hi - a])
                at, k = min(hi, int(self.place[k + 1])), k + 1
            yield who, lo // 4, b"".join(parts)


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write all documents; the manifest has a row per shard: part, shard, uri, n_docs, n_tokens, first_id, last_id."""
    out = folder or new_folder(docs.sparkSession, "token-shards")
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ordered = base.repartitionByRange("_id").sortWithinPartitions("_id", F.xxhash64("_text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, part, shard, w = bpe.encoder(path), TaskContext.get().partitionId(), 0, None

        def row(w, shard):
            w.close()
            cols = [[part], [shard], [w.uri], [len(w.ids)], [w.tokens], [w.ids[0]], [w.ids[-1]]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "shard", "uri", "n_docs", "n_tokens", "first_id", "last_id"])

        for b in batches:
            for who, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if w is None:
                    w = ShardWriter(f"{out}/{part:06d}-{shard:04d}-{uuid.uuid4().hex}.tok.zst")
                w.add(who, enc.encode(text) + end)
                if w.tokens >= SHARD:
                    yield row(w, shard)
                    w, shard = None, shard + 1
        if w is not None:
            yield row(w, shard)

    return staged(ordered.mapInArrow(run, "part int, shard int, uri string, n_docs long, n_tokens long, first_id long, last_id long"), "token-manifest")


def files_over_tasks(manifest: DataFrame, most: int = 4096) -> int:
    """As many tasks as files: a stated number isn't reduced for the few bytes that a list of files has."""
    return min(most, max(1, manifest.count()))


def read(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document in the shards; start counts the ids of all documents before it."""
    before = F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("uri", F.coalesce(before, F.lit(0)).alias("base")).repartition(files_over_tasks(manifest), "uri")

    def run(batches):
        for b in batches:
            for uri, base in zip(b.column("uri").to_pylist(), b.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                size = 0
                for who, start, ids in ShardReader(uri).documents():
                    rows.append((who, base + start, len(ids) // 4, ids))
                    size += len(ids)
                    if size >= 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [id_col, "start", "n_tokens", "ids"])

    return shards.mapInArrow(run, f"{id_col} long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the wanted ids. Each shard decompresses only the frames that they lie in.

    Shards are ranges of ids that only touch: the shard of an id is the one with the greatest
    first id up to it, and those before it that end there. Ids and shards meet in buckets of ids
    that hold about one shard, so the join has equal keys.
    """
    ids = wanted.select(F.col(id_col).cast("long").alias("_w")).distinct()
    shards = manifest.select("uri", F.coalesce("first_id", F.lit(-(1 << 63))).alias("first_id"), "last_id")
    low, high, n = manifest.agg(F.min("first_id"), F.max("last_id"), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, n) + 1)
    bucket = lambda c: F.greatest(F.lit(0), F.floor((F.col(c).cast("decimal(20,0)") - F.lit(low or 0)) / F.lit(width))).cast("long")
    spread = shards.withColumn("_b", F.explode(F.sequence(bucket("first_id"), bucket("last_id"))))
    met = ids.withColumn("_b", bucket("_w")).join(spread, "_b").where(F.col("_w").between(F.col("first_id"), F.col("last_id")))
    pairs = met.select("uri", "_w").repartition("uri").sortWithinPartitions("uri", "_w")

    def run(batches):
        uri, reader, asked = None, None, set()

        def found():
            return [(w, ids) for w, _, ids in reader.documents(asked)] if reader else []

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], [id_col, "ids"])

        for b in batches:
            for u, w in zip(b.column("uri").to_pylist(), b.column("_w").to_pylist(), strict=True):
                if u != uri:
                    if rows := found():
                        yield batch(rows)
                    uri, reader, asked = u, ShardReader(u), set()
                asked.add(w)
        if rows := found():
            yield batch(rows)

    return pairs.select("uri", "_w").mapInArrow(run, f"{id_col} long, ids binary")
