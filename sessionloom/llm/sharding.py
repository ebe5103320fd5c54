"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit hashes; a row belongs to the next point
clockwise of the hash of its key. A shard takes no more than its bound; what overflows goes on
clockwise to the next shard that has room. So balance is guaranteed, and one more shard moves
little beside what it takes.

Rows are ordered once by their place on the ring; keys, sizes and checksums move, texts don't.
What the driver sees are the row counts of the arcs (shards x points, whatever the table's size)
and of the sort's ranges. From those it tells which stretch of each arc goes to which shard:
in turn k each arc offers its rest to the k-th shard clockwise, arcs that are nearer first. A
stretch is an interval of places in the order, so a row finds its shard, and its slot there,
by one binary search. A key that many rows share is one place on the ring, whose rows overflow
like any others; no task holds them all.

Defined cases: a null key has a place of its own; a null text has no bytes; rows that share a
key are ordered by their checksum and size, so repeated rows are interchangeable; with fewer
rows than shards some shards stay empty; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import new_folder, numbered, staged

#: Points of a shard on the ring.
POINTS = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well spread values for small numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of all points, and their shards. A shard's places don't depend on how many shards there are."""
    owner = np.repeat(np.arange(shards), points)
    with np.errstate(over="ignore"):
        places = _mixed((owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.tile(np.arange(points, dtype=np.uint64), shards)).view(np.int64)
    order = np.lexsort((owner, places))
    return places[order], owner[order]


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """How many rows each shard takes at most. Without slack the counts are at most one apart."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def stretches(counts: list[int], owner: np.ndarray, most: list[int]) -> list[tuple[int, int]]:
    """(first place, shard) of each stretch of the ring order. counts: rows of each arc; the last are those beyond the last point."""
    arcs = len(owner)
    left, room = list(counts), list(most)
    given: list[list[tuple[int, int]]] = [[] for _ in counts]
    open_arcs = [(a, a % arcs, set()) for a in range(arcs + 1) if left[a]]
    while open_arcs:
        rest = []
        for a, at, seen in open_arcs:
            while (s := int(owner[at])) in seen:  # the next other shard clockwise
                at = (at + 1) % arcs
            seen.add(s)
            if n := min(left[a], room[s]):
                given[a].append((n, s))
                left[a] -= n
                room[s] -= n
            if left[a]:
                rest.append((a, at, seen))
        open_arcs = rest
    out, at = [], 0
    for parts in given:
        for n, s in parts:
            out.append((at, s))
            at += n
    return out


def placed(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS, slack: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """(id, size, text_crc32, columns of keep, shard, slot): one row per row of docs; slots of a shard have no gap.

    A kept column that has a name of the others gets a `_` behind it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string")).alias("_h"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(c).alias(f"_keep_{c}") for c in keep or []])
    rows = numbered(staged(own, "shard-keys"), [F.col("_h"), F.col("text_crc32"), F.col("size")], "shard-places")
    places, owner = ring(shards, points)

    def arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(places) + 1, np.int64)
        for b in batches:
            seen += np.bincount(np.searchsorted(places, b.column(0).to_numpy(zero_copy_only=False)), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["arc", "n"])

    counts = [0] * (len(places) + 1)
    for arc, n in rows.select("_h").mapInArrow(arcs, "arc long, n long").groupBy("arc").agg(F.sum("n")).collect():
        counts[arc] = n
    cut = stretches(counts, owner, bounds(sum(counts), shards, slack))
    starts, to = np.array([x[0] for x in cut], np.int64), np.array([x[1] for x in cut], np.int64)
    ends = np.append(starts[1:], sum(counts))
    base, filled = np.zeros(len(cut), np.int64), [0] * shards
    for k, (s, n) in enumerate(zip(to, ends - starts)):
        base[k], filled[s] = filled[s], filled[s] + n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(b.schema.get_field_index("_pos")).to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, at, "right") - 1
            columns = [b.column(i) for i, c in enumerate(b.schema.names) if c != "_pos"]
            names = [c for c in b.schema.names if c != "_pos"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(to[k].astype(np.int32)), pa.array(base[k] + at - starts[k])], [*names, "shard", "slot"])

    rows = rows.drop("_h")
    kind = StructType([f for f in rows.schema.fields if f.name != "_pos"] + [StructField("shard", IntegerType()), StructField("slot", LongType())])
    return rows.mapInArrow(deal, kind).select(F.col("_id").alias(id_col), "size", "text_crc32", *[F.col(f"_keep_{c}").alias(f"{c}_" if c in ("size", "text_crc32", "shard", "slot") else c) for c in keep or []], "shard", "slot")


def moved(docs: DataFrame, shards: int, more: int = 1, id_col: str = "doc_id", **kinds) -> DataFrame:
    """One row: how many rows change their shard if there are `more` shards, and the rows of all. Ids are to be distinct."""
    now = placed(docs, shards, id_col, **kinds).select(id_col, F.col("shard").alias("now"))
    then = placed(docs, shards + more, id_col, **kinds).select(id_col, F.col("shard").alias("then"))
    both = now.join(then, id_col)
    return both.agg(F.coalesce(F.sum((F.col("now") != F.col("then")).cast("long")), F.lit(0)).alias("moved"), F.count("*").alias("n_rows"))


def write(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", each: int = 100_000, **kinds) -> str:
    """Write all columns of docs as one folder a shard, in slot order, files of about `each` rows; returns the folder."""
    out = placed(docs, shards, id_col, text_col, keep=[c for c in docs.columns if c != id_col], **kinds).drop("size", "text_crc32")
    folder = new_folder(docs.sparkSession, "shards")
    out.withColumn("_file", F.floor(F.col("slot") / each)).repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(folder)
    return folder
