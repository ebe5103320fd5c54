"""Packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing. A document longer than a window is first cut into full windows, each a
sequence of its own; the rests are sorted by falling length, and each goes to the open window
that it fills most tightly. Open windows hang in a segment tree indexed by remaining
capacity: the tightest fit is one descent.

Each task packs the documents that it reads, group by group of about `group_tokens` ids, so
nothing is shuffled, memory is bounded, and only the last windows of a group carry padding.
`sequence_id` is the task's number times 2**33 plus a counter.

Defined cases: a null or empty text is one piece, the end id; repeated rows are packed each;
null ids are kept; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe


class OpenWindows:
    """Open windows by remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, remaining: int) -> None:
        self.at[remaining].append(window)
        k = self.size + remaining
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The tightest window with at least `need` left, and what it had left."""
        k, count = self.size + need, self.count
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k == 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        remaining = k - self.size
        while k:
            count[k] -= 1
            k >>= 1
        return self.at[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(window, offset) of each item and the fill of each window; items of equal length keep their order."""
    tree, fill = OpenWindows(capacity), []
    window, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        got = tree.take(need)
        if got is None:
            got = (len(fill), capacity)
            fill.append(0)
        w, remaining = got
        window[i], offset[i] = w, fill[w]
        fill[w] += need
        if remaining > need:
            tree.add(w, remaining - need)
    return window, offset, fill


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, group_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, sequence_tokens (ids in the sequence) and sequence_length (with padding)."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"{id_col} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_length long"
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, first = bpe.encoder(path), TaskContext.get().partitionId() << 33
        made = 0

        def packed(rows):
            nonlocal made
            window, offset, fill = best_fit_decreasing([len(r[3]) // 4 for r in rows], capacity)
            total = [fill[w] for w in window]
            length = [t if t & (t - 1) == 0 else capacity for t in total]
            cols = [pa.array([r[0] for r in rows], id_type), *(pa.array([f(r) for r in rows], pa.int64()) for f in (lambda r: r[1], lambda r: len(r[3]) // 4)), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())]
            cols += [pa.array(x, pa.int64()) for x in ([first + made + w for w in window], offset, total, length)]
            made += len(fill)
            return pa.RecordBatch.from_arrays(cols, names)

        rows, size, id_type = [], 0, pa.int64()
        for b in batches:
            id_type = b.column("_id").type
            for who, text in zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n, step = len(ids) // 4, capacity * 4
                rows += [(who, k // 4, n, ids[k : k + step]) for k in range(0, len(ids), step)]
                size += n
                if size >= group_tokens:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return base.mapInArrow(run, schema)


def piece_digests(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_length")
