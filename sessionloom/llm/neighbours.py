"""Nearest neighbours by inner product: a block matrix join.

Queries and candidates are cut into blocks of fixed size by the hash of their id; a tile is
one query block against one candidate block. Within a tile the vectors are quantised to int8
with a scale per row, the tile of int8 products is one matrix product, and the norms of the
quantisation errors bound each true inner product from both sides. A pair survives if its
upper bound reaches the k-th largest lower bound of its query; survivors are recomputed in
double precision from the original vectors. The k best of each tile are merged per query
with a heap.

The bounds hold strictly, so the result is exact.

Defined cases: vectors that are null, zero, or hold a null, NaN or infinity take no part;
only vectors of one length are compared; rows with a null id take no part; a row repeated
with the same id and vector counts once; a candidate with the query's id is never its
neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as floats whose products are exact), scale, norm of the quantised row, norm of its error."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    back = q * scale[:, None]
    kind = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64
    return q.astype(np.int8).astype(kind), scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed from the first component to the last."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * c[:, k]
    return out


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, candidate ids, scores), best first, for each query with a candidate."""
    q8, qs, qn, qe = quantised(q)
    c8, cs, _, ce = quantised(c)
    c_norm, out = np.linalg.norm(c, axis=1), []
    for lo in range(0, len(q), 256):
        part = slice(lo, lo + 256)
        near = (q8[part] @ c8.T).astype(np.float64) * qs[part, None] * cs[None, :]
        slack = qe[part, None] * c_norm[None, :] + qn[part, None] * ce[None, :]
        slack += 1e-12 * (1 + np.abs(near))
        low, high = near - slack, near + slack
        own = qid[part, None] == cid[None, :]
        low[own] = high[own] = -np.inf
        least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(low), -np.inf)
        rows, cols = np.nonzero((high >= least[:, None]) & ~own)
        if not len(rows):
            continue
        # In slices, which bounds the memory of the gathered pairs.
        score = np.concatenate([exact(q[lo + rows[a : a + 200_000]], c[cols[a : a + 200_000]]) for a in range(0, len(rows), 200_000)])
        order = np.lexsort((cid[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for a, b in zip(first, [*first[1:], len(rows)], strict=True):
            b = min(b, a + k)
            out.append((lo + int(rows[a]), cid[cols[a:b]], score[a:b]))
    return out


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block, repeated rows once."""
    ids = t.column("id").to_numpy()
    vecs = t.column("vec").combine_chunks()
    x = np.asarray(vecs.flatten(), np.float64).reshape(len(ids), -1)
    if len(np.unique(ids)) < len(ids):
        keep = sorted({(i, v.tobytes()): n for n, (i, v) in enumerate(zip(ids.tolist(), x, strict=True))}.values())
        ids, x = ids[keep], x[keep]
    return ids, x


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the largest inner product; ties to the smaller id."""

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))

    cand, ask = rows(vectors), rows(queries)
    n_cand, n_ask = parts_for(cand.count(), candidate_block, 1), parts_for(ask.count(), query_block, 1)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = cand.select(F.size("vec").alias("dim"), block(n_cand).alias("cb"), every(n_ask).alias("qb"), "id", "vec")
    ask = ask.select(F.size("vec").alias("dim"), block(n_ask).alias("qb"), every(n_cand).alias("cb"), "id", "vec")
    keys = ["dim", "qb", "cb"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.binary()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (qid, q), (cid, c) = _matrix(left), _matrix(right)
        found = tile(qid, q, cid, c, k)
        cols = [[int(qid[r]) for r, _, _ in found], [q[r].tobytes() for r, _, _ in found], [i.tolist() for _, i, _ in found], [s.tolist() for _, _, s in found]]
        return pa.table([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    best = ask.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(run, "query_id long, query_hash binary, ids array<long>, scores array<double>")
    best = best.withColumn("query_hash", F.xxhash64("query_hash")).repartition("query_id", "query_hash").sortWithinPartitions("query_id", "query_hash")

    def merge(batches):
        schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        heap: list[tuple[float, int]] = []  # the worst of the k best on top
        key = None

        def ranked():
            return [(key[0], n, -i, s) for n, (s, i) in enumerate(sorted(heap, reverse=True), 1)]

        out: list[tuple] = []
        for b in batches:
            for who, mark, ids, scores in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
                if key != (who, mark):
                    out += ranked() if key else []
                    key, heap = (who, mark), []
                for i, s in zip(ids, scores, strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -i))
                    elif (s, -i) > heap[0]:
                        heapq.heapreplace(heap, (s, -i))
                    else:
                        break  # the list falls from here on
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ranked(), strict=True), schema, strict=True)], schema=schema)

    return best.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
