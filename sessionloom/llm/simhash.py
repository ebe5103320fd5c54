"""SimHash near-duplicates with bit-sliced comparison.

* A fingerprint has 64 bits: bit j is 1 if more than half of the shingle hashes have it.
* Copies share a fingerprint; only distinct fingerprints are compared.
* Two fingerprints within the radius agree on at least `bands - radius` of `bands` bands. Each
  choice of that many bands is a table keyed by the bits of those bands; the scheme is the
  cheapest for the number of fingerprints. Members of a bucket are dealt into blocks of BLOCK;
  a task compares two blocks at a time, so a bucket of any size never meets in one task.
* A block comparison holds one side as 64 vertical bit planes. A query flips the planes where
  its bit is 1, and carry-save counters over the planes add up all distances at once; between
  groups of planes the words whose lanes have all passed the radius are abandoned.
* A task returns links that span the components of its two blocks instead of all pairs.

Defined cases: null and empty texts have fingerprint 0 and link like others; repeated rows
get the same class; null ids are the smallest id of their class; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .components import components

#: Fingerprints of a block.
BLOCK = 2048
#: Table rows of a comparing task.
GROUP = 50_000
SEED = 42


def fingerprint(text: str | None, width: int) -> int:
    """Fingerprint of a whole text from its shingles of `width` words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = dict(base.dtypes)["_id"]

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(t, width) for t in b.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(made, pa.int64())], [id_col, "fp"])

    return base.mapInArrow(run, f"{id_col} {kind}, fp long")


# -- bit-sliced comparison


def planes(fps: np.ndarray) -> np.ndarray:
    """Packed bits of (n, words) fingerprints: row j, lane i is bit j of fingerprint i. n is a multiple of 64."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _beyond(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter, given bit by bit, is greater than the radius."""
    over, same = np.zeros_like(count[0]), np.full_like(count[0], ~np.uint64(0))
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            over |= same & count[k]
            same &= ~count[k]
    return over


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


#: Planes that are added up before they go to the counters.
STEP = 7


def _alive(q: np.ndarray, p: np.ndarray, alive: np.ndarray, row: np.ndarray, word: np.ndarray, radius: int, least) -> tuple[np.ndarray, np.ndarray]:
    """(query row, lane) of the pairs within the radius, of the given (query row, word of 64 lanes) pairs.

    `alive` are the lanes of each pair that count."""
    width, one, levels = len(p), np.uint64(1), max(1, radius.bit_length())
    own, alive = [q[row, w] for w in range(width // 64)], alive.copy()
    count = [np.zeros(len(row), np.uint64) for _ in range(levels)]
    for at in range(0, width, STEP):
        end = min(at + STEP, width)
        # a query flips the planes where its bit is 1: what is left is 1 where the lane differs
        x = [p[j][word] ^ (np.uint64(0) - ((own[j // 64] >> np.uint64(j % 64)) & one)) for j in range(at, end)]
        x += [np.zeros_like(alive)] * (STEP - len(x))
        (s1, c1), (s2, c2) = _add(*x[:3]), _add(*x[3:6])
        ones, c3 = _add(s1, s2, x[6])
        twos, fours = _add(c1, c2, c3)
        digits, carry = [ones, twos, fours], np.zeros_like(alive)
        for k in range(max(levels, 3)):  # carry-save: the counters of all lanes at once
            digit = digits[k] if k < 3 else None
            if k >= levels:
                alive &= ~(digit | carry)  # lanes whose counter overflows die
                carry = np.zeros_like(alive)
            elif digit is not None:
                count[k], carry = _add(count[k], digit, carry)
            else:
                count[k], carry = count[k] ^ carry, count[k] & carry
        alive &= ~carry
        limit = min(radius, least(end)) if least else radius
        if end == width or limit < end and at // STEP % max(1, width // 64) == 0:
            alive &= ~_beyond(count, limit)
            keep = alive != 0  # words whose lanes are all beyond the radius are abandoned
            if not keep.all():
                row, word, alive, count, own = row[keep], word[keep], alive[keep], [c[keep] for c in count], [c[keep] for c in own]
            if not len(row):
                break
    bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(bits)
    return row[k], word[k] * 64 + lane


#: Planes of (query, word) pairs that are compared at once.
PAIRS = 2_097_152


def sliced(groups: list[tuple[np.ndarray, np.ndarray]], radius: int, least=None) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of all pairs at a distance of at most `radius` within each (queries, candidates) group.

    Fingerprints are (n, words) arrays; rows count through all groups. Candidates of several groups may share a word of 64
    lanes. `least(j)`, if given, is a lower radius for the first j bits, beyond which a block is abandoned earlier."""
    queries, fps = np.concatenate([q for q, _ in groups]), np.concatenate([c for _, c in groups])
    asked, ends = np.array([len(q) for q, _ in groups]), np.cumsum([len(c) for _, c in groups])
    starts = np.r_[0, ends[:-1]]
    first, many = np.repeat(starts // 64, asked), np.repeat((ends + 63) // 64 - starts // 64, asked)
    row = np.repeat(np.arange(len(queries)), many)
    word = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(row))
    group = np.repeat(np.arange(len(groups)), asked)[row]
    lo, hi = np.maximum(starts[group] - 64 * word, 0), np.minimum(ends[group] - 64 * word, 64)
    mask = (~np.uint64(0) >> (64 - hi).astype(np.uint64)) & (~np.uint64(0) << lo.astype(np.uint64))
    p = planes(np.concatenate([fps, np.zeros((-len(fps) % 64, fps.shape[1]), np.uint64)]))
    each = PAIRS // len(p)
    found = [_alive(queries, p, mask[k : k + each], row[k : k + each], word[k : k + each], radius, least) for k in range(0, len(row), each)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])


def within(queries: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, fps row) of all pairs of 64-bit fingerprints at a distance of at most `radius`."""
    return sliced([(queries.reshape(-1, 1), fps.reshape(-1, 1))], radius)


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of the links that join two components not joined yet."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        r = x
        while parent.setdefault(r, r) != r:
            r = parent[r]
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(k)
    return np.array(keep, np.int64)


def scheme(n: int, radius: int, block: int = BLOCK) -> tuple[int, int]:
    """(bands, bands in a key) for n fingerprints: the fewest tables whose buckets stay about a block."""
    best = None
    for extra in range(1, 5):
        bands = radius + extra
        bits = 64 // bands * extra
        cost = comb(bands, extra) * (1 + n / 2**bits / 64)
        if best is None or cost < best[0]:
            best = (cost, bands, extra)
    return best[1], best[2]


def band_masks(n: int, radius: int, block: int = BLOCK) -> list[int]:
    """Bits of each table's key, such that fingerprints within the radius share a key in some table."""
    bands, extra = scheme(max(n, 1), radius, block)
    edges = [64 * k // bands for k in range(bands + 1)]
    return [sum((1 << edges[k + 1]) - (1 << edges[k]) for k in c) for c in itertools.combinations(range(bands), extra)]


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints `fp` within the radius."""
    n = distinct.count()
    masks = band_masks(n, radius, block)
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, ["t", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    held = held.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A block meets itself and each other block once; small buckets travel together in one group.
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    groups = max(1, -(-n * len(masks) // GROUP))
    spread = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("t", "key"), F.lit(groups))).otherwise(F.xxhash64("t", "key", "lo", "hi"))
    dealt = paired.select("t", "key", "fp", "own", lo.alias("lo"), hi.alias("hi"), "blocks").withColumn("g", spread)
    ordered = dealt.repartition(groups, "g").sortWithinPartitions("g", "t", "key", "lo", "hi", "own")

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def sides(fps, own, lo, hi):
            fps = np.array(fps, np.int64).view(np.uint64)
            if lo == hi:
                return fps, fps
            own = np.array(own)
            return fps[own == lo], fps[own == hi]

        def compared(groups):
            """Links that span the components of the groups; the closest pairs first."""
            row, lane = sliced([(q.reshape(-1, 1), c.reshape(-1, 1)) for q, c in groups], radius)
            a, b = np.concatenate([q for q, _ in groups])[row], np.concatenate([c for _, c in groups])[lane]
            a, b = np.minimum(a, b), np.maximum(a, b)
            ok = a != b
            a, b = a[ok], b[ok]
            near = np.argsort(np.bitwise_count(a ^ b), kind="stable")
            a, b = a[near], b[near]
            k = spanning(a, b)
            return pa.RecordBatch.from_arrays([pa.array(a[k].view(np.int64)), pa.array(b[k].view(np.int64))], schema=schema)

        # Small groups are compared together, large ones alone.
        key, fps, own, groups, size = None, [], [], [], 0

        def closed():
            nonlocal size
            if len(fps) > 1:
                q, c = sides(fps, own, *key[2:])
                if len(q) and len(c):
                    groups.append((q, c))
                    size += len(q) * -(-len(c) // 64)

        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("t", "key", "lo", "hi", "fp", "own")]
            for t, k, lo, hi, fp, o in zip(*cols, strict=True):
                if key != (t, k, lo, hi):
                    closed()
                    key, fps, own = (t, k, lo, hi), [], []
                    if size >= PAIRS // 64:
                        yield compared(groups)
                        groups, size = [], 0
                fps.append(fp)
                own.append(o)
        closed()
        if groups:
            yield compared(groups)

    return ordered.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over links."""
    marked = staged(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(id_col).alias("least"))
    distinct = staged(distinct, "distinct-fingerprints")
    comps = components(links(distinct.select("fp"), radius))
    member = distinct.join(comps, distinct["fp"] == comps["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    top = member.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = member.join(top, "c").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
