"""Near-duplicate documents: SimHash sketches compared bit-sliced within groups that cannot miss a pair.

Two texts are near duplicates if their sets of five-word shingles have a Jaccard similarity of
0.8 or more. One document of each connected group stays: the one with the smallest id.

1. Sketch. One pass over the texts gives each distinct text a SimHash of 256 bits and its
   prefix: the first fifth of its shingles (and one more) in an order that all texts share,
   common shingles last. Texts of that similarity share a shingle of their prefixes, so the
   texts that hold a prefix shingle are the groups in which pairs are searched. The shorter
   text of such a pair holds the shingle even in the core of its prefix, the first ninth.
2. Stars. Each text meets the smallest text of its groups, of several the one it shares most
   with: one pair a text, however large the group. The links that the exact check leaves are
   contracted to components.
3. Blocks. In groups that still hold more than one component, texts of different components
   are compared bit-sliced (`simhash.sliced`): planes of 256 bits, carry-save counters, blocks
   abandoned beyond the radius. In rounds, each after a contraction, up to FEW texts of each
   component give their nearest partner or two, then all texts some more partners, and last
   all partners, in the groups where the round before has left anything out. So a group of
   many texts closes by few pairs, and none is missed. Groups are dealt in blocks over the tasks.
4. Check. Every pair within the radius is checked on the shingle sets of the two whole texts;
   only pairs of one component are left out, since their link changes nothing.

The radius is the one place that is not exact: at a similarity of 0.8 a bit differs with
probability 0.151 and a standard deviation of 5.7 of 256 bits, so that RADIUS leaves out one in
100 000 of the pairs at the very threshold, and fewer of closer ones. Texts of a few shingles
scatter more (five and four of them: 0.1875, 6.2 bits), so texts of fewer than TINY are compared with
each other within TINY_RADIUS, seven standard deviations.

Only ids, hashes and sketches are shuffled for all texts; whole texts only of checked pairs.

Defined cases: null and empty texts are texts without a word and near duplicates of each other;
of repeated rows one stays; null ids come first; an empty table gives an empty result; other
columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .components import components
from .simhash import BLOCK, GROUP, PAIRS, SEED, sliced

WORDS = 4
RADIUS = 64
TINY, TINY_RADIUS = 26, 92
#: Rounds of comparison: how many texts stand for a component of a group, and how many partners each gives; None is all.
ROUNDS = ((16, 2), (None, 8), (None, None))
#: Share (1 / SAMPLE) of the texts that tell which shingles are common: those in one of COMMON_IN texts, at most MOST_COMMON.
SAMPLE, COMMON_IN, MOST_COMMON = 16, 2000, 50_000
#: Tables of keys up to this number of rows (16 bytes each) are broadcast, larger ones are joined by a shuffle.
MOST_KEYS = 1_000_000
NULL_ID = -(1 << 63)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the runs of `width` words, ascending; a shorter text is one run."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width]))
    runs = zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.unique(np.array([h(joined[a:b], SEED) for a, b in runs], np.uint64))


def sketch(own: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits from a set of hashes: each is drawn out to as many words."""
    ones = np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(own), 16_384):
        drawn = np.empty((len(own[k : k + 16_384]), WORDS), np.uint64)
        with np.errstate(over="ignore"):
            for w in range(WORDS):
                x = own[k : k + 16_384] + np.uint64(0x9E3779B97F4A7C15 * w & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                drawn[:, w] = x ^ (x >> np.uint64(31))
        ones += np.unpackbits(drawn.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), bitorder="little").view("<i8")


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Common shingles of a sample, the rarer ones first. They only order prefixes: no result depends on them."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            made = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h not in seen:
                    seen.add(h)
                    made.append(shingles(text, width))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], ["s"])

    least = max(3, texts.count() // (SAMPLE * COMMON_IN))
    sample = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("h", "_text")
    counted = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= least)
    found = counted.orderBy(F.desc("count"), "s").limit(MOST_COMMON).collect()
    return np.array([r["s"] for r in reversed(found)], np.int64).view(np.uint64)


def beyond(share: float, n):
    """How many of n shingles can't all be missing in a text that holds that share of them."""
    return n - np.ceil(share * n - 1e-9).astype(int) + 1


def sketches(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(i, h, n, core, f0.., prefix) of every row of texts (i, h, _text); a text that the task has met is not sketched again."""
    common = common_shingles(texts, width)
    order = np.argsort(common)
    words = [f"f{k}" for k in range(WORDS)]

    def prefix(own: np.ndarray, held: np.ndarray, rank: np.ndarray) -> np.ndarray:
        n = len(own)
        if not n:
            return np.zeros(1, np.int64)
        if len(held):
            k = np.minimum(np.searchsorted(held, own), len(held) - 1)
            own = own[np.argsort(np.where(held[k] == own, rank[k], 0), kind="stable")]
        return own[: beyond(similarity, n)].view(np.int64)

    def run(batches):
        held, rank, seen = common[order], order + 1, set()
        for b in batches:
            sizes, made, first = [], [], []
            for h, text in zip(b.column("h").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if h in seen:
                    sizes.append(None)
                    made.append(None)
                    first.append(None)
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(h)
                own = shingles(text, width)
                sizes.append(len(own))
                made.append(sketch(own).tolist())
                first.append(prefix(own, held, rank))
            cols = [pa.array([m and m[k] for m in made], pa.int64()) for k in range(WORDS)]
            cores = [None if n is None else int(beyond(2 * similarity / (1 + similarity), n)) for n in sizes]
            cols = [b.column("i"), b.column("h"), pa.array(sizes, pa.int32()), pa.array(cores, pa.int32()), *cols, pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["i", "h", "n", "core", *words, "prefix"])

    return texts.select("i", "h", "_text").mapInArrow(run, f"i long, h long, n int, core int, {', '.join(w + ' long' for w in words)}, prefix array<long>")


def early(bits: int) -> int:
    """Radius for the first bits: more than six standard deviations beyond what texts of the least similarity differ in."""
    return int(0.16 * bits + 6.3 * (0.134 * bits) ** 0.5)


def early_tiny(bits: int) -> int:
    """The same for texts of fewer than TINY shingles."""
    return int(0.1875 * bits + 7 * (0.153 * bits) ** 0.5)


def block_pairs(members: DataFrame, texts: DataFrame, similarity: float, nearest: int | None = None, block: int = BLOCK) -> DataFrame:
    """(ha, hb, s): pairs of different components within the radius, of the texts (s, h, c, core) that share s.

    With `nearest`, a text gives that many of its nearest partners in a group; a row of nulls
    and s names each group that has more. A group of more than `block` texts is dealt into
    blocks; a task compares two blocks at a time, and many small groups together. Groups with one smallest text go to one task, which
    tells the pairs that they share once.
    """
    sizes = members.groupBy("s").agg(F.count("*").alias("held"), F.min("h").alias("low"))
    own = members.join(sizes, "s").withColumn("blocks", F.ceil(F.col("held") / block).cast("int"))
    own = own.withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = max(1, -(-members.count() // GROUP))
    dealt = own.select("s", "low", "h", "c", "core", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "blocks")
    spread = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("low"), F.lit(groups))).otherwise(F.xxhash64("low", "lo", "hi"))
    words = [f"f{k}" for k in range(WORDS)]
    held = dealt.withColumn("g", spread).join(texts.select("h", "n", "p", *words), "h").select("g", "low", "s", "lo", "hi", "own", "h", "c", "core", "n", "p", *words)
    ordered = held.repartition(groups, "g").sortWithinPartitions("g", "low", "s", "lo", "hi", "own")

    def parts(x: np.ndarray, lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(query rows, candidate rows) that together hold every pair of different components of one group."""
        rows = np.arange(lo, hi)
        one, other = (rows, rows) if x["lo"][lo] == x["hi"][lo] else (rows[x["own"][lo:hi] == x["lo"][lo]], rows[x["own"][lo:hi] == x["hi"][lo]])
        kinds, many = np.unique(x["c"][lo:hi], return_counts=True)
        if len(kinds) == 1:
            return []
        top = kinds[many.argmax()]  # texts of the largest component need not meet each other
        a, b = one[x["c"][one] != top], one[x["c"][one] == top]
        found = [(a, other)] if one is other else [(a, other), (b, other[x["c"][other] != top])]
        return [(q, c) for q, c in found if len(q) and len(c)]

    def run(batches):
        schema = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("s", pa.int64())])
        held: list[np.ndarray] = []  # pairs, or (0, s) of a group that has more, not told yet

        def told():
            pairs = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 3), np.int64)
            held.clear()
            no = pairs[:, 2] == 1
            cols = [pa.array(pairs[:, 0], pa.int64(), mask=no), pa.array(pairs[:, 1], pa.int64(), mask=no), pa.array(pairs[:, 0], pa.int64(), mask=~no)]
            return pa.RecordBatch.from_arrays(cols, schema=schema)
        names = ["g", "s", "lo", "hi", "own", "h", "c", "core", "n", "p", *words]

        def compared(x, groups):
            fps = np.stack([x[w] for w in words], axis=1).view(np.uint64)
            row, lane = sliced([(fps[q], fps[c]) for q, c in groups], RADIUS, early)
            a, b = np.concatenate([q for q, _ in groups])[row], np.concatenate([c for _, c in groups])[lane]
            tiny = x["n"] < TINY
            few = [(q, c) for q, c in ((q[tiny[q]], c[tiny[c]]) for q, c in groups) if len(q) and len(c)]
            if few:
                row, lane = sliced([(fps[q], fps[c]) for q, c in few], TINY_RADIUS, early_tiny)
                more = np.stack([np.concatenate([q for q, _ in few])[row], np.concatenate([c for _, c in few])[lane]])
                a, b = np.unique(np.concatenate([np.stack([a, b]), more], axis=1), axis=1)
            n, core, p = np.stack([x["n"][a], x["n"][b]]), np.stack([x["core"][a], x["core"][b]]), np.stack([x["p"][a], x["p"][b]]).min(axis=0)
            ok = (x["c"][a] != x["c"][b]) & (n.min(axis=0) >= similarity * n.max(axis=0) - 1e-6)
            ok &= np.where(n[0] <= n[1], core[0], 1) & np.where(n[1] <= n[0], core[1], 1) > 0
            # what lies behind the longer prefix and what the prefixes share must be enough
            ok &= p + np.ceil(similarity * n.max(axis=0) - 1e-9) - 1 >= similarity / (1 + similarity) * n.sum(axis=0) - 1e-6
            a, b, more = a[ok], b[ok], np.zeros(0, np.int64)
            if nearest is not None and len(a):
                far = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1)
                order = np.lexsort((x["h"][b], far, a))
                a, b = a[order], b[order]
                new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                rank = np.arange(len(a)) - np.repeat(new, np.diff(np.r_[new, len(a)]))
                more = np.unique(x["s"][a[rank >= nearest]])
                a, b = a[rank < nearest], b[rank < nearest]
            one, two = np.minimum(x["h"][a], x["h"][b]), np.maximum(x["h"][a], x["h"][b])
            held.append(np.unique(np.stack([one, two, np.zeros(len(one), np.int64)], axis=1), axis=0))
            held.append(np.stack([more, np.zeros(len(more), np.int64), np.ones(len(more), np.int64)], axis=1))

        def searched(x):
            """Compare the complete groups x."""
            new = np.zeros(len(x["g"]), bool)
            new[0] = True
            for k in ("g", "s", "lo", "hi"):
                new[1:] |= x[k][1:] != x[k][:-1]
            edges, groups, size = [*np.flatnonzero(new).tolist(), len(new)], [], 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo + 1:
                    continue
                for q, c in parts(x, lo, hi):
                    groups.append((q, c))
                    size += len(q) * -(-len(c) // 64)
                if size >= PAIRS // (64 * WORDS):
                    compared(x, groups)
                    groups, size = [], 0
            if groups:
                compared(x, groups)

        def columns(tables):
            return {k: np.concatenate([t.column(k).to_numpy(zero_copy_only=False) for t in tables]) for k in names}

        waiting, rows, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key = tuple(b.column(k)[b.num_rows - 1].as_py() for k in ("g", "s", "lo", "hi"))
            waiting.append(b)
            rows += b.num_rows
            if rows < 2 * GROUP or key == last:  # wait for the end of a group
                last = key
                continue
            x, last = columns(waiting), key
            tail = len(x["g"])
            while tail and tuple(int(x[k][tail - 1]) for k in ("g", "s", "lo", "hi")) == key:
                tail -= 1
            if tail:
                searched({k: v[:tail] for k, v in x.items()})
                if sum(map(len, held)) > 1_000_000:
                    yield told()
                waiting = [pa.RecordBatch.from_arrays([pa.array(v[tail:]) for v in x.values()], names)]
                rows = len(x["g"]) - tail
        if waiting:
            searched(columns(waiting))
        yield told()

    return ordered.mapInArrow(run, "ha long, hb long, s long").distinct()


def keyed(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with a written table of keys: broadcast if it is small."""
    return df.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, on, how)


def alike(pairs: DataFrame, rows: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (ha, hb) whose sets of shingles have at least that Jaccard similarity, as a written table."""
    asked = staged(pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct().join(texts, "h").select("h", F.col("least").alias("i")), "asked")
    held = staged(keyed(rows, asked, ["h", "i"], "left_semi").select("h", "_text").dropDuplicates(["h"]), "texts")
    one, two = held.select(F.col("h").alias("ha"), F.col("_text").alias("ta")), held.select(F.col("h").alias("hb"), F.col("_text").alias("tb"))

    def run(batches):
        known: dict[int, np.ndarray] = {}

        def of(h, text):
            if h not in known:
                if len(known) >= 1000:
                    known.clear()
                known[h] = shingles(text, width)
            return known[h]

        for b in batches:
            ha, hb, ta, tb = (b.column(n).to_pylist() for n in ("ha", "hb", "ta", "tb"))
            ok = []
            for a, x, c, y in zip(ha, ta, hb, tb, strict=True):
                sa, sb = of(a, x), of(c, y)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                ok.append(common >= similarity * (len(sa) + len(sb) - common))
            keep = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ha, np.int64)[keep]), pa.array(np.array(hb, np.int64)[keep])], ["ha", "hb"])

    met = pairs.select("ha", "hb").join(two, "hb").join(one, "ha").select("ha", "hb", "ta", "tb")
    return staged(met.mapInArrow(run, "ha long, hb long"), "alike")


def near_links(rows: DataFrame, texts: DataFrame, found: DataFrame, width: int, similarity: float, rounds=ROUNDS, block: int = BLOCK) -> DataFrame:
    """(node, component) of the distinct texts that have a near duplicate. rows: i, h, _text; found: sketches."""
    text, in_core = lambda x: F.col(x).bitwiseAND(F.lit(-2)), lambda x: F.col(x).bitwiseAND(F.lit(1))
    placed = found.where("prefix is not null").select("h", "core", F.posexplode("prefix").alias("k", "s"))
    # x: the text's hash, which is even, and in its last bit whether the shingle is in the core
    prefixes = placed.select("s", F.when(F.col("k") < F.col("core"), F.col("h").bitwiseOR(F.lit(1))).otherwise(F.col("h")).alias("x"))
    smallest = prefixes.groupBy("s").agg(F.min("x").alias("lo"))
    stars = staged(prefixes.join(smallest, "s").where("x <> lo").distinct(), "shared-shingles")
    best = stars.select(text("x").alias("h"), text("lo").alias("lo")).groupBy("h", "lo").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "lo")).alias("best")).select("h", "best.lo")
    words = [f"f{k}" for k in range(WORDS)]
    met = best.join(texts.select("h", "n", *words), "h").join(texts.select(F.col("h").alias("lo"), F.col("n").alias("m"), *(F.col(w).alias("o" + w) for w in words)), "lo")
    far = sum((F.bit_count(F.col(w).bitwiseXOR(F.col("o" + w))) for w in words), F.lit(0))
    radius = F.when(F.greatest("n", "m") < TINY, TINY_RADIUS).otherwise(RADIUS)
    near = (far <= radius) & (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-6)
    first = staged(met.where(near).select(F.col("lo").alias("ha"), F.col("h").alias("hb")), "candidates")
    links = alike(first, rows, texts, width, similarity)

    members = stars.select("s", "x").unionByName(stars.select("s", F.col("lo").alias("x")).distinct())
    members = members.select("s", text("x").alias("h"), in_core("x").alias("core"))
    # p: the prefix shingles that a text shares with any other
    grouped = staged(members.groupBy("h").agg(F.count("*").cast("int").alias("p")).join(texts.select("h", "n", *words), "h"), "grouped-texts")
    comps, tested = components(links, "ha", "hb"), first
    for few, nearest in rounds:
        named = members.join(comps, members["h"] == comps["node"], "left").select("s", "h", "core", F.coalesce("component", "h").alias("c"))
        mixed = named.groupBy("s").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.max("core").alias("core")).where("a <> b and core = 1").select("s")
        members = chosen = staged(named.join(mixed, "s", "left_semi"), "open-shingles")
        if members.isEmpty():
            break
        if few:
            ranked = Window.partitionBy("s", "c").orderBy(F.xxhash64("h"), "h")
            chosen = staged(members.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= few).drop("k"), "representatives")
        sought = staged(block_pairs(chosen, grouped, similarity, nearest, block), "sought")
        pairs = staged(sought.where("s is null").select("ha", "hb").join(tested, ["ha", "hb"], "left_anti"), "candidates")
        links = links.unionByName(alike(pairs, rows, texts, width, similarity))
        comps = components(links, "ha", "hb")
        left = sought.where("s is not null").select("s")
        if few:
            left = left.unionByName(members.groupBy("s", "c").agg(F.count("*").alias("held")).where(F.col("held") > few).select("s"))
        members, tested = members.drop("c").join(left.distinct(), "s", "left_semi"), tested.unionByName(pairs)
    return comps


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", rounds=ROUNDS, block: int = BLOCK) -> DataFrame:
    """The documents, all their columns, one of each group of near duplicates."""
    text = F.col(text_col).cast("string")
    given = docs.withColumn("_near_i", F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))).withColumn("_near_h", F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(-2)))
    rows = given.select(F.col("_near_i").alias("i"), F.col("_near_h").alias("h"), text.alias("_text"))
    found = staged(sketches(rows, width, similarity), "sketches")
    texts = staged(found.groupBy("h").agg(F.min("i").alias("least"), *(F.max(x).alias(x) for x in ("n", *(f"f{k}" for k in range(WORDS))))), "distinct-texts")
    comps = near_links(rows, texts, found, width, similarity, rounds, block)
    member = texts.join(comps, texts["h"] == comps["node"], "left").select("h", "least", F.coalesce("component", "h").alias("c"))
    keep = member.groupBy("c").agg(F.min(F.struct("least", "h")).alias("k")).select(F.col("k.h").alias("h"), F.col("k.least").alias("i"), F.lit(True).alias("stays"))
    held = staged(found.groupBy("h", "i").agg(F.count("*").alias("times")).join(keep, ["h", "i"], "left").where("stays is null or times > 1"), "judged")
    names = lambda df: df.select(F.col("h").alias("_near_h"), F.col("i").alias("_near_i"))
    out = keyed(given, staged(names(held.where("stays is null")), "dropped"), ["_near_h", "_near_i"], "left_anti")
    repeated = staged(names(held.where("stays")), "repeated")
    if repeated.isEmpty():
        return out.select(docs.columns)
    once = keyed(out, repeated, ["_near_h", "_near_i"], "left_anti")
    again = keyed(out, repeated, ["_near_h", "_near_i"], "left_semi").dropDuplicates(["_near_h", "_near_i"])
    return once.unionByName(again).select(docs.columns)
