"""Removal of repeated byte strings: a distributed, common-prefix-aware suffix merge sort.

A byte goes if a string of `least` bytes that covers it also starts earlier. Sorting every
suffix of a corpus would move a hundred times its size; only suffixes that can repeat are
sorted.

1. Anchors. In each window of `least` bytes the `gram`-byte string with the smallest hash is
   the window's anchor. Equal windows have equal anchors at equal places. The windows of one
   anchor form a segment. One shuffle of (anchor hash, segment hash, place) shows which
   anchors occur once; their windows cannot repeat. Of equal segments the earliest stays and
   the others are marked whole. What remains are distinct segments around shared anchors.
2. Suffix runs. Per task, the suffixes that start at those anchors, and the reversed texts
   before them, are sorted and front-coded: each string is sent as the length of the prefix
   that it shares with the one before, and the rest. One row holds a run's part of a bucket.
3. Merge. Per bucket of anchor hashes a loser tree merges the runs. Its nodes keep the length
   of the prefix shared with the last winner: strings that differ there are decided without
   a look at their bytes, and equal lengths are compared from there on only. The merge
   yields the common prefix of all neighbours, hence the classes of equal suffixes to any
   depth up to `least`. The windows of an anchor with more than HOT distinct segments are dealt
   further: those of STEP successive distances share `least` - STEP + 1 bytes, whose hash names
   their bucket, so a frequent string with many surroundings fills no bucket.
4. For each distance d from window start to anchor, windows are equal if the d bytes before
   the anchor and the `least` - d bytes from it are; of each class all but the earliest are
   marked.
5. Marked runs are merged per document and cut out.

Anchors and segments have 64-bit hashes. Segments of one anchor with equal hashes count as
equal without a look at their bytes: two different ones do with probability 2^-64 a pair.
Segments that differ are compared by bytes, in the merge.

Defined cases: null and empty texts have no bytes; documents shorter than `least` stay whole;
of repeated rows (and of rows with one id, by hash of their text) all but the first lose what
they repeat; null ids come first; an empty table gives an empty result; other columns are
ignored by `remove_repeats` and kept by `cut_repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, row_key, staged

LEAST, GRAM = 100, 32
#: Candidate suffixes of a bucket, and of a run before it is sent.
BUCKET, RUN = 50_000, 100_000
#: Distinct segments of an anchor from which on its windows are dealt by more bytes, and of how many distances at a time.
HOT, STEP = 2_000, 8
NULL_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    made, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while made < n:
            k = min(made, n - made)
            out[made : made + k] = out[:k] * step
            made, step = made + k, step * step
    return out


def _table(name: str, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        base = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        _TABLES[name] = _powers(base, 1 << max(16, (n - 1).bit_length()))
    return _TABLES[name]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE & 0xFFFFFFFF)) | np.uint64(1)


def segments(data: bytes, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, first window, last window, anchor) of each segment."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    up, down = _table("up", n + 1), _table("down", n + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[b] * up[:n], out=prefix[1:])
        h = _mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
        span = least - gram + 1
        low = _sliding(h, span, np.minimum)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(low)])) - 1
        # a gram is an anchor if it is the least of some window, that is, if it equals the largest least value around it
        edge = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), span, np.maximum) == h)
        anchor = _next(at, h, first, low[first])
        # equal grams in one run of windows: the leftmost in each window is its anchor
        parts = [(first, np.minimum(last, anchor), anchor)]
        while (more := anchor < last).any():
            first, last = anchor[more] + 1, last[more]
            anchor = _next(at, h, first, low[first])
            parts.append((first, np.minimum(last, anchor), anchor))
        if len(parts) > 1:
            first, last, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(first)
            first, last, anchor = first[order], last[order], anchor[order]
        else:
            first, last, anchor = parts[0]
        end = last + least
        c = _mix((prefix[end] - prefix[first]) * down[first] + (end - first).astype(np.uint64))
    return low[first], c, first, last, anchor


def _sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    """Minimum or maximum over each `span` neighbours, by doubling."""
    width = 1
    out = x
    while 2 * width <= span:
        out = op(out[:-width], out[width:])
        width *= 2
    return op(out[: -(span - width)], out[span - width :]) if span > width else out


def _next(at: np.ndarray, h: np.ndarray, first: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first anchor place from `first` on whose hash is g."""
    pos = np.searchsorted(at, first)
    while (bad := h[at[pos]] != g).any():
        pos = pos + bad
    return at[pos]


def anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """(g, c, id, dup, spot, copy): spot holds first window * 512 + windows - 1 of a segment.

    Equal segments within a task's share: all but the first are known to be copies. They go on
    under a hash of their own, so that frequent segments don't meet in one task.
    """

    def run(batches):
        schema = pa.schema([("g", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("dup", pa.int32()), ("spot", pa.int64()), ("copy", pa.bool_())])

        def batch(parts):
            g, c, who, dup, spot = (np.concatenate(x) for x in zip(*parts, strict=True))
            copy = np.zeros(len(g), bool)
            order = np.argsort(c, kind="stable")
            again = np.flatnonzero(c[order][1:] == c[order][:-1])
            if len(again):  # segments that occur more than once: order them by place
                few = order[np.union1d(again, again + 1)]
                few = few[np.lexsort((spot[few], dup[few], who[few], g[few], c[few]))]
                later = few[1:][(c[few][1:] == c[few][:-1]) & (g[few][1:] == g[few][:-1])]
                copy[later] = True
                with np.errstate(over="ignore"):
                    g = np.where(copy, _mix(g + who.view(np.uint64) * np.uint64(_BASE) + spot.view(np.uint64)), g)
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(who), pa.array(dup), pa.array(spot), pa.array(copy)], schema=schema)

        parts, size = [], 0
        for b in batches:
            for who, dup, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode("utf-8", "replace")
                if len(data) < least:
                    continue
                g, c, first, last, _ = segments(data, least, gram)
                parts.append((g, c, np.full(len(g), who, np.int64), np.full(len(g), dup, np.int32), first * 512 + (last - first)))
                size += len(g)
                if size >= 200_000:
                    yield batch(parts)
                    parts, size = [], 0
        if parts:
            yield batch(parts)

    return docs.mapInArrow(run, "g long, c long, id long, dup int, spot long, copy boolean")


# -- front coding and the loser tree


def front_coded(rows: list[bytes]) -> bytes:
    """Sorted strings: per string the prefix shared with the one before, the rest's length, the rest."""
    out, before = bytearray(), b""
    for s in rows:
        n = shared(before, s)
        out += bytes((n, len(s) - n)) + s[n:]
        before = s
    return bytes(out)


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first `start` bytes are known to be equal."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo = start
    while True:  # equal blocks are skipped, then the block that differs is searched
        if a[lo : lo + 16] != b[lo : lo + 16]:
            while a[lo] == b[lo]:
                lo += 1
            return lo
        lo += 16


def decoded(data: bytes):
    """(string, prefix shared with the one before) of a front-coded run."""
    at, s, n = 0, b"", len(data)
    while at < n:
        keep, more = data[at], data[at + 1]
        at += 2
        s = s[:keep] + data[at : at + more]
        at += more
        yield s, keep


def merge(runs: list[bytes]):
    """(run, string, prefix shared with the string before) in sorted order, by a loser tree.

    A player carries the prefix that it shares with the last winner. Of two players the one
    with the longer shared prefix is smaller; only at equal lengths are bytes compared, and
    only from there on.
    """
    k = 1 << max(0, (len(runs) - 1).bit_length())
    sources = [decoded(r) for r in runs]
    string: list[bytes | None] = [next(s, (None, 0))[0] for s in sources] + [None] * (k - len(runs))
    lcp = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is the one shared with the winner from now on."""
        sa, sb = string[a], string[b]
        if sa is None or sb is None:
            return (b, a) if sa is None else (a, b)
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        n = shared(sa, sb, la)
        a_first = n == len(sa) and (n < len(sb) or a < b) or n < len(sa) and n < len(sb) and sa[n] < sb[n]
        w, x = (a, b) if a_first else (b, a)
        lcp[x] = n
        return w, x

    loser, level = [0] * (2 * k), list(range(k))
    at = k
    while len(level) > 1:
        at //= 2
        nxt = []
        for i in range(0, len(level), 2):
            w, x = play(level[i], level[i + 1])
            loser[at + i // 2] = x
            nxt.append(w)
        level = nxt
    w = level[0]
    while (s := string[w]) is not None:
        yield w, s, lcp[w]
        got = next(sources[w], None)
        string[w], lcp[w] = got if got else (None, 0)
        node = (w + k) // 2
        while node:
            w, loser[node] = play(w, loser[node])
            node //= 2


def dealt(data: bytes, anchor: int, first: int, last: int, least: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first window, number of windows): the windows of a segment by the bytes that all of STEP distances share."""
    import xxhash

    out = []
    for lo in range((anchor - last) // STEP * STEP, anchor - first + 1, STEP):
        hi = lo + STEP - 1
        far, near = max(lo, anchor - last), min(hi, anchor - first)
        key = xxhash.xxh64_intdigest(data[anchor - lo : max(anchor - lo, anchor + least - hi)], lo)
        out.append((key % buckets, anchor - near, near - far + 1))
    return out


def suffix_runs(docs: DataFrame, cands: DataFrame, buckets: int, least: int, gram: int) -> DataFrame:
    """(bucket, run binary columns): front-coded suffixes and reversed lead texts of the candidates, with their places."""
    spot = F.col("spot") * 2 + F.col("hot").cast("long")
    per_doc = cands.groupBy("id", "dup").agg(F.collect_list(spot).alias("spots"))
    held = docs.join(per_doc, (F.col("_key") == F.col("id")) & (F.col("_dup") == F.col("dup"))).select("_key", "_dup", "_text", "spots")
    span = least - gram

    def run(batches):
        schema = pa.schema([("bucket", pa.int32()), ("right", pa.binary()), ("left", pa.binary()), ("rows", pa.binary()), ("order", pa.binary())])

        def runs(rows):
            # rows: bucket, right, left, id, dup, anchor, first, windows
            by: dict[int, list] = {}
            for r in rows:
                by.setdefault(r[0], []).append(r)
            out = []
            for bucket, own in by.items():
                own.sort(key=lambda r: r[1])
                place = np.array([r[3:] for r in own], np.int64)
                left = sorted(range(len(own)), key=lambda i: own[i][2])
                out.append((bucket, front_coded([r[1] for r in own]), front_coded([own[i][2] for i in left]), place.tobytes(), np.array(left, np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        for b in batches:
            for who, dup, text, spots in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8", "replace")
                g, _, first, last, anchor = segments(data, least, gram)
                spots = np.sort(np.array(spots, np.int64))
                for k, hot in zip(np.searchsorted(first, spots // 1024).tolist(), (spots & 1).tolist(), strict=True):
                    a, f, l_ = int(anchor[k]), int(first[k]), int(last[k])
                    parts = dealt(data, a, f, l_, least, buckets) if hot else [(int(g[k] % np.uint64(buckets)), f, l_ - f + 1)]
                    rows += [(bucket, data[a : a + least], data[max(0, a - span) : a][::-1], who, dup, a, begin, n) for bucket, begin, n in parts]
                if len(rows) >= RUN:
                    yield runs(rows)
                    rows = []
        if rows:
            yield runs(rows)

    return held.mapInArrow(run, "bucket int, right binary, left binary, rows binary, order binary")


def _depths(order: list[np.ndarray], runs: list[bytes], n_before: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all strings (row numbers), and the prefix shared with the string before."""
    rank, lcp = np.empty(total, np.int64), np.empty(total, np.int64)
    seen = [0] * len(runs)
    for k, (r, _, n) in enumerate(merge(runs)):
        rank[k] = n_before[r] + (seen[r] if order is None else order[r][seen[r]])
        lcp[k] = n
        seen[r] += 1
    return rank, lcp


def repeated_windows(group: list[dict], least: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(id, dup, first byte, byte after) of windows of a bucket that also start earlier."""
    places = [np.frombuffer(r["rows"], np.int64).reshape(-1, 5) for r in group]
    sizes = [len(p) for p in places]
    before = np.concatenate(([0], np.cumsum(sizes)))
    rows, total = np.concatenate(places), int(before[-1])
    right_order, right_lcp = _depths(None, [r["right"] for r in group], before, total)
    left_order, left_lcp = _depths([np.frombuffer(r["order"], np.int32) for r in group], [r["left"] for r in group], before, total)
    who, dup, anchor, first, windows = rows.T
    # place of each row in (id, dup, first window) order: the earliest window of a class is that of its least row and start
    by_place = np.lexsort((first, dup, who))
    age = np.empty(total, np.int64)
    age[by_place] = np.arange(total)
    marks = []
    near, far = anchor - first, anchor - (first + windows - 1)  # largest and smallest distance
    right_class, left_class = np.empty(total, np.int64), np.empty(total, np.int64)
    for d in range(int(far.min()), int(near.max()) + 1):
        rows_d = np.flatnonzero((far <= d) & (near >= d))
        if len(rows_d) < 2:
            continue
        right_class[right_order] = np.cumsum(right_lcp < least - d)
        left_class[left_order] = np.cumsum(left_lcp < d)
        key = right_class[rows_d] * (total + 1) + left_class[rows_d]
        order = np.lexsort((age[rows_d], key))
        key, own = key[order], rows_d[order]
        later = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(later):
            marks.append(np.stack([own[later], anchor[own[later]] - d]))
    if not marks:
        return []
    row, start = np.concatenate(marks, axis=1)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)])
    ends = np.r_[new[1:], len(row)] - 1
    return list(zip(who[row[new]].tolist(), dup[row[new]].tolist(), start[new].tolist(), (start[ends] + least).tolist(), strict=True))


def marked_runs(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """(id, dup, spans array of (from, to)): byte runs that a repeated string covers. docs: _key, _dup, _text."""
    found = anchors(docs.select("_key", "_dup", "_text"), least, gram)
    from pyspark.sql import Window

    by_anchor = found.repartition("g")
    same = Window.partitionBy("g", "c").orderBy("copy", "id", "dup", "spot")
    anchor = Window.partitionBy("g")
    ranked = by_anchor.withColumn("n", F.row_number().over(same))
    ranked = ranked.withColumn("firsts", F.count(F.when((F.col("n") == 1) & ~F.col("copy"), True)).over(anchor))
    # equal segments: all but the first repeat; distinct segments around one anchor: compared by bytes
    copy = F.col("copy") | (F.col("n") > 1)
    shared_anchor = staged(ranked.where(copy | (F.col("firsts") > 1)).select("g", "id", "dup", "spot", copy.alias("copy"), (F.col("firsts") > HOT).alias("hot")), "shared-anchors")
    start = F.floor(F.col("spot") / 512).cast("long")
    whole = shared_anchor.where("copy").select("id", "dup", start.alias("lo"), (start + F.pmod("spot", F.lit(512)) + least).alias("hi"))
    cands = shared_anchor.where(~F.col("copy"))
    buckets = parts_for(cands.count() + cands.where("hot").count() * (-(-(least - gram + 1) // STEP)), BUCKET, 1)
    runs = suffix_runs(docs, cands, buckets, least, gram)

    def resolve(group: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("dup", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])
        got = repeated_windows(group.select(["right", "left", "rows", "order"]).to_pylist(), least, gram)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema) if got else schema.empty_table()

    part = runs.groupBy("bucket").applyInArrow(resolve, "id long, dup int, lo long, hi long")
    spans = F.array_sort(F.collect_list(F.struct("lo", "hi")))
    return whole.unionByName(part).groupBy("id", "dup").agg(spans.alias("spans"))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keyed = row_key(docs, id_col, text_col)
    return keyed.select(F.coalesce("_id", F.lit(NULL_ID)).alias("_key"), "_id", "_dup", "_text")


def union_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of spans sorted by start; touching ones are one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        lo, hi = s["lo"], s["hi"]
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", details: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256; with `details` also kept (binary) and spans."""
    base = _prepared(docs, id_col, text_col)
    marks = marked_runs(base, least, gram)
    held = base.join(marks, (F.col("_key") == F.col("id")) & (F.col("_dup") == F.col("dup")), "left").select("_id", "_text", "spans")
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<lo:long,hi:long>>" * details
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            sizes, gone, count, sums, kept, cut = [], [], [], [], [], []
            for text, spans in zip(b.column("_text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                runs = union_of(spans or [])
                edges = [0, *(x for r in runs for x in r), len(data)]
                left = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)) if runs else data
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                count.append(len(runs))
                sums.append(hashlib.sha256(left).hexdigest())
                if details:
                    kept.append(left)
                    cut.append([{"lo": lo, "hi": hi} for lo, hi in runs])
            cols = [b.column("_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())]
            if details:
                cols += [pa.array(kept, pa.binary()), pa.array(cut, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "kept", "spans"] if details else names)

    return held.mapInArrow(run, schema)


def cut_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, without repeated byte strings; what a cut leaves of a character goes too."""
    base = _prepared(docs, id_col, text_col)
    marks = marked_runs(base, least, gram).select(F.col("id").alias("_mark_id"), F.col("dup").alias("_mark_dup"), F.col("spans").alias("_mark_spans"))
    names, key = docs.columns, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    own = docs.withColumn("_mark_n", F.lit(0))
    if not base.where("_dup > 0").isEmpty():
        from pyspark.sql import Window

        order = Window.partitionBy(F.col(id_col).cast("long")).orderBy(F.xxhash64(F.col(text_col).cast("string")), F.length(text_col))
        own = docs.withColumn("_mark_n", (F.row_number().over(order) - 1).cast("int"))
    own = own.join(marks, (key == F.col("_mark_id")) & (F.col("_mark_n") == F.col("_mark_dup")), "left").select(*names, "_mark_spans")

    def run(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column(text_col).to_pylist(), b.column("_mark_spans").to_pylist(), strict=True):
                if spans:
                    data, at, left = text.encode("utf-8", "replace"), 0, []
                    for lo, hi in union_of(spans):
                        left.append(data[at:lo])
                        at = hi
                    text = b"".join([*left, data[at:]]).decode("utf-8", "ignore")
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if n == text_col else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return own.mapInArrow(run, docs.schema)
