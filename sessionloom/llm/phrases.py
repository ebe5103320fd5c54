"""Phrase collocations: exact counts of all frequent word sequences, per language.

Documents are dealt into shards of about SHARD words of one language. Each shard gets a
bidirectional FM-index over word ids and counts its word sequences by extending intervals;
the counts of all shards are summed. Three rounds keep what moves small and exact:

1. Words are counted. Only words at or over the limit get a (global) id; the others end a piece,
   for no frequent phrase holds them.
2. Each shard builds its index and counts its pairs. Counts travel as sorted arrays, one for each
   shard and range of keys, and are summed range by range; each shard is told which of its pairs
   are frequent.
3. Each shard extends frequent pairs to the left, and triples to the right, by frequent pairs
   only, and its counts of both are summed likewise.

A phrase is cut in two where it holds together worst (`collocations`).

A long text, or a long piece of it, that fills a shard goes on in the next: that begins with the
last three words again, and a shard of those three words with the sign -1 takes away what is
counted twice. So no text, piece, language or word has to fit into one task, and a word has at most one row
a shard.

Defined cases: null and empty texts have no words; a null language is `und`; repeated rows and
repeated ids count each; punctuation alone makes no word; ties of the score go by count, then by the phrase's
bytes; an empty table gives no phrase. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, numbered, parts_for, staged
from .fmindex import DEPTH, Index, Patterns, transform

#: Words of a shard; counts of a range; bytes of a text that are split at once.
SHARD, RANGE, SLICE = 1 << 21, 1 << 21, 1 << 20

# The contract's characters that end a piece, and the blanks between words. No UTF-8 text holds byte 255.
_MARK = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz" + _MARK * 10 + b" ")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, slice by slice, and a mark for each end of a piece."""
    text, at = text.translate(_BYTES), 0
    while at < len(text):
        ends = [e for e in (text.find(b" ", at + SLICE), text.find(_MARK, at + SLICE)) if e >= 0]
        end = min(ends, default=len(text))
        yield text[at:end].replace(_MARK, b" \xff ").split()
        at = end


class _Shard:
    """Words of one language, numbered as they come; 0 is the mark."""

    def __init__(self, begin: list[bytes] = ()) -> None:
        self.ids: dict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.parts, self.size = [], 0
        self.add([_MARK, *begin])

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def last(self) -> list[bytes]:
        """The last words of an open piece, as many as a phrase can share with what follows."""
        tail = np.concatenate(self.parts)[1 - DEPTH :].tolist()
        names = list(self.ids)
        return [names[k] for k in tail[len(tail) - tail[::-1].index(0) if 0 in tail else 0 :]]

    def row(self, lang: str, number: int, sign: int) -> tuple:
        self.add([_MARK])
        text = np.concatenate(self.parts)
        counts = np.bincount(text, minlength=len(self.ids))
        packed = zstandard.compress(text.astype("<i4").tobytes(), 1)
        return number, sign, lang, int(counts[1:].sum()), [w.decode() for w in list(self.ids)[1:]], counts[1:].tolist(), packed


_SHARDS = pa.schema([("shard", pa.int64()), ("sign", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("text", pa.binary())])


def shards_of(docs: DataFrame, text_col: str, lang_col: str, size: int) -> DataFrame:
    """(shard, sign, lang, n, words, counts, text): the whole table in shards, as word ids of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_shards, total = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, {}, 0

        def close(lang: str) -> list[tuple]:
            nonlocal number
            old = open_shards.pop(lang)
            tail, number = old.last(), number + 2
            rows = [old.row(lang, number - 2, 1)]
            if tail:
                open_shards[lang] = _Shard(tail)
                rows.append(_Shard(tail).row(lang, number - 1, -1))
            return rows

        def batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, _SHARDS)], schema=_SHARDS)

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for words in words_of(text.as_py()):
                    shard = open_shards.get(lang) or open_shards.setdefault(lang, _Shard())
                    shard.add(words)
                    total += len(words)
                    if shard.size >= size:
                        total -= shard.size
                        yield from batch(close(lang))
                if lang in open_shards:
                    open_shards[lang].add([_MARK])
            if total > 2 * size:  # many languages at once
                for lang in list(open_shards):
                    yield from batch(close(lang))
                total = 0
        for lang in list(open_shards):
            yield from batch(close(lang))

    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return staged(own.mapInArrow(cut, "shard long, sign int, lang string, n long, words array<string>, counts array<long>, text binary"), "phrase-shards")


# -- counts between shards

_COUNTS = "shard long, range int, hi binary, lo binary, n binary"


def _spread(hi: np.ndarray, lo: np.ndarray, ranges: int) -> np.ndarray:
    x = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(ranges)


def _messages(shard: int, hi: np.ndarray, lo: np.ndarray, n: np.ndarray, ranges: int) -> Iterator[tuple]:
    """A shard's counts, one row for each range of keys."""
    to = _spread(hi, lo, ranges)
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(to[order]) > 0)) if len(to) else []
    for k in np.split(order, starts[1:]) if len(to) else []:
        yield shard, int(to[k[0]]), hi[k].astype("<i8").tobytes(), lo[k].astype("<i8").tobytes(), n[k].astype("<i8").tobytes()


def _column(table: pa.Table, name: str, sizes: bool = False):
    blobs = [x for x in table.column(name).to_pylist()]
    found = np.frombuffer(b"".join(blobs), "<i8")
    return (found, [len(x) // 8 for x in blobs]) if sizes else found


def summed(messages: DataFrame, least: int, reply: bool) -> DataFrame:
    """(hi, lo, f): the sums of at least `least`; with `reply` also (shard, keys): those among each shard's keys."""

    def total(table: pa.Table) -> pa.Table:
        hi, sizes = _column(table, "hi", True)
        lo, n = _column(table, "lo"), _column(table, "n")
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        sums = np.add.reduceat(n[order], starts)
        often = sums >= least
        k = starts[often]
        out = [(pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.binary()), pa.array(a[k]), pa.array(b[k]), pa.array(sums[often]))]
        if reply:
            told = np.empty(len(hi), bool)
            told[order] = np.repeat(often, np.diff(np.append(starts, len(hi))))
            ends = np.cumsum(sizes)
            keys = [hi[e - s : e][told[e - s : e]].tobytes() for e, s in zip(ends, sizes)]
            none = pa.nulls(len(keys), pa.int64())
            out.append((table.column("shard").combine_chunks(), pa.array(keys, pa.binary()), none, none, none))
        names = ["shard", "keys", "hi", "lo", "f"]
        return pa.concat_tables([pa.table(list(x), names) for x in out])

    return staged(messages.groupBy("range").applyInArrow(total, "shard long, keys binary, hi long, lo long, f long"), "phrase-sums")


def _rows(kind: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in kind.split(", ")))
    for r in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], types[k]) for x, k in zip(r, kinds)], list(names))


_INDEXED = _COUNTS + ", sign int, forward binary, backward binary, names binary"


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), "<i4")


def indexed(shards: DataFrame, known: DataFrame, ranges: int) -> DataFrame:
    """Each shard's index over the frequent words, and its counts of pairs. known: (shard, ids of (place, id))."""

    def one(shard: int, sign: int, text: np.ndarray, places: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        names = np.sort(ids)
        own = np.zeros(max(int(text.max(initial=0)), int(places.max(initial=0))) + 1, np.int32)
        own[places] = np.searchsorted(names, ids) + 1
        text = own[text]
        text = text[np.append(True, (text[1:] != 0) | (text[:-1] != 0))]
        forward, backward = transform(text), transform(text[::-1])
        index = Index(forward, backward)
        parent, word, pairs = index.left(index.single)
        key = names[word - 1] << 32 | names[index.ids[parent] - 1]
        none = [None] * 4
        yield from ((*m, sign, *none[1:]) for m in _messages(shard, key, np.zeros_like(key), sign * pairs.size, ranges))
        yield (shard, *none, sign, *(zstandard.compress(x.astype("<i4").tobytes(), 1) for x in (forward, backward)), names.astype("<i8").tobytes())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                ids = r["ids"].values
                yield from _rows(_INDEXED, one(r["shard"].as_py(), r["sign"].as_py(), _unpacked(r["text"].as_py()), ids.field("at").to_numpy(), ids.field("id").to_numpy()))

    return staged(shards.select("shard", "sign", "text").join(known, "shard").mapInArrow(build, _INDEXED), "phrase-indexes")


def extended(indexes: DataFrame, frequent: DataFrame, ranges: int) -> DataFrame:
    """Each shard's counts of sequences of three and four words, all of whose pairs are frequent. frequent: (shard, keys)."""

    def one(shard: int, sign: int, index: Index, names: np.ndarray, often: np.ndarray) -> Iterator[tuple]:
        def chosen(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            key = names[first - 1] << 32 | names[second - 1]
            at = np.minimum(np.searchsorted(often, key), len(often) - 1)
            return np.flatnonzero(often[at] == key)

        def sent(p: Patterns, *words: np.ndarray) -> Iterator[tuple]:
            ids = [names[w - 1] for w in words] + [np.zeros(len(p.size), np.int64)] * (DEPTH - len(words))
            yield from _messages(shard, ids[0] << 32 | ids[1], ids[2] << 32 | ids[3], sign * p.size, ranges)

        parent, a, two = index.left(index.single)
        b = index.ids[parent]
        k = chosen(a, b)
        a, b, two = a[k], b[k], two[k]
        parent, x, three = index.left(two)
        k = chosen(x, a[parent])
        x, a, b, three = x[k], a[parent[k]], b[parent[k]], three[k]
        yield from sent(three, x, a, b)
        parent, y, four = index.right(three)
        k = chosen(b[parent], y)
        parent = parent[k]
        yield from sent(four[k], x[parent], a[parent], b[parent], y[k])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                often = np.sort(np.frombuffer(b"".join(r["keys"]), "<i8"))
                if len(often):
                    index = Index(_unpacked(r["forward"]), _unpacked(r["backward"]))
                    yield from _rows(_COUNTS, one(r["shard"], r["sign"], index, np.frombuffer(r["names"], "<i8"), often))

    replies = frequent.where(F.octet_length("keys") > 0).groupBy("shard").agg(F.collect_list("keys").alias("keys"))
    return indexes.where("forward IS NOT NULL").select("shard", "sign", "forward", "backward", "names").join(replies, "shard").mapInArrow(extend, _COUNTS)


# -- phrases


def _ids() -> Column:
    low = (1 << 32) - 1
    every = [F.shiftright("hi", 32), F.col("hi").bitwiseAND(low), F.shiftright("lo", 32), F.col("lo").bitwiseAND(low)]
    return F.filter(F.array(*every), lambda x: x > 0)


def _key(ids: Column) -> list[Column]:
    """hi and lo of an array of one to four ids."""
    at = [F.coalesce(F.get(ids, F.lit(k)), F.lit(0)) for k in range(DEPTH)]
    return [F.shiftleft(at[0], 32).bitwiseOR(at[1]), F.shiftleft(at[2], 32).bitwiseOR(at[3])]


def grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, shard: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hi, lo, f) of every sequence of one to four words with at least `least` occurrences in its language;
    (id, lang, word) of its words; (lang, n) of all words."""
    shards = shards_of(docs, text_col, lang_col, shard or SHARD)
    totals = shards.groupBy("lang").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))
    held = shards.select("shard", "sign", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "sign", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("own"))
    counted = held.groupBy("lang", "word").agg(F.sum(F.col("sign") * F.col("own")).alias("f")).where(F.col("f") >= least)
    words = staged(numbered(staged(counted, "phrase-counts"), [F.col("lang"), F.col("word")], "phrase-places").select("lang", "word", "f", (F.col("_pos") + 1).alias("id")), "phrase-words")
    if words.count() >= 1 << 31:
        raise ValueError("more frequent words than ids")
    known = held.join(words, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id")).alias("ids"))
    ranges = parts_for(shards.agg(F.sum("n")).first()[0] or 0, RANGE)
    indexes = indexed(shards, known, ranges)
    pairs = summed(indexes.where("hi IS NOT NULL").select("shard", "range", "hi", "lo", "n"), least, True)
    longer = summed(extended(indexes, pairs.where("keys IS NOT NULL").select("shard", "keys"), ranges), least, False)
    totals = staged(totals, "phrase-totals")
    forget(indexes)
    forget(shards)
    found = words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f")
    return found.unionByName(pairs.where("f IS NOT NULL").select("hi", "lo", "f")).unionByName(longer.select("hi", "lo", "f")), words, totals


def scored(found: DataFrame) -> DataFrame:
    """(hi, lo, a, l, r, score, contained) of every sequence of two to four words.

    The cut with the lowest score counts, of equal ones the first. `contained` is the largest count of a longer one that holds it."""
    many = found.withColumn("ids", _ids())
    cut = many.where(F.size("ids") > 1).select("hi", "lo", "f", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    left, right = _key(F.slice("ids", F.lit(1), F.col("k"))), _key(F.slice("ids", F.col("k") + 1, F.lit(DEPTH)))
    cut = cut.select("hi", "lo", "f", "k", left[0].alias("l_hi"), left[1].alias("l_lo"), right[0].alias("r_hi"), right[1].alias("r_lo"))
    for side in "lr":
        cut = cut.join(found.select(F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"), F.col("f").alias(side)), [f"{side}_hi", f"{side}_lo"])
    score = F.expr("(CAST(f AS DECIMAL(19, 0)) * 2000000) DIV (CAST(l AS DECIMAL(19, 0)) + r)")
    worst = cut.groupBy("hi", "lo", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda i: F.slice("ids", i, F.lit(2)))
    triples = F.when(F.size("ids") == 4, F.array(F.slice("ids", 1, 3), F.slice("ids", 2, 3)))
    parts = F.when(triples.isNull(), pairs).otherwise(F.concat(pairs, triples))
    inner = many.where(F.size("ids") > 2).select("f", F.explode(parts).alias("ids"))
    inner = inner.select(*[c.alias(n) for c, n in zip(_key(F.col("ids")), ("hi", "lo"))], "f").groupBy("hi", "lo").agg(F.max("f").alias("contained"))
    return worst.join(inner, ["hi", "lo"], "left").select("hi", "lo", F.col("f").alias("a"), "x.l", "x.r", "x.score", "contained")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, share: int = 80, top: int | None = 2000, shard: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of each language that hold together best.

    Phrases inside a longer one that has at least `share` per cent of their occurrences are left out."""
    found, words, totals = grams(docs, text_col, lang_col, least, shard)
    found = staged(found, "phrase-grams")
    lone = F.col("contained").isNull() | (F.col("contained").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * share)
    kept = scored(found).where(lone)
    named = kept.select("hi", "lo", "a", "l", "r", "score", F.posexplode(_ids()).alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase")
    phrases = named.groupBy("hi", "lo", "a", "l", "r", "score", "lang").agg(phrase)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
