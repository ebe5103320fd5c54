"""Quality rules: counts over whole texts and cross-document line frequency.

DataFrame functions only. One pass over the texts stores per document its counts and
the hashes of its distinct lines; everything after that works on the small table.

* A line is normalised (lower case, blanks to one space, trimmed, digits to 0) and hashed.
* Per host and line the distinct documents that hold it are counted: rows of a host with one
  text are one document, and a line counts once in each, however often it stands there.
* A line is over the limit if more than `max(line_docs, line_share * distinct documents of
  the host)` of them hold it. Such lines are removed.
* A document is depleted, and rejected, if fewer than `least_words` words or less than
  `least_share` of its words are left.

Defined cases: a null text has no words and fails the base rule; a null host is a host of
its own; null ids are kept; repeated rows are judged alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, staged

WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), BLANKS, " "), "[0-9]", "0"))


def line_hash(line: Column) -> Column:
    """60 bits of MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(normalised(line)), 1, 15), 16, 10).cast("long")


def repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window which the text holds at least twice."""

    def covered(wins: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
            starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

        pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(let(pairs, of_sorted))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(let(hashes, windows), covered))


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: base counts and `lines` (array of hash, words) of its distinct lines with a word."""
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("_host"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))
    counts = let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    dups = let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.transform(x, kept).alias("lines")))
    return base.select(
        "_id", "_host", F.xxhash64("_text").alias("_hash"), counts.alias("c"), dups.alias("d"),
        F.length(F.regexp_replace("_text", BLANKS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    ).select("_id", "_host", "_hash", "c.*", "word_chars", "n_symbols", "d.*")


def frequent_lines(profiles: DataFrame, line_docs: int, line_share: float) -> DataFrame:
    """(_host, h, n_docs): lines over the limit of their host. Equal texts of a host are one document."""
    documents = profiles.groupBy("_host", "_hash").agg(F.first("lines.h").alias("hs"))
    held = documents.select("_host", F.explode(F.array_distinct("hs")).alias("h"))
    counted = held.groupBy("_host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_docs)
    hosts = profiles.select("_host", "_hash").distinct().groupBy("_host").agg(F.count("*").alias("host_docs"))
    return counted.join(hosts, "_host").where(F.col("n_docs") > F.col("host_docs") * line_share).select("_host", "h", "n_docs")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_docs: int = 20, line_share: float = 0.005, least_words: int = 20, least_share: float = 0.3,
) -> DataFrame:
    """One row per document: the counts, `base_failed`, `kept`, and `over` (hashes of its lines over the limit)."""
    marked = profile(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id())
    profiles = staged(marked, "line-profiles")
    lines = profiles.select("_row", "_host", F.explode("lines").alias("x")).select("_row", "_host", "x.h", "x.n")
    gone = lines.join(frequent_lines(profiles, line_docs, line_share), ["_host", "h"]).groupBy("_row").agg(F.sum("n").alias("gone"), F.collect_set("h").alias("over"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = F.col("gone").isNotNull() & ((left < least_words) | (left < least_share * F.col("n_words")))
    return profiles.join(gone, "_row", "left").select(F.col("_id").alias(id_col), "_host", "_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "over")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents, all their columns, without the lines over the limit."""
    verdicts = judge(docs, id_col, text_col, host_col, **limits).where("kept").select(F.col(id_col).alias("_quality_i"), F.col("_hash").alias("_quality_h"), F.col("_host").alias("_quality_o"), F.col("over").alias("_quality_over")).dropDuplicates(["_quality_i", "_quality_h", "_quality_o"])
    host = F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit(""))
    hashed = docs.withColumn("_quality_host_key", host).withColumn("_quality_text_key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_quality_i")) & (F.col("_quality_text_key") == F.col("_quality_h")) & (F.col("_quality_host_key") == F.col("_quality_o"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(F.col("_quality_over"), line_hash(x)))
    text = F.when(F.col("_quality_over").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return hashed.join(verdicts, same).select([text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
