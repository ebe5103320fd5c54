"""A stored text index that is kept up to date by generations.

A folder holds tables, each with a folder for every generation (`gen=<n>`):

* `postings`: session_id, line_no, len, term, tf, in one folder a bucket of the term, sorted by term.
* `grams`: each distinct term of the generation under each of its three-letter parts, in one folder a bucket of
  the part; terms stand there with their bucket. Words of one or two letters are looked up in `terms`, the vocabulary itself.
* `sessions`: for each session of the generation its manifest (size, mtime), its number of messages and
  of words, and whether it was deleted.

An update writes one more generation with the new and changed sessions and, for deleted ones, their manifest alone. A
posting counts if its generation is the newest of its session, so the manifests of later generations are
the tombstones of earlier postings. Nothing is rewritten until `compact`, which writes the live postings as one
generation in a folder of its own. An update that runs again overwrites its own generation.

A search of a word looks up its parts, which gives the terms that hold it, and reads only the buckets of postings
that those terms lie in; both are partition filters known when the query is planned. The number of messages with a word is
exact, which takes all postings of its terms: bounds on blocks of postings would not spare reading them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from .stages import written

#: Buckets of terms and of parts.
BUCKETS, PARTS = 64, 64
KEYS = ["session_id", "line_no"]
GRAM = 3


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _grams(term: Column) -> Column:
    return F.when(F.length(term) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) - GRAM + 1), lambda i: F.substring(term, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _write(messages: DataFrame, manifest: DataFrame, folder: str, gen: int) -> None:
    """manifest: session_id, size, mtime, deleted; messages: those of its sessions that are there."""
    spark = messages.sparkSession
    typed = messages.withColumns({"session_id": F.col("session_id").cast("string"), "line_no": F.col("line_no").cast("long")})
    # texts are shuffled by session, so that their words, which are more, are counted without a shuffle
    own = typed.join(manifest.where("NOT deleted").select("session_id").hint("shuffle_hash"), "session_id", "left_semi")
    at = f"{folder}/postings/gen={gen}"
    rows = search.postings(own, KEYS).withColumn("bucket", _bucket(F.col("term"), BUCKETS))
    rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(at)
    kept = spark.read.schema(rows.schema).parquet(at)
    terms = kept.select("term", "bucket").distinct()
    terms.write.mode("overwrite").parquet(f"{folder}/terms/gen={gen}")
    stored = spark.read.schema(terms.schema).parquet(f"{folder}/terms/gen={gen}")
    grams = stored.select("term", "bucket", F.explode(_grams(F.col("term"))).alias("gram")).withColumn("part", _bucket(F.col("gram"), PARTS))
    grams.repartition("part").sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/grams/gen={gen}")
    sizes = kept.groupBy(*KEYS).agg(F.first("len").alias("len")).groupBy("session_id").agg(F.count("*").alias("n_docs"), F.sum("len").alias("n_words"))
    filled = manifest.join(sizes, "session_id", "left").select("session_id", "size", "mtime", "deleted", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"))
    filled.write.mode("overwrite").parquet(f"{folder}/sessions/gen={gen}")


_KINDS = {
    "postings": "session_id string, line_no long, len int, term string, tf long, gen int, bucket int", "terms": "term string, bucket int, gen int",
    "grams": "term string, bucket int, gram string, gen int, part int", "sessions": "session_id string, size long, mtime long, deleted boolean, n_docs long, n_words long, gen int",
}


def _read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return spark.read.schema(_KINDS[kind]).parquet(f"{folder}/{kind}")


def create(messages: DataFrame, manifest: DataFrame, folder: str) -> None:
    """The first generation. manifest: session_id, size, mtime of all sessions; messages: session_id, line_no, role, text."""
    _write(messages, written(_typed(manifest), "manifest"), folder, 0)


def _typed(manifest: DataFrame, deleted: Column | None = None) -> DataFrame:
    return manifest.select(F.col("session_id").cast("string").alias("session_id"), F.col("size").cast("long").alias("size"), F.col("mtime").cast("long").alias("mtime"), (F.lit(False) if deleted is None else deleted).alias("deleted"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, size, mtime, deleted, n_docs, n_words, gen): the newest entry of each session, deleted ones too."""
    rows = _read(spark, folder, "sessions")
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct("size", "mtime", "deleted", "n_docs", "n_words", "gen"), "gen").alias("x"))
    return newest.select("session_id", "x.*")


def update(messages: DataFrame, now: DataFrame, folder: str) -> int:
    """Write what has changed since as one more generation; returns its number. now: the manifest of all sessions there are.

    Only the messages of new and changed sessions are indexed. Without a change no generation is written."""
    spark = messages.sparkSession
    known = manifest(spark, folder)
    last = known.agg(F.max("gen")).first()[0] or 0
    was = known.where("NOT deleted").select("session_id", F.struct("size", "mtime").alias("_was"))
    both = _typed(now).withColumn("_now", F.struct("size", "mtime")).join(was, "session_id", "full")
    changed = written(both.where(~F.col("_now").eqNullSafe(F.col("_was"))).withColumn("deleted", F.col("_now").isNull()).drop("_now", "_was"), "changed")
    if changed.isEmpty():
        return last
    _write(messages, changed, folder, last + 1)
    return last + 1


def live(spark: SparkSession, folder: str, posting: DataFrame | None = None) -> DataFrame:
    """Postings of the newest generation of each session that is there."""
    rows = _read(spark, folder, "postings") if posting is None else posting
    return rows.join(manifest(spark, folder).where("NOT deleted").select("session_id", "gen"), ["session_id", "gen"], "left_semi")


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Write the live index as one generation in folder `to`."""
    known = manifest(spark, folder).where("NOT deleted")
    live(spark, folder).drop("gen").repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{to}/postings/gen=0")
    kept = spark.read.schema(_KINDS["postings"].replace(", gen int", "")).parquet(f"{to}/postings/gen=0")
    kept.select("term", "bucket").distinct().write.parquet(f"{to}/terms/gen=0")
    terms = spark.read.schema("term string, bucket int").parquet(f"{to}/terms/gen=0")
    grams = terms.select("term", "bucket", F.explode(_grams(F.col("term"))).alias("gram")).withColumn("part", _bucket(F.col("gram"), PARTS))
    grams.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{to}/grams/gen=0")
    known.drop("gen").write.parquet(f"{to}/sessions/gen=0")


def terms_with(spark: SparkSession, folder: str, word: str) -> DataFrame:
    """(term, bucket): the terms that contain a word."""
    if len(word) < GRAM:
        return _read(spark, folder, "terms").where(F.contains("term", F.lit(word))).select("term", "bucket").distinct()
    parts = sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
    wanted = F.lit(False)
    for g in parts:
        wanted = wanted | ((F.col("part") == _bucket(F.lit(g), PARTS)) & (F.col("gram") == g))
    held = _read(spark, folder, "grams").where(wanted).groupBy("term", "bucket").agg(F.count_distinct("gram").alias("n"))
    return held.where((F.col("n") == len(parts)) & F.contains("term", F.lit(word))).select("term", "bucket")


def matching(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """Live postings whose term contains one of the words. What goes through the driver are numbers of buckets."""
    found = terms_with(spark, folder, words[0])
    for w in words[1:]:
        found = found.unionByName(terms_with(spark, folder, w))
    found = found.distinct()
    buckets = sorted(r[0] for r in found.select("bucket").distinct().collect())
    rows = _read(spark, folder, "postings").where(F.col("bucket").isin(buckets))
    return live(spark, folder, rows.join(found, ["bucket", "term"], "left_semi"))


def bm25(spark: SparkSession, folder: str, query: list[str]) -> DataFrame:
    """(session_id, line_no, score): messages that hold every query word as part of some word."""
    words = sorted(set(query))
    if not words:
        return _read(spark, folder, "postings").select(*KEYS, F.lit(0.0).alias("score")).limit(0)
    total = manifest(spark, folder).where("NOT deleted").agg(F.sum("n_docs").alias("n_docs"), (F.sum("n_words") / F.sum("n_docs")).alias("avg_len"))
    return search.bm25(matching(spark, folder, words), KEYS, words, total)
