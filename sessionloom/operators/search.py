"""Inverted index with BM25, and field-weighted BM25 over written records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Fixed values of the ranking and of the display.
K1, B, HEAD_WEIGHT = 1.2, 0.75, 3
SHOWN, PER_SESSION, POOL = 20, 3, 100


def index_words(text) -> Column:
    """Folded words of the whole redacted text, long ones left out."""
    return F.filter(X.words(X.redact(X.nn(text))), lambda w: F.length(w) <= X.MAX_WORD)


def searchable(messages: DataFrame) -> DataFrame:
    """Messages of users and assistants that have a text, without the noise of users. Without a column `role` all are users'."""
    role = F.col("role") if "role" in messages.columns else F.lit("user")
    said = X.nn("text") != ""
    return messages.where(role.isin("user", "assistant") & said & ~((role == "user") & X.is_noise(X.nn("text"))))


def postings(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, tf, len): one row per word of a searchable message; the words are counted map-side."""
    worded = searchable(messages).select(*keys, index_words("text").alias("w"))
    # outer: Spark filters what an inner one explodes, which would find the words of every message twice
    rows = worded.select(*keys, F.size("w").alias("len"), F.explode_outer("w").alias("term")).where("term IS NOT NULL")
    return rows.groupBy(*keys, "len", "term").agg(F.count("*").alias("tf"))


def corpus(posting: DataFrame, keys: list[str]) -> DataFrame:
    """One row: number of documents and mean length."""
    return posting.groupBy(*keys).agg(F.first("len").alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def statistics(messages: DataFrame) -> DataFrame:
    """The same one row, from the messages themselves: no posting is made for it."""
    sizes = searchable(messages).select(F.size(index_words("text")).alias("len"))
    worded = F.when(F.col("len") > 0, F.col("len"))  # no filter: the words would be found twice
    return sizes.agg(F.count(worded).alias("n_docs"), F.avg(worded).alias("avg_len"))


def bm25(posting: DataFrame, keys: list[str], query: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(keys, score): documents in which every query word is part of some word.

    A query word counts all words that contain it. Only matching postings are shuffled. stats: one row of n_docs and
    avg_len, where postings are not those of the whole corpus."""
    words = sorted(set(query))
    if not words:
        return posting.select(*keys, F.lit(0.0).alias("score")).limit(0)
    hit = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("term"), w))
    matched = posting.where(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("term"), w)))
    per = matched.select(*keys, "len", "tf", F.explode(hit).alias("word")).groupBy(*keys, "len", "word").agg(F.sum("tf").alias("tf"))
    df = per.groupBy("word").agg(F.count("tf").alias("df"))  # a row per query word; with `tf`, so that both uses of `per` are one exchange
    stats = corpus(posting, keys) if stats is None else stats
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = per.join(F.broadcast(df), "word").crossJoin(F.broadcast(stats)).withColumn("part", part)
    return scored.groupBy(*keys).agg(F.sum("part").alias("score"), F.count("*").alias("found")).where(F.col("found") == len(words)).drop("found")


def ranked(scored: DataFrame, order: list, limit: int = SHOWN) -> DataFrame:
    return scored.orderBy(*order).limit(min(POOL, max(1, limit)))


def cap_hits(hits: DataFrame, session: str = "session_id", rank: str = "rank", per_session: int = PER_SESSION, shown: int = SHOWN) -> DataFrame:
    """At most `per_session` hits of a session and `shown` in all, best first; `more` counts what a session's last hit leaves out.

    hits: at most POOL rows with a rank."""
    within = F.row_number().over(Window.partitionBy(session).orderBy(rank))
    kept = hits.withColumn("in_session", within).withColumn("fits", F.col("in_session") <= per_session)
    running = F.sum(F.col("fits").cast("int")).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("show", F.col("fits") & (running <= shown))
    all_of = Window.partitionBy(session)
    left_out = F.count_if(~F.col("show")).over(all_of)
    last = F.max(F.when(F.col("show"), F.col(rank))).over(all_of)
    out = kept.withColumn("more", F.when(F.col(rank) == last, left_out).otherwise(0)).where("show")
    return out.drop("in_session", "fits", "show")


def contains_all(text, query: list[str]) -> Column:
    """Literal search: every query word is part of the folded text."""
    f = X.fold(text)
    out = F.lit(True)
    for w in query:
        out = out & F.contains(f, F.lit(w))
    return out


def occurrences(folded, word: str) -> Column:
    """How often a word is found, without overlaps."""
    return ((F.length(folded) - F.length(F.replace(folded, F.lit(word), F.lit("")))) / len(word)).cast("long")


#: Sections of a record and their weights.
SECTIONS = (("objective", 3.0), ("decisions", 2.0), ("files", 1.5), ("commits", 1.5), ("dead_ends", 1.5), ("pending", 1.5), ("left_out", 1.0), ("timeline", 1.0), ("briefing", 0.5))


def _weighted(word: str):
    return lambda total, s: total + s["weight"] * occurrences(s["text"], word)


def field_bm25(docs: DataFrame, query: list[str]) -> DataFrame:
    """(doc, score) of documents that hold every query word. docs: doc, head, sections array<struct<id, weight, text>>."""
    folded = docs.select("doc", X.fold("head").alias("head"), F.transform("sections", lambda s: F.struct(s["id"].alias("id"), s["weight"].alias("weight"), X.fold(s["text"]).alias("text"))).alias("secs"))
    length = F.greatest(F.lit(1), F.length("head") + F.aggregate("secs", F.lit(0), lambda a, s: a + F.length(s["text"])))
    rows = folded.withColumn("len", length)
    has = lambda w: F.contains("head", F.lit(w)) | F.exists("secs", lambda s: F.contains(s["text"], F.lit(w)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(has(w)).alias(f"df{i}") for i, w in enumerate(query)])
    score = F.lit(0.0)
    for i, w in enumerate(query):
        tf = HEAD_WEIGHT * occurrences(F.col("head"), w) + F.aggregate("secs", F.lit(0.0), _weighted(w))
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    every = F.lit(True)
    for w in query:
        every = every & has(w)
    found = F.filter(F.transform("secs", lambda s: F.struct((-F.size(F.filter(F.array(*map(F.lit, query)), lambda w: F.contains(s["text"], w)))).alias("f"), (-s["weight"]).alias("w"), s["id"].alias("id"))), lambda x: x["f"] < 0)
    return rows.crossJoin(F.broadcast(stats)).where(every).select("doc", F.round(score, 3).alias("score"), F.transform(F.slice(F.array_sort(found), 1, 3), lambda x: x["id"]).alias("sections"))


def record_hits(scored: DataFrame, limit: int = SHOWN) -> DataFrame:
    """The best records with `place`, highest score first, then by key; at most POOL, so that one task may number them."""
    best = scored.orderBy(F.desc("score"), "doc").limit(min(POOL, max(1, limit)))
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))
