"""Written records, logs and indexes as tables: read, append, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corrections

_CITES = "cites array<struct<session string, turn string>>"
_COMMIT = "array<struct<hash string, branch string, msg string, source string, ts string, pushed boolean, undone boolean>>"
RECORD = f"""key string, generated_at string, markdown string, sources array<string>,
 capsule struct<objective string, briefing string, timeline array<struct<date string, repo string, result string, {_CITES}>>,
  decisions array<struct<decision string, why string, uncertain boolean, {_CITES}>>, dead_ends array<struct<text string, {_CITES}>>,
  left_out array<struct<text string, {_CITES}>>, pending array<struct<text string, {_CITES}>>>,
 files array<struct<short string, edits bigint, status string, last string>>, commits struct<confirmed {_COMMIT}, possible {_COMMIT}>,
 unit struct<id string, source string, label string, keyed boolean, basis array<struct<session string, range array<int>>>>,
 reused_from struct<key string, label string, generated_at string>"""


def _there(read) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All readable records with a key; the newest of each key."""
    rows = _there(lambda: spark.read.schema(RECORD).option("multiLine", True).json(folder))
    if rows is None:
        return spark.createDataFrame([], RECORD)
    return newest(rows.where("key is not null"))


def newest(records: DataFrame) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc_nulls_last("generated_at"))
    return records.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def append_records(records: DataFrame, folder: str, now: str | None = None) -> None:
    """Add records; those without a date are stamped, reused ones keep theirs."""
    stamp = F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    records.withColumn("generated_at", F.coalesce("generated_at", stamp)).write.mode("append").json(folder)


def reuse(previous: DataFrame, records: DataFrame) -> DataFrame:
    """Copies of the records of vanished units for the units that hold their sessions now; they keep their date.

    previous: unit, previous, rank."""
    best = previous.where("rank = 1").select(F.col("previous").alias("key"), F.col("unit").alias("_new"))
    source = F.struct(F.col("key"), F.col("unit.label").alias("label"), F.col("generated_at"))
    rows = records.join(best, "key").withColumn("reused_from", source)
    return rows.withColumn("key", F.col("_new")).select(records.columns)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    rows = _there(lambda: spark.read.schema(corrections.OPS).json(path))
    return spark.createDataFrame([], corrections.OPS) if rows is None else rows.where("id is not null")


def append_corrections(ops: DataFrame, path: str) -> None:
    ops.where("id is not null").write.mode("append").json(path)


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings by bucket of the term, so that an exact term reads one folder."""
    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def write_file_index(links: DataFrame, path: str, key_pattern: str) -> None:
    """File links with the key pattern that they were made with."""
    links.withColumn("key_pattern", F.lit(key_pattern)).write.mode("overwrite").parquet(path)


def read_file_index(spark: SparkSession, path: str, key_pattern: str) -> DataFrame | None:
    """The stored links, None if there are none or if another pattern made them."""
    rows = _there(lambda: spark.read.parquet(path))
    if rows is None or not rows.where(F.col("key_pattern") != key_pattern).isEmpty():
        return None
    return rows.drop("key_pattern")


def export_units(units: DataFrame, path: str) -> None:
    units.write.mode("overwrite").json(path)


def sections(records: DataFrame) -> DataFrame:
    """(key, sections): the searchable text of each record, by section with its weight; empty ones left out."""
    from ..operators.search import SECTIONS

    lines = lambda items, body: F.array_join(F.filter(F.transform(items, body), lambda x: x != ""), "\n")
    bare = lambda i: X.nn(i["text"])
    told = lambda m: F.concat_ws(" ", X.nn(m["hash"]), X.nn(m["branch"]), X.nn(m["msg"]))
    empty = F.array().cast(records.schema["commits"].dataType["confirmed"].dataType)
    text = {
        "objective": X.nn("capsule.objective"), "briefing": X.nn("capsule.briefing"),
        "decisions": lines(F.col("capsule.decisions"), lambda d: F.concat(X.nn(d["decision"]), F.when(X.nn(d["why"]) != "", F.concat(F.lit(" — "), d["why"])).otherwise(""))),
        "files": lines(F.col("files"), lambda f: F.concat(f["short"], F.lit(" ("), f["status"], F.lit(")"))),
        "commits": lines(F.concat(F.coalesce("commits.confirmed", empty), F.coalesce("commits.possible", empty)), told),
        "dead_ends": lines(F.col("capsule.dead_ends"), bare), "pending": lines(F.col("capsule.pending"), bare), "left_out": lines(F.col("capsule.left_out"), bare),
        "timeline": lines(F.col("capsule.timeline"), lambda t: F.concat_ws(" ", X.nn(t["date"]), X.nn(t["repo"]), X.nn(t["result"]))),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(w).alias("weight"), F.coalesce(text[k], F.lit("")).alias("text")) for k, w in SECTIONS])
    return records.select("key", F.filter(parts, lambda s: F.trim(s["text"]) != "").alias("sections"))


def catalog(records: DataFrame, limit: int = 300, chars: int = 420) -> DataFrame:
    """A redacted line per record: objective and first three decisions; the most recent ones."""
    made = F.array_join(F.transform(F.slice(F.coalesce("capsule.decisions", F.array().cast(records.schema["capsule"].dataType["decisions"].dataType)), 1, 3), lambda d: X.nn(d["decision"])), "; ")
    line = F.substring(X.one_line(X.redact(F.concat_ws(" | ", "key", X.nn("capsule.objective"), made))), 1, chars)
    return records.orderBy(F.desc_nulls_last("generated_at"), "key").limit(limit).select("key", line.alias("line"))


def markdown(records: DataFrame) -> DataFrame:
    """(key, markdown): a report of each record."""
    cites = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<struct<session:string,turn:string>>")), lambda x: F.concat(F.lit("`"), x["session"], F.lit(":"), x["turn"], F.lit("`"))), " ")
    none = F.lit("_(none)_")

    def block(title: str, items, body):
        rows = F.array_join(F.transform(items, body), "\n")
        return F.concat(F.lit(f"\n## {title}\n"), F.when(F.coalesce(F.size(items), F.lit(0)) > 0, rows).otherwise(none))

    commit = lambda c: F.concat(F.lit("- `"), X.nn(c["hash"]), F.lit("` "), X.nn(c["msg"]), F.when(c["pushed"], " (pushed)").otherwise(""), F.when(c["undone"], " (possibly undone)").otherwise(""))
    item = lambda i: F.concat(F.lit("- "), X.nn(i["text"]), F.lit(" "), cites(i["cites"]))
    parts = [
        F.concat(F.lit("# Record of "), "key", F.lit("\n\n## Objective\n"), F.when(X.nn("capsule.objective") == "", none).otherwise(F.col("capsule.objective"))),
        block("Timeline", F.col("capsule.timeline"), lambda t: F.concat(F.lit("| "), F.concat_ws(" | ", X.nn(t["date"]), X.nn(t["repo"]), X.nn(t["result"]), cites(t["cites"])), F.lit(" |"))),
        block("Decisions", F.col("capsule.decisions"), lambda d: F.concat(F.lit("- **"), X.nn(d["decision"]), F.lit("** — "), F.when(X.nn(d["why"]) == "", F.lit("no reason given")).otherwise(d["why"]), F.lit(" "), cites(d["cites"]))),
        block("Files", F.col("files"), lambda f: F.concat(F.lit("- `"), f["short"], F.lit("` ("), f["edits"].cast("string"), F.lit("x, "), f["status"], F.lit(")"))),
        block("Commits", F.col("commits.confirmed"), commit), block("Dead ends", F.col("capsule.dead_ends"), item), block("Left out", F.col("capsule.left_out"), item), block("Pending", F.col("capsule.pending"), item),
        F.concat(F.lit("\n## Briefing\n> "), F.replace(X.nn("capsule.briefing"), F.lit("\n"), F.lit("\n> "))),
    ]
    return records.select("key", F.concat_ws("\n", *parts).alias("markdown"))
