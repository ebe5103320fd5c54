"""Session transcripts: JSON lines in `<root>/<project>/<session>.jsonl`.

`records` is the base table: one row per line that is a JSON object, with the place of the
line in its file. Line numbers follow file blocks and the order within a block, so a file may
be read in many splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

RECORD = """type string, timestamp string, gitBranch string, cwd string, isSidechain boolean, isMeta boolean, customTitle string,
            message struct<content string>, corrupt string"""
BLOCKS = """array<struct<type string, text string, id string, name string, tool_use_id string, content string,
            input struct<command string, file_path string>>>"""


def _lines(spark: SparkSession, pattern: str) -> DataFrame:
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("lineSep", "\n").text(pattern)
    except (AnalysisException, Py4JJavaError):  # nothing matches: no sessions
        return spark.createDataFrame([], "path string, block long, line string, at long")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, r): lines that are JSON objects; malformed lines and other values are skipped."""
    order = Window.partitionBy("path").orderBy("block", "at")
    rows = lines.withColumn("line_no", F.row_number().over(order))
    parsed = rows.withColumn("r", F.from_json("line", RECORD, {"columnNameOfCorruptRecord": "corrupt"}))
    good = F.col("line").rlike(r"^\s*\{") & F.col("r").isNotNull() & F.col("r.corrupt").isNull()
    return parsed.where(good).select("path", "line_no", "r")


def records(spark: SparkSession, root: str, tz: str = "UTC") -> DataFrame:
    """All records of all sessions: session_id, project, line_no, fields, text of the prompt, blocks."""
    return shaped(parse_lines(_lines(spark, f"{root}/*/*.jsonl")), r"/([^/]+)/([^/]+)\.jsonl$", "main")


def subagent_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of `<project>/<session>/subagents/*.jsonl`; `source` is the file name, cut to 14 characters."""
    return shaped(parse_lines(_lines(spark, f"{root}/*/*/subagents/*.jsonl")), r"/([^/]+)/([^/]+)/subagents/[^/]+\.jsonl$", None)


def shaped(parsed: DataFrame, pattern: str, source: str | None, place: list[str] | None = None, encoded: bool = True) -> DataFrame:
    """Records of parsed lines; `place` are the columns that put them in order, `encoded` says whether paths are those of URLs."""
    part = lambda k: F.url_decode(F.regexp_extract("path", pattern, k)) if encoded else F.regexp_extract("path", pattern, k)
    agent = F.substring(F.regexp_extract("path", r"/([^/]+)\.jsonl$", 1), 1, 14)
    rows = parsed.select(part(2).alias("session_id"), part(1).alias("project"), (F.lit(source) if source else agent).alias("source"), *(place or ["line_no"]), "r.type", F.col("r.timestamp").alias("ts"), F.col("r.gitBranch").alias("branch"), "r.cwd", F.coalesce("r.isSidechain", F.lit(False)).alias("sidechain"), F.coalesce("r.isMeta", F.lit(False)).alias("meta"), F.col("r.customTitle").alias("title"), F.col("r.message.content").alias("content"))
    return rows.withColumn("blocks", F.when(F.col("content").rlike(r"^\s*\["), F.from_json("content", BLOCKS))).withColumn("text", user_text(F.col("content"), F.col("blocks")))


def user_text(content: Column, blocks: Column) -> Column:
    """Text of a prompt: string content, or its text blocks joined by line ends; '' if injected."""
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: X.nn(b["text"])), "\n")
    whole = F.regexp_replace(X.nn(F.coalesce(joined, content)), r"(?U)^\s+|\s+$", "")
    return F.when(X.starts_with_any(whole, X.INJECTED), F.lit("")).otherwise(whole)


def is_prompt() -> Column:
    return (F.col("type") == "user") & ~F.col("sidechain") & ~F.col("meta") & (F.col("text") != "")
