"""Files and commits: edits inside windows, what was reverted, pushed or undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_PATH_TOKEN = r"[\w@.\-\[\]()]+(?:/[\w@.\-\[\]()]+)+"


def in_windows(events: DataFrame, window: DataFrame) -> DataFrame:
    """Events that some window of their session holds, each once: start <= ts < end, compared as strings."""
    w = window.select(F.col("session_id").alias("ws"), "start_ts", "end_ts")
    return events.join(w, (F.col("session_id") == F.col("ws")) & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")), "left_semi")


def edits(events: DataFrame) -> DataFrame:
    """(session_id, path, edits, last, source, cwd): work files that were edited; source is that of the last edit."""
    own = events.where((F.col("kind") == "edit") & X.is_work_file("path"))
    return own.groupBy("session_id", "path").agg(F.count("*").alias("edits"), F.max("ts").alias("last"), F.max_by("source", F.struct("ts", "seq")).alias("source"), F.min_by("cwd", F.struct("ts", "seq")).alias("cwd"))


def named_paths(cmd):
    """Paths that a command names; the target of `cd` is none."""
    flat = F.regexp_replace(F.regexp_replace(X.nn(cmd), r"\\\n", " "), r'(?<![A-Za-z0-9_])cd\s+"?[^\s"&;]+', " ")
    found = F.regexp_extract_all(flat, F.lit(_PATH_TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"^\./", ""), "/+$", "")), lambda t: F.contains(t, F.lit("/")))


def file_status(events: DataFrame, windowed: DataFrame | None = None) -> DataFrame:
    """Edited files with `status`: reverted if a later command names the file or a folder of it, or reverts all inside the windows."""
    inside = windowed if windowed is not None else events
    files = edits(inside)
    reverts = events.where("kind = 'revert'").select("session_id", F.col("ts").alias("rts"), F.col("source").alias("rsource"), "cmd", "seq", named_paths("cmd").alias("named"))
    held = reverts.join(inside.select("session_id", "seq").withColumn("inside", F.lit(True)), ["session_id", "seq"], "left")
    pairs = files.join(held, "session_id").where("rts > last")
    names = F.exists("named", lambda t: F.endswith(F.col("path"), F.concat(F.lit("/"), t)) | F.contains(F.col("path"), F.concat(F.lit("/"), t, F.lit("/"))))
    folder = F.regexp_replace(F.regexp_extract("cmd", r'(?<![A-Za-z0-9_])cd\s+"?([^\s"&;]+)', 1), "/+$", "")
    reach = F.when(folder != "", F.startswith(F.col("path"), F.concat(folder, F.lit("/")))).otherwise(F.col("rsource") == F.col("source"))
    bulk = F.coalesce(F.col("inside"), F.lit(False)) & F.col("cmd").rlike(X.GIT_REVERT_ALL) & reach
    hit = pairs.where(names | bulk).groupBy("session_id", "path").agg(F.max("rts").alias("revert_ts"))
    return files.join(hit, ["session_id", "path"], "left").select("session_id", "path", X.short_path("path", "cwd").alias("short"), "edits", F.when(F.col("revert_ts").isNull(), "final").otherwise("reverted").alias("status"), "last", "revert_ts")


def merge_files(status: DataFrame, by: list[str]) -> DataFrame:
    """Files of several sessions by short path: edits add up, the latest edit's status wins."""
    return status.groupBy(*by, "short").agg(F.sum("edits").alias("edits"), F.max_by("status", F.struct("last", "session_id", "path")).alias("status"), F.max("last").alias("last"))


def commits(events: DataFrame, windowed: DataFrame | None = None, key=None) -> DataFrame:
    """First commit per hash with `pushed`, `undone` and `confirmed` (the key is in message or branch)."""
    inside = windowed if windowed is not None else events
    order = Window.partitionBy("session_id", "hash").orderBy("ts", "seq")
    first = inside.where("kind = 'commit'").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    pushes = events.where("kind = 'push'").select(F.col("session_id").alias("ps"), F.col("hash").alias("ph"))
    prefix = F.substring("hash", 1, 7) == F.substring("ph", 1, 7)
    same = F.startswith(F.col("ph"), F.col("hash")) | F.startswith(F.col("hash"), F.col("ph"))
    pushed = first.join(pushes, (F.col("session_id") == F.col("ps")) & prefix & same, "left_semi").select("session_id", "hash").withColumn("pushed", F.lit(True))
    resets = events.where((F.col("kind") == "revert") & F.col("cmd").rlike(X.GIT_RESET)).select(F.col("session_id").alias("rs"), F.col("ts").alias("rts"), F.col("source").alias("rsource"), F.col("cmd").alias("rcmd"))
    agent = (F.col("rsource") == F.col("source")) & (F.col("source") != "main")
    named = F.contains(F.col("rcmd"), F.substring("hash", 1, 7))
    undone = first.join(resets, (F.col("session_id") == F.col("rs")) & (F.col("rts") > F.col("ts")) & (agent | named), "left_semi").select("session_id", "hash").withColumn("undone", F.lit(True))
    told = F.lower(F.concat_ws(" ", X.nn("msg"), X.nn("branch")))
    confirmed = F.lit(True) if key is None else F.contains(told, F.lower(X.col(key)))
    rows = first.join(pushed, ["session_id", "hash"], "left").join(undone, ["session_id", "hash"], "left")
    return rows.select("session_id", "hash", "branch", X.redact("msg").alias("msg"), "source", "ts", F.coalesce("pushed", F.lit(False)).alias("pushed"), F.coalesce("undone", F.lit(False)).alias("undone"), confirmed.alias("confirmed"))


def session_links(turns: DataFrame, member: DataFrame) -> DataFrame:
    """(short, unit, edits, last, basis): edits of a unit's sessions; one that only cites the unit counts from its first citing turn on."""
    rows = turns.where(F.size("files") > 0).select("session_id", "turn", "ts", "cwd", F.explode(F.array_distinct("files")).alias("path")).where(X.is_work_file("path"))
    cited = turns.select("session_id", "turn", F.explode("keys").alias("unit")).groupBy("session_id", "unit").agg(F.min("turn").alias("from_turn"))
    owned = member.join(cited, ["session_id", "unit"], "left").where("mode = 'main' or from_turn is not null")
    linked = rows.join(owned, "session_id").where("mode = 'main' or turn >= from_turn")
    basis = F.when(F.bool_or(F.col("mode") == "main"), "session").otherwise("mention")
    return linked.groupBy(X.short_path("path", "cwd").alias("short"), "unit").agg(F.count("*").alias("edits"), F.max("ts").alias("last"), basis.alias("basis"))


def file_links(from_capsules: DataFrame, from_sessions: DataFrame) -> DataFrame:
    """Units with a written record use its files; only the others use their sessions' edits."""
    own = from_sessions.join(from_capsules.select("unit").distinct(), "unit", "left_anti")
    return from_capsules.withColumn("approximate", F.lit(False)).unionByName(own.withColumn("approximate", F.lit(True)), allowMissingColumns=True)


def shared_files(links: DataFrame, limit: int = 40) -> DataFrame:
    """Files of the most units, then by path."""
    return links.groupBy("short").agg(F.countDistinct("unit").alias("units")).orderBy(F.desc("units"), "short").limit(limit)


def commit_output(results: DataFrame) -> DataFrame:
    """Commits and pushes announced in command output. results: session_id, source, seq, ts, text."""
    lines = results.select("session_id", "source", "seq", "ts", F.posexplode(F.split(X.nn("text"), r"\r?\n")).alias("i", "line"))
    bare = F.trim("line")
    commit = lines.where(bare.rlike(X.COMMIT_LINE)).select("session_id", "source", "seq", "ts", F.lit("commit").alias("kind"), F.regexp_extract(bare, X.COMMIT_LINE, 2).alias("hash"), F.regexp_extract(bare, X.COMMIT_LINE, 1).alias("branch"), F.substring(X.redact(F.trim(F.regexp_extract(bare, X.COMMIT_LINE, 3))), 1, 160).alias("msg"), F.lit(None).cast("string").alias("ref"))
    push = lines.where(~bare.rlike(X.COMMIT_LINE) & F.col("line").rlike(X.PUSH_LINE)).select("session_id", "source", "seq", "ts", F.lit("push").alias("kind"), F.regexp_extract("line", X.PUSH_LINE, 2).alias("hash"), F.lit(None).cast("string").alias("branch"), F.lit(None).cast("string").alias("msg"), F.regexp_extract("line", X.PUSH_LINE, 3).alias("ref"))
    return commit.unionByName(push)


def tool_events(records: DataFrame) -> DataFrame:
    """Edits, reverts, commits and pushes of `records`: a result counts if an earlier call of the same id exists in its file."""
    flat = records.where("ts is not null and blocks is not null").select("session_id", "source", "line_no", "ts", "cwd", F.posexplode("blocks").alias("i", "b"))
    seq = (F.col("line_no").cast("long") * 1_000_000 + F.col("i")).alias("seq")
    none = lambda n: F.lit(None).cast("string").alias(n)
    call = flat.where("b.type = 'tool_use'")
    edit = call.where(F.col("b.name").isin("Edit", "Write", "NotebookEdit", "MultiEdit") & (X.nn("b.input.file_path") != "")).select("session_id", "source", seq, "ts", F.lit("edit").alias("kind"), F.col("b.input.file_path").alias("path"), "cwd", none("cmd"), none("hash"), none("branch"), none("msg"), none("ref"))
    bash = call.where((F.col("b.name") == "Bash") & (X.nn("b.input.command") != ""))
    revert = bash.where(F.col("b.input.command").rlike(X.GIT_REVERT)).select("session_id", "source", seq, "ts", F.lit("revert").alias("kind"), none("path"), none("cwd"), F.col("b.input.command").alias("cmd"), none("hash"), none("branch"), none("msg"), none("ref"))
    asked = bash.where(F.col("b.input.command").rlike(X.GIT_PUBLISH)).groupBy("session_id", "source", F.col("b.id").alias("call_id")).agg(F.min(F.struct("line_no", "i")).alias("first"))
    content = F.col("b.content")
    parts = F.from_json(content, "array<struct<type string, text string>>")
    text = F.coalesce(F.when(content.rlike(r"^\s*\["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: X.nn(p["text"])), "\n")), content)
    result = flat.where("b.type = 'tool_result'").withColumn("call_id", F.col("b.tool_use_id")).join(asked, ["session_id", "source", "call_id"]).where(F.struct("line_no", "i") > F.col("first")).select("session_id", "source", seq, "ts", text.alias("text"))
    out = commit_output(result).select("session_id", "source", "seq", "ts", "kind", none("path"), none("cwd"), none("cmd"), "hash", "branch", "msg", "ref")
    return edit.unionByName(revert).unionByName(out)


#: Files of a session that are listed.
MOST_FILES = 60


def session_files(turns: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(session_id, path, short, kind, place): work files that a session created, then those it edited, by path.

    turns: session_id, turn, cwd, files and written (arrays of absolute paths).
    """
    rows = turns.select("session_id", "turn", "cwd", F.explode(F.array_distinct("files")).alias("path"), "written")
    rows = rows.where(F.startswith("path", F.lit("/")) & X.is_work_file("path"))
    created = F.bool_or(F.coalesce(F.array_contains("written", F.col("path")), F.lit(False)))
    held = rows.groupBy("session_id", "path").agg(created.alias("created"), F.min_by(X.short_path("path", F.col("cwd")), "turn").alias("short"))
    order = Window.partitionBy("session_id").orderBy(F.desc("created"), "short", "path")
    placed = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.select("session_id", "path", "short", F.when(F.col("created"), "created").otherwise("edited").alias("kind"), "place")
