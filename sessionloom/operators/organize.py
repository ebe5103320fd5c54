"""Digests of sessions for a model, and checks of what it proposes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Sampling, batches, run.
LONG, SHOWN, FIRST, BATCH_CHARS, BATCH_SESSIONS, RUN = 14, 40, 3, 36_000, 40, 160
RANK = {"high": 0, "medium": 1, "low": 2}


def real_turns(turns: DataFrame) -> DataFrame:
    """Turns that say something, numbered within their session."""
    rows = turns.where(~F.col("noise") & (X.meaningful("text") != ""))
    by = Window.partitionBy("session_id")
    return rows.withColumn("k", F.row_number().over(by.orderBy("turn")) - 1).withColumn("n", F.count("*").over(by))


def sample(turns: DataFrame) -> DataFrame:
    """Shown turns: the first three and the last; of long sessions also 40 evenly spaced ones."""
    rows = real_turns(turns)
    shown = F.least(F.lit(SHOWN), F.col("n"))
    spaced = F.transform(F.sequence(F.lit(0), shown - 1), lambda j: F.floor(j * (F.col("n") - 1) / F.greatest(F.lit(1), shown - 1)).cast("int"))
    keep = (F.col("k") < FIRST) | (F.col("k") == F.col("n") - 1) | ((F.col("n") >= LONG) & F.array_contains(spaced, F.col("k")))
    return rows.where(keep).select("session_id", "turn", "ts", "text", (F.col("n") >= LONG).alias("long"), F.col("n").alias("real"))


def digests(turns: DataFrame) -> DataFrame:
    """One text per session: a head line, up to six files, the sampled messages."""
    shown = sample(turns)
    clock = F.date_format("ts", "HH:mm")
    line = F.concat(F.lit("t"), "turn", F.lit(" "), clock, F.lit(" | "), F.substring(X.one_line(X.redact("text")), F.lit(1), F.when(F.col("long"), 110).otherwise(170)))
    lines = shown.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("ls"), F.first("long").alias("long"), F.first("real").alias("real"))
    named = turns.select("session_id", "turn", "cwd", F.posexplode("files").alias("i", "f")).withColumn("short", X.redact(X.short_path("f", "cwd")))
    firsts = named.groupBy("session_id", "short").agg(F.min(F.struct("turn", "i")).alias("at"))
    files = firsts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "short"))).alias("fs"))
    head = turns.groupBy("session_id").agg(F.first("project").alias("project"), F.min_by("branch", "turn").alias("branch"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    rows = lines.join(head, "session_id").join(files, "session_id", "left")
    title = F.concat(F.lit("SESSION "), F.substring("session_id", 1, 8), F.lit(" | repo="), "project", F.lit(" | branch="), "branch", F.lit(" | "), F.date_format("first_ts", "yyyy-MM-dd HH:mm"), F.lit("-"), F.date_format("last_ts", "HH:mm"), F.lit(" | messages="), F.col("real").cast("string"), F.when(F.col("long"), " (long)").otherwise(""))
    listed = F.when(F.col("fs").isNotNull(), F.concat(F.lit("files: "), F.array_join(F.slice(F.col("fs.short"), 1, 6), ", ")))
    body = F.array_join(F.col("ls.line"), "\n")
    return rows.select("session_id", "first_ts", "real", "long", F.concat_ws("\n", title, listed, body).alias("text"))


def batches(digest: DataFrame, workspace: str = "workspace", chars: int = BATCH_CHARS, sessions: int = BATCH_SESSIONS) -> DataFrame:
    """(workspace, session_id, batch): consecutive sessions, oldest first, greedily filled. Sequential within a workspace's run of at most RUN sessions."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_ts", "session_id"])
        out, batch, held, size = [], 0, 0, 0
        for n in pdf["size"]:
            if held and (size + n + 2 > chars or held >= sessions):
                batch, held, size = batch + 1, 0, 0
            out.append(batch)
            held, size = held + 1, size + n + 2
        return pdf.assign(batch=out)[[workspace, "session_id", "batch"]]

    rows = digest.select(workspace, "session_id", "first_ts", F.length("text").alias("size"))
    return rows.groupBy(workspace).applyInPandas(fill, f"{workspace} string, session_id string, batch int")


def run_sessions(summary: DataFrame, limit: int = RUN) -> DataFrame:
    """Of each workspace the most recent sessions that are units of their own, not noise, hidden or cut."""
    order = Window.partitionBy("workspace").orderBy(F.desc("first_ts"), "session_id")
    return summary.where("alone and not noise and not hidden and not cut").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def status_of(proposals: DataFrame, ops: DataFrame) -> DataFrame:
    """The proposals with the status they have now: an accepted one whose batch was undone is pending again. ops: batch, undone."""
    live = ops.where(~F.coalesce("undone", F.lit(False))).select(F.col("batch").alias("_b")).distinct()
    back = (F.col("status") == "accepted") & F.col("_b").isNull()
    return proposals.join(live, F.col("batch") == F.col("_b"), "left").withColumn("status", F.when(back, "pending").otherwise(F.col("status"))).drop("_b")


def applies(proposals: DataFrame, units: DataFrame) -> DataFrame:
    """(id, applies): every session of the proposal is still a visible unit of its own. units: unit, session_id, hidden."""
    own = units.where(F.col("unit").rlike("^session:[^#]+$") & ~F.col("hidden")).select("session_id").distinct().withColumn("_own", F.lit(True))
    asked = proposals.select("id", F.explode_outer("sessions").alias("session_id"))
    return asked.join(own, "session_id", "left").groupBy("id").agg(F.bool_and(F.coalesce("_own", F.col("session_id").isNull())).alias("applies"))

def check_splits(parts: DataFrame, shown: DataFrame, sizes: DataFrame) -> DataFrame:
    """(session_id, ok, parts): a split needs a long session and two ranges with title, evidence and a real message inside; any overlap rejects it.

    parts: session_id, start, end, title, evidence array<int>; shown: session_id, turn; sizes: session_id, n, long."""
    rows = parts.join(sizes, "session_id").where("long and start >= 0 and end >= start and end < n").where(F.length(F.trim(X.nn("title"))) >= 3).withColumn("part", F.monotonically_increasing_id())
    real = shown.select("session_id", "turn").distinct()
    inside = rows.select("session_id", "part", "start", "end", F.explode("evidence").alias("turn")).where(F.col("turn").between(F.col("start"), F.col("end"))).join(real, ["session_id", "turn"], "left_semi").select("session_id", "start", "end").distinct()
    good = rows.drop("part").join(inside, ["session_id", "start", "end"], "left_semi").dropDuplicates(["session_id", "start", "end"])
    clash = F.coalesce(F.col("start") <= F.lag("end").over(Window.partitionBy("session_id").orderBy("start")), F.lit(False))
    per = good.withColumn("clash", clash).groupBy("session_id").agg(F.count("*").alias("parts"), F.bool_or("clash").alias("clash"))
    return sizes.join(parts.select("session_id").distinct(), "session_id", "left_semi").join(per, "session_id", "left").select("session_id", F.coalesce((F.col("parts") >= 2) & ~F.col("clash"), F.lit(False)).alias("ok"), F.coalesce("parts", F.lit(0)).alias("parts"))


def check_groups(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """(batch, pos, members): groups with a title and at least two members that evidence backs; a session joins the first such group only.

    groups: batch, pos, title, members array<string>, evidence array<struct<session_id, turn>>. Sequential within a batch of at most 40 sessions."""
    ev = groups.select("batch", "pos", F.explode("evidence").alias("e")).select("batch", "pos", "e.session_id", "e.turn").join(shown.select("session_id", "turn").distinct(), ["session_id", "turn"], "left_semi").groupBy("batch", "pos").agg(F.collect_set("session_id").alias("backed"))
    rows = groups.select("batch", "pos", F.length(F.trim(X.nn("title"))).alias("tl"), F.array_distinct("members").alias("members")).join(ev, ["batch", "pos"], "left")
    rows = rows.withColumn("members", F.array_intersect("members", F.coalesce("backed", F.array().cast("array<string>"))))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        for r in pdf.sort_values("pos").itertuples():
            own = [m for m in r.members if m not in taken]
            if len(own) >= 2 and r.tl >= 3:
                taken.update(own)
                out.append((r.batch, r.pos, own))
        return pd.DataFrame(out, columns=["batch", "pos", "members"])

    return rows.groupBy("batch").applyInPandas(choose, "batch string, pos int, members array<string>")


def check_titles(titles: DataFrame, current: DataFrame, renamed: DataFrame) -> DataFrame:
    """(session_id, title): first proposal per known session that the user hasn't named, if it differs from the title it has."""
    norm = lambda c: F.lower(F.regexp_replace(X.nn(c), r"[^\p{L}\p{N}]+", " "))
    rows = titles.join(current, "session_id").join(renamed.select("session_id"), "session_id", "left_anti").where(F.length(F.trim(X.nn("title"))) >= 3).where(F.trim(norm("title")) != F.trim(norm("current")))
    first = Window.partitionBy("session_id").orderBy("pos")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").select("session_id", X.cut_title("title").alias("title"))


def proposal_id(kind, sessions, parts=None):
    """Stable id: twelve digits of the hash of type, sorted sessions and parts."""
    return F.substring(F.sha1(F.concat_ws("|", X.col(kind), F.array_join(F.array_sort(X.col(sessions)), ","), F.lit("") if parts is None else X.col(parts))), 1, 12)


def signature(rows: DataFrame, version: int = 1) -> DataFrame:
    """(workspace, signature) of what a run reads: sessions, their turns and last times."""
    item = F.concat_ws(":", "session_id", "turns", "last_ts")
    return rows.groupBy("workspace").agg(F.sha1(F.concat(F.lit(f"{version}|"), F.array_join(F.array_sort(F.collect_list(item)), ","))).alias("signature"))


def upsert(old: DataFrame, new: DataFrame, analysed: DataFrame, revive: DataFrame) -> DataFrame:
    """Proposals after a run: pending ones about analysed sessions are replaced, decided ones stay, rejected ones return only if asked for.

    old, new: id, status, sessions, body; analysed: session_id; revive: id."""
    about = old.where("status = 'pending'").select("id", F.explode("sessions").alias("session_id")).join(analysed, "session_id", "left_semi").select("id").distinct()
    again = new.select("id").join(revive, "id", "left_semi")
    stays = old.join(about, "id", "left_anti")
    stays = stays.join(again.withColumn("_a", F.lit(True)), "id", "left").where(~(F.coalesce("_a", F.lit(False)) & (F.col("status") == "rejected"))).drop("_a")
    fresh = new.dropDuplicates(["id"]).join(stays.select("id"), "id", "left_anti").withColumn("status", F.lit("pending"))
    return stays.unionByName(fresh.select(stays.columns))


def _order() -> list:
    """Groups, splits, titles; within them by falling confidence."""
    kind = F.when(F.col("type") == "group", 0).when(F.col("type") == "split", 1).otherwise(2)
    sure = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "medium", 1).otherwise(2)
    return [kind, sure, F.col("id")]


def ordered(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(*_order())


def placed(proposals: DataFrame, by: list[str]) -> DataFrame:
    """With `place` in that order within `by`, such as a run."""
    return proposals.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*_order())))


def accept(proposals: DataFrame, batch: str, renamed: DataFrame, least: str = "low") -> DataFrame:
    """Correction operations of accepted proposals of at least that confidence, all in one batch; units that the user has named are skipped."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in RANK.items() for x in k)), F.col("confidence")), F.lit(RANK["low"]))
    proposals = proposals.where(rank <= RANK[least])
    op = F.when(F.col("type") == "group", "merge").when(F.col("type") == "split", "cut").otherwise("rename")
    free = proposals.join(renamed.select("unit"), "unit", "left_anti")
    return free.select(F.concat(F.lit(f"{batch}-"), "id").alias("id"), F.lit(batch).alias("batch"), op.alias("type"), "unit", F.col("title").alias("label"), F.lit("ai").alias("source"), F.col("id").alias("proposal"))
