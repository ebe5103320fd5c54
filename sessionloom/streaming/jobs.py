"""Structured Streaming versions of the incremental jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_prompts(prompts: DataFrame, late: str = "1 day") -> DataFrame:
    """Prompts per project and day; rows later than the watermark are left to the batch job."""
    return prompts.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "project").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "project", "n")


def running_usage(calls: DataFrame) -> DataFrame:
    """Calls and dollars per action so far (complete mode)."""
    return calls.groupBy("action").agg(F.count("*").alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))


def outdated(messages: DataFrame, capsules: DataFrame) -> DataFrame:
    """Messages per unit after its record was written (update mode). capsules: a static table of unit and since."""
    return messages.join(capsules, "unit").where("ts > since").groupBy("unit").agg(F.count("*").alias("new_messages"))


def related_pairs(left: DataFrame, right: DataFrame, hours: int = 2) -> DataFrame:
    """Messages of different sessions of one project within `hours` of each other, as they arrive."""
    a = left.withWatermark("ts", "1 hour").select("project", F.col("session_id").alias("unit"), "ts")
    b = right.withWatermark("ts", "1 hour").select(F.col("project").alias("project2"), F.col("session_id").alias("other"), F.col("ts").alias("ts2"))
    near = F.expr(f"project = project2 and unit < other and ts2 between ts - interval {hours} hours and ts + interval {hours} hours")
    return a.join(b, near).select("project", "unit", "other", "ts", "ts2")


def numbered_turns(records: DataFrame, place: str = "line_no") -> DataFrame:
    """Turn numbers continued over batches: state is one counter per session. records: session_id, is_prompt, text, `place` (the
    order of lines), and maybe `restart`: a session whose file was written anew begins at 0 again, and its rows say so."""
    again = "restart" in records.columns

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(place)
        turn = state.get[0] if state.exists and not (again and rows["restart"].any()) else 0
        running = turn + rows["is_prompt"].astype(int).cumsum()
        state.update((int(running.iloc[-1]),))
        yield rows.assign(turn=(running - 1).astype("int32"))[["session_id", place, "turn", "text", *["restart"] * again]]

    out = f"session_id string, {place} long, turn int, text string" + ", restart boolean" * again
    return records.groupBy("session_id").applyInPandasWithState(number, out, "turns int", "append", GroupStateTimeout.NoTimeout)


def replace_sessions(path: str):
    """foreachBatch sink: each batch is a folder of its own, and `latest` reads the newest batch of a session.

    A batch that runs again overwrites its own folder, so nothing is written twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(table: DataFrame) -> DataFrame:
    """Rows of the newest batch of each session."""
    newest = table.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return table.join(newest, ["session_id", "batch"], "left_semi")


def changed_sessions(now: DataFrame, was: DataFrame) -> DataFrame:
    """(session_id, change): new, changed or deleted against the manifest of (session_id, size, mtime)."""
    a, b = now.select("session_id", F.struct("size", "mtime").alias("n")), was.select("session_id", F.struct("size", "mtime").alias("w"))
    both = a.join(b, "session_id", "full")
    change = F.when(F.col("w").isNull(), "new").when(F.col("n").isNull(), "deleted").when(F.col("n") != F.col("w"), "changed")
    return both.select("session_id", change.alias("change")).where("change is not null")
