"""Streams that keep state between batches, and sinks that a repeated batch doesn't count twice.

Every sink writes a batch into a folder of its own, `run=<run>/batch=<id>`, so a batch that runs again after a failure
overwrites what it wrote before. What a sink needs of earlier batches it reads from the folder of the batch
before, never from its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import organize

HOUR = 3_600_000_000


# -- sessions near each other


def _swept(rows: pd.DataFrame, wide: int) -> Iterator[tuple[str, str, int]]:
    """Pairs (unit, other, gap) of points with a new one, both ways: each point with the two nearest other units before, and at its time.

    rows: unit, us, new. Of one time the first names are the nearest."""
    rows = rows.sort_values(["us", "unit"], ascending=[True, False])
    points = list(rows.itertuples(index=False))
    for order in (points, points[::-1]):
        recent: list = []  # the latest points of three units, latest last
        for _, group in groupby(order, key=lambda p: p.us):
            names = sorted(group, key=lambda p: p.unit)
            for p in names:
                near = [q for q in names[:3] if q.unit != p.unit][:2] + [q for q in reversed(recent) if q.unit != p.unit][:2]
                for q in near:
                    if (p.new or q.new) and abs(p.us - q.us) <= wide:
                        yield p.unit, q.unit, abs(p.us - q.us)
                        yield q.unit, p.unit, abs(p.us - q.us)
            for q in reversed(names[:3]):
                recent = [x for x in recent if x.unit != q.unit][-2:] + [q]


def nearest_pairs(points: DataFrame, hours: int = 2, late: str = "1 hour") -> DataFrame:
    """(project, unit, other, gap): pairs of units of a project within `hours`, as their messages arrive.

    points: project, unit, ts. State of a project are its points of the last hours before the watermark; a point leaves
    when no later one can be near it, and the state when all have left. A new point makes a few pairs, those with its nearest
    units, and not one with every point around: the nearest two of a unit are among them (`two_nearest`).
    Rows later than the watermark are left to the batch job."""
    wide = hours * HOUR

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        units, times = state.get if state.exists else ([], [])
        old = pd.DataFrame({"unit": list(units), "us": list(times), "new": False})
        if state.hasTimedOut:
            rows, pairs = old, []
        else:
            fresh = pd.concat(list(parts))[["unit", "us"]].drop_duplicates().assign(new=True)
            rows = pd.concat([old, fresh], ignore_index=True).sort_values("new").drop_duplicates(["unit", "us"]).astype({"us": "int64"})
            pairs = sorted(set(_swept(rows, wide)))
        mark = state.getCurrentWatermarkMs() * 1000
        rows = rows[rows["us"] >= mark - wide]
        if len(rows):
            state.update((rows["unit"].tolist(), [int(x) for x in rows["us"]]))
            state.setTimeoutTimestamp(max(int(rows["us"].min() + wide) // 1000, mark // 1000) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *p) for p in pairs], columns=["project", "unit", "other", "gap"])

    timed = points.withWatermark("ts", late).select("project", "unit", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("project").applyInPandasWithState(step, "project string, unit string, other string, gap long", "units array<string>, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def two_nearest(pairs: DataFrame) -> DataFrame:
    """(unit, other, gap_s, rank): the two nearest of each unit, as `sessions.related` has them."""
    from pyspark.sql import Window

    best = pairs.groupBy("unit", "other").agg(F.min("gap").alias("gap"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("gap", "other"))
    return best.withColumn("rank", rank).where("rank <= 2").select("unit", "other", (F.col("gap") / 1e6).alias("gap_s"), "rank")


# -- sinks


def _folder(path: str, run: str, batch: int) -> str:
    return f"{path}/run={run}/batch={batch}"


def _stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


USAGE = "action string, unit string, ts string, input_tokens long, output_tokens long, cost_usd double"


def usage_sink(path: str, run: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that appends usage calls; a batch that comes twice counts once."""

    def write(calls: DataFrame, batch: int) -> None:
        calls.select("action", "unit", "ts", "input_tokens", "output_tokens", "cost_usd").write.mode("overwrite").parquet(_folder(path, run, batch))

    return write


def usage(spark: SparkSession, path: str) -> DataFrame:
    """All calls of all runs and batches; none if nothing was appended yet."""
    return _stored(spark, path, USAGE + ", run string, batch long")


PROPOSALS = "id string, type string, status string, sessions array<string>, title string, confidence string"


def proposals_sink(path: str, run: str, analysed: Callable[[DataFrame], DataFrame], revive: Callable[[int], DataFrame], begin: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that folds new proposals into those of the batch before (`organize.upsert`).

    analysed(batch) tells the sessions that the batch looked at, revive(id) the rejected proposals that were asked for; `begin`
    are the proposals before the run. A batch that comes twice starts from the same state and writes the same."""

    def write(new: DataFrame, batch: int) -> None:
        spark = new.sparkSession
        first = begin if begin is not None else spark.createDataFrame([], PROPOSALS)
        old = first if batch == 0 else _stored(spark, _folder(path, run, batch - 1), PROPOSALS)
        now = organize.upsert(old, new.select(old.columns), analysed(new), revive(batch))
        now.write.mode("overwrite").parquet(_folder(path, run, batch))

    return write


def proposals(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The proposals after the newest batch of a run."""
    rows = _stored(spark, f"{path}/run={run}", PROPOSALS + ", batch long")
    newest = rows.agg(F.max("batch").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("batch") == F.col("_newest"), "left_semi").drop("batch")


_FRESH = "session_id string, ts timestamp, keys array<string>"
_FIRST = "session_id string, key string, first_ts timestamp"


def outdated_sink(path: str, run: str, records: Callable[[], DataFrame], member: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps count of the messages of each unit after its record was written.

    A batch has session_id, ts, noise and keys of new prompts. Records (unit, since) and members (session_id, unit, mode)
    are read anew in each batch. Kept are `fresh`, the prompts that are newer than the oldest record (older ones are newer than no record,
    now or later, since records are only written anew), and `first`, the first time of each session and of each key in it. The
    counts of a batch are in `count`: a session of the unit counts with all its prompts, one that only mentions it
    with those that cite it, and it is a new one if its first counted prompt is newer than the record."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here, before = _folder(path, run, number), _folder(path, run, number - 1)
        since, units = records().select("unit", "since"), member().select("session_id", "unit", "mode")
        new = batch.where(~F.col("noise") & F.col("ts").isNotNull()).select("session_id", "ts", "keys")
        seen = new.select("session_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("keys"))).alias("key"), F.col("ts").alias("first_ts"))
        first = _stored(spark, f"{before}/first", _FIRST).unionByName(seen).groupBy("session_id", "key").agg(F.min("first_ts").alias("first_ts"))
        first.write.mode("overwrite").parquet(f"{here}/first")
        oldest = since.agg(F.min("since").alias("_oldest"))
        fresh = _stored(spark, f"{before}/fresh", _FRESH).unionByName(new).crossJoin(F.broadcast(oldest)).where(F.col("_oldest").isNull() | (F.col("ts") > F.col("_oldest"))).drop("_oldest")
        fresh.write.mode("overwrite").parquet(f"{here}/fresh")
        rows, starts = spark.read.schema(_FRESH).parquet(f"{here}/fresh"), spark.read.schema(_FIRST).parquet(f"{here}/first")
        wanted = units.join(since, "unit")
        counted = (F.col("mode") != "mention") | F.array_contains("keys", F.col("unit"))
        late = wanted.join(rows, "session_id").where(counted & (F.col("ts") > F.col("since"))).groupBy("unit", "session_id").agg(F.count("*").alias("new"))
        key = F.when(F.col("mode") == "mention", F.col("unit"))
        start = wanted.withColumn("key", key).join(starts, (wanted["session_id"] == starts["session_id"]) & key.eqNullSafe(starts["key"])).select(wanted["unit"], wanted["session_id"], (F.col("first_ts") > F.col("since")).alias("whole"))
        per = start.join(late, ["unit", "session_id"], "left")
        count = per.groupBy("unit").agg(F.coalesce(F.sum("new"), F.lit(0)).alias("new_messages"), F.count_if(F.col("whole")).alias("new_sessions"))
        count.write.mode("overwrite").parquet(f"{here}/count")

    return write


def outdated_counts(spark: SparkSession, path: str, run: str, batch: int) -> DataFrame:
    """(unit, new_messages, new_sessions) after a batch."""
    return spark.read.parquet(f"{_folder(path, run, batch)}/count")
